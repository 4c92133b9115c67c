"""Byte formats, the durable table, streams and the shell."""

import io

import pytest
from pyspark.sql import functions as F

from tidemark.cli import answer
from tidemark.functions import codec
from tidemark.operators.pointer import Conflict
from tidemark.operators.replica_store import Record, ReplicaStore
from tidemark.operators.table import NotFound, Options, PositionGone, VersionedTable
from tidemark.sources import runs, wal

GOLDEN = [((0, b"a", b"1"), "a72f532b0b0000000001000000610100000031"), ((0, b"b", b"2"), "b30cce340b0000000001000000620100000032"), ((1, b"a", b""), "f64961bf0a00000001010000006100000000")]


def test_golden_records(spark):
    for (kind, key, value), want in GOLDEN:
        assert wal.pack_record(kind, key, value).hex() == want
    df = spark.createDataFrame([(k, bytearray(a), bytearray(b)) for (k, a, b), _ in GOLDEN], "kind int, key binary, value binary")
    made = df.select(F.lower(F.hex(codec.wal_record(F.col("kind"), F.col("key"), F.col("value")))).alias("r")).collect()
    assert [r.r for r in made] == [w for _, w in GOLDEN]


def test_frame_round_trip_and_damage(spark):
    frames = [wal.pack_frame(0, b"key", b"value"), wal.pack_frame(1, b"", b""), b"", b"\x00\xff\x00\x00\x00", wal.pack_frame(0, b"k", b"v") + b"x", wal.pack_frame(0, b"k", b"vv")[:-1]]
    rows = spark.createDataFrame([(bytearray(f),) for f in frames], "f binary").select(codec.decode_frame(F.col("f")).alias("d")).collect()
    got = [None if r.d is None else (r.d.kind, bytes(r.d.key), bytes(r.d.value)) for r in rows]
    assert got == [wal.unpack_frame(f) for f in frames] == [(0, b"key", b"value"), (1, b"", b""), None, None, None, None]


@pytest.mark.parametrize("damage,left", [(lambda d: d, 3), (lambda d: d[:-3], 2), (lambda d: d + b"\x01\x02", 3), (lambda d: d[:25] + b"\xff" + d[26:], 1), (lambda d: b"", 0)])
def test_replay_reads_the_valid_prefix(spark, tmp_path, damage, left):
    data = damage(wal.pack_log([m for m, _ in GOLDEN]))
    path = tmp_path / "w.log"
    path.write_bytes(data)
    want = [m for m, _ in GOLDEN][:left]
    assert list(wal.replay(data)) == want
    rows = wal.read_logs(spark, str(path)).orderBy("seq").collect()
    assert [(r.kind, bytes(r.key), bytes(r.value)) for r in rows] == want
    spark.dataSource.register(wal.WalDataSource)
    rows = spark.read.format("kvwal").load(str(path)).orderBy("seq").collect()
    assert [(r.kind, bytes(r.key), bytes(r.value)) for r in rows] == want
    assert spark.read.format("kvwal").load(str(tmp_path / "none.log")).count() == 0


def test_record_checksum(spark):
    good, bad = wal.pack_record(0, b"a", b"1"), bytearray(wal.pack_record(0, b"a", b"1"))
    bad[-1] ^= 1
    rows = spark.createDataFrame([(bytearray(good),), (bad,)], "r binary").select(codec.wal_checksum_ok(F.col("r")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True, False]


def test_text_helpers(spark):
    row = spark.createDataFrame([("1=a:1,2=b=c", "  x   y ")], "p string, v string").select(codec.parse_peers(F.col("p")).alias("p"), codec.squeeze(F.col("v")).alias("v")).head()
    assert row.p == {"1": "a:1", "2": "b=c"} and row.v == "x y"


def items(t):
    return [(bytes(r.key), bytes(r.value)) for r in t.items().collect()]


def test_table_life(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", Options(flush_rows=1000, compaction_trigger=3))
    assert items(t) == []
    t.flush()
    assert t.at.n_runs == 0  # an empty flush makes no run
    t.write([(0, b"b", b"1"), (0, b"a", b"1")])
    t.flush()
    t.write([(0, b"a", b"2"), (0, b"c", b"1"), (1, b"b", b"")])
    assert items(t) == [(b"a", b"2"), (b"c", b"1")]
    with pytest.raises(NotFound):
        t.get(b"b")
    again = VersionedTable(spark, f"file://{tmp_path}/t", t.options)  # the tail survives
    assert items(again) == items(t) and again.get(b"a") == b"2"
    again.flush()
    again.put(b"d", b"9")
    again.flush()  # third run: compaction
    assert again.at.n_runs == 1 and again.runs().where("kind = 1").count() == 0
    assert items(again) == [(b"a", b"2"), (b"c", b"1"), (b"d", b"9")]
    again.vacuum()
    assert items(VersionedTable(spark, f"file://{tmp_path}/t")) == [(b"a", b"2"), (b"c", b"1"), (b"d", b"9")]


def test_crash_before_the_pointer_moves(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.put(b"a", b"1")
    before = items(t)
    monkeypatch.setattr(VersionedTable, "_swap", lambda self, to: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        t.flush()
    monkeypatch.undo()
    assert items(VersionedTable(spark, f"file://{tmp_path}/t")) == before
    # a deleted key stays deleted when compaction dies half-way
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.flush()
    t.delete(b"a")
    t.flush()
    monkeypatch.setattr(VersionedTable, "_swap", lambda self, to: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        t.compact()
    monkeypatch.undo()
    assert items(VersionedTable(spark, f"file://{tmp_path}/t")) == []


def names(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) if path.exists() else []


def test_a_flush_adds_one_run_and_resets_the_log(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.put(b"a", b"1")
    t.flush()
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/runs").rglob("*.parquet")}
    t.put(b"b", b"2")
    t.delete(b"a")
    assert len(names(tmp_path / "t/log")) == 2
    t.flush()
    assert names(tmp_path / "t/log") == [] and t.at.n_runs == 2 and len(names(tmp_path / "t/runs")) == 2
    assert all(p.stat().st_mtime_ns == at for p, at in first.items())  # the older run was not written again
    t.compact()
    t.vacuum()
    assert len(names(tmp_path / "t/runs")) == 1 and len(names(tmp_path / "t/pointer")) == 1
    assert items(VersionedTable(spark, f"file://{tmp_path}/t")) == [(b"b", b"2")]


def test_as_of_is_right_or_refused(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    state = lambda p: sorted((bytes(r.key), bytes(r.value)) for r in t.as_of(p).collect())
    for v in (b"0", b"1"):
        t.put(b"k", v)
    assert state(-1) == [] and state(0) == [(b"k", b"0")] and state(1) == [(b"k", b"1")]
    t.flush()
    t.put(b"k", b"2")
    t.put(b"l", b"3")
    with pytest.raises(PositionGone):
        t.as_of(0)
    assert state(1) == [(b"k", b"1")] and state(2) == [(b"k", b"2")] and len(state(3)) == 2
    t.flush()
    assert state(1) == [(b"k", b"1")] and len(state(3)) == 2
    t.compact()
    with pytest.raises(PositionGone):
        t.as_of(1)
    assert len(state(3)) == 2


def test_a_second_writer_is_refused(spark, tmp_path):
    one = VersionedTable(spark, f"file://{tmp_path}/t")
    two = VersionedTable(spark, f"file://{tmp_path}/t")
    one.put(b"a", b"1")
    with pytest.raises(Conflict):
        two.put(b"b", b"2")
    one.flush()
    with pytest.raises(Conflict):
        two.put(b"b", b"2")
    assert items(VersionedTable(spark, f"file://{tmp_path}/t")) == items(one) == [(b"a", b"1")]


def test_flush_by_batches_and_bytes(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", Options(flush_batches=2))
    t.put(b"a", b"1")
    assert t.at.n_runs == 0
    t.put(b"b", b"1")
    assert t.at.n_runs == 1 and t.at.batches == []
    t = VersionedTable(spark, f"file://{tmp_path}/u", Options(flush_bytes=30))
    t.write([(0, b"a", b"x" * 10), (0, b"b", b"x" * 10)])
    assert t.at.n_runs == 1


def test_replica_record(spark, tmp_path):
    store = ReplicaStore(spark, f"file://{tmp_path}/r")
    assert store.at == Record() and store.log().count() == store.snapshot().count() == 0
    log = spark.createDataFrame([(i, 1 + i // 3, bytearray(b"c%d" % i), None) for i in range(1, 8)], "idx bigint, term bigint, command binary, config array<int>")
    store.save_state(log, term=3, voted_for=2)
    again = ReplicaStore(spark, store.root)
    assert (again.at.term, again.at.voted_for, again.log().count()) == (3, 2, 7)
    snap = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"))], "key binary, value binary")
    again.save_snapshot(snap, 4, 2, again.log(), [1, 2, 3])
    again.tidy()
    last = ReplicaStore(spark, store.root)
    assert [r.idx for r in last.log().orderBy("idx").collect()] == [5, 6, 7] and bytes(last.snapshot().head().value) == b"v"
    assert (last.at.snap_idx, last.at.snap_term, last.at.term, last.at.base_config) == (4, 2, 3, [1, 2, 3])
    with pytest.raises(Conflict):
        store.save_state(term=9)


ENTRIES = [(b"k%03d" % i, 1 if i == 50 else 0, b"v%d" % i) for i in range(100)]


def run_bytes(entries, bits=959, probes=7):
    out = io.BytesIO()
    writer = runs.RunWriter(out, bits, probes)
    for e in entries:
        writer.add(*e)
    writer.close()
    return out.getvalue()


def test_run_bytes_and_lookup():
    data = run_bytes(ENTRIES)
    run = runs.RunReader(io.BytesIO(data), len(data))
    assert list(run.scan()) == ENTRIES and len(run.index) == 7 and run.index[1] == (b"k016", 10 * 15 + 6 * 16)
    assert all(run.get(k) == (kind, v) for k, kind, v in ENTRIES)
    assert [run.get(k) for k in (b"zzz", b"aaa", b"k0505")] == [None] * 3
    assert data[:15] == b"\x04\0\0\0k000\0\x02\0\0\0v0"
    assert data[-8:] == (0x5153535442303031).to_bytes(8, "little")
    big = [(b"%06d" % i, 0, b"x" * (i % 7000)) for i in range(700)]  # entries across read blocks
    data = run_bytes(big)
    assert list(runs.RunReader(io.BytesIO(data), len(data)).scan()) == big
    empty = run_bytes([], 10)
    assert list(runs.RunReader(io.BytesIO(empty), len(empty)).scan()) == []
    with pytest.raises(ValueError, match="ascend"):
        run_bytes([(b"b", 0, b""), (b"a", 0, b"")])


@pytest.mark.parametrize("damage", [lambda d: d[:30], lambda d: d[:-8] + b"12345678", lambda d: d[100:]])
def test_damaged_runs_are_refused(damage):
    data = damage(run_bytes(ENTRIES))
    with pytest.raises(runs.CorruptRun):
        list(runs.RunReader(io.BytesIO(data), len(data)).scan())
    for bad in (b"", b"\x01\0\0\0", b"\x01\0\0\0\x05\0\0\0ab"):
        with pytest.raises(runs.CorruptRun):
            runs.decode_index(bad)


def test_runs_through_spark(spark, tmp_path):
    df = spark.createDataFrame([(r, bytearray(k), kind, bytearray(v)) for r in (3, 4) for k, kind, v in ENTRIES[r:]], "run_seq bigint, key binary, kind tinyint, value binary")
    files = {r.run_seq: r for r in runs.write_runs(df, str(tmp_path / "runs")).collect()}
    assert {n: r.n_keys for n, r in files.items()} == {3: 97, 4: 96}
    data = open(files[3].file, "rb").read()
    assert data == run_bytes(ENTRIES[3:], 930, 7)
    back = runs.read_runs(spark, [r.file for r in files.values()])
    assert back.count() == 193 and back.where("kind = 1").count() == 2
    assert sorted(bytes(r.key) for r in back.where(F.col("file") == files[4].file).collect()) == [k for k, _, _ in ENTRIES[4:]]


def test_many_small_runs_are_few_tasks(spark, tmp_path):
    """Files are read by size, not one task each, and the run's number is in the name."""
    rows = [(r, bytearray(b"%d-%d" % (r, i)), 0, bytearray(b"v")) for r in range(-1, 59) for i in range(20)]
    made = runs.write_runs(spark.createDataFrame(rows, "run_seq bigint, key binary, kind tinyint, value binary"), str(tmp_path / "runs"))
    back = runs.read_runs(spark, [r.file for r in made.collect()])
    assert back.rdd.getNumPartitions() < 10
    got = [(r.run_seq, bytes(r.key)) for r in back.select(runs.run_number(F.col("file")).alias("run_seq"), "key").collect()]
    assert sorted(got) == sorted((r, bytes(k)) for r, k, _, _ in rows)


def test_entries_added_together():
    entries = [(b"", 0, b""), *ENTRIES, (b"l" * 300, 255, b"x" * 70), ("mé".encode(), 1, b"")]
    out = io.BytesIO()
    writer = runs.RunWriter(out, 959, 7)
    for low, high in ((0, 1), (1, 20), (20, 20), (20, len(entries))):
        writer.add_all(*(list(c) for c in zip(*entries[low:high], strict=True)) if low < high else ([], [], []))
    writer.close()
    assert out.getvalue() == run_bytes(entries)
    h1, h2 = runs.hash_all([k for k, _, _ in entries])
    assert list(zip(h1.tolist(), h2.tolist(), strict=True)) == [runs.key_hashes(k) for k, _, _ in entries]
    with pytest.raises(ValueError, match="ascend"):
        runs.RunWriter(io.BytesIO(), 10, 1).add_all([b"b", b"b"], [0, 0], [b"", b""])


def test_all_deleted_compacts_to_an_empty_run(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.write([(0, b"a", b"1"), (1, b"a", b"")])
    t.flush()
    t.compact()
    assert t.runs().count() == 0 and items(t) == []


def test_shell(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert answer(t, "put  k  a   b") == "ok"
    assert answer(t, "get k") == "a b"
    assert answer(t, "del k") == "ok" and answer(t, "get k") == "(not found)"
    assert answer(t, "") == "" and answer(t, "nonsense").startswith("put") and answer(t, "exit") is None


def test_stateful_stream_equals_batch(spark, sf):
    from tidemark.plans.catalog import QUERIES
    from tidemark.streaming import apply

    pytest.importorskip("google.protobuf")
    want = sorted(map(tuple, QUERIES["latest_state"](spark, sf).collect()))
    got = sorted(map(tuple, apply.run_events(spark, sf, apply.keyed_apply_stream).collect()))
    assert got == want
    assert apply.snapshot_due(50, 0) and not apply.snapshot_due(49, 0)
