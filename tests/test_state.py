"""Scenarios of the storage engine on literal logs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import state, storage
from tidemark.operators.ordered import carry_forward, dense_index, global_rank

LOG = "seq bigint, key binary, kind int, value binary"


def log(spark, rows):
    return spark.createDataFrame([(i, bytearray(k), kind, bytearray(v)) for i, (kind, k, v) in enumerate(rows)], LOG)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def model(rows):
    out = {}
    for kind, k, v in rows:
        if kind == 1:
            out.pop(k, None)
        else:
            out[k] = v
    return sorted(out.items())


def test_overwrite_delete_and_miss(spark):
    rows = [(0, b"a", b"1"), (0, b"a", b"2"), (1, b"a", b"")]
    df = log(spark, rows)
    assert state.point_get(df, bytearray(b"a")).count() == 0
    assert [r.kind for r in state.lookup(df, bytearray(b"a")).collect()] == [1]
    assert state.lookup(df, bytearray(b"missing")).count() == 0
    assert pairs(state.items(df.where("seq < 2"))) == [(b"a", b"2")]


def test_put_after_delete_revives_and_absent_deletes_are_legal(spark):
    rows = [(1, b"x", b""), (0, b"a", b"1"), (1, b"a", b""), (0, b"a", b"3")]
    assert pairs(state.items(log(spark, rows))) == [(b"a", b"3")]


def test_keys_sort_as_unsigned_bytes_and_empty_values_live(spark):
    rows = [(0, k, b"") for k in (b"\xff", b"ab", b"a\x00", b"a", b"", b"\x01")]
    assert [k for k, _ in pairs(state.items(log(spark, rows)))] == [b"", b"\x01", b"a", b"a\x00", b"ab", b"\xff"]


def test_unknown_kinds_are_puts(spark):
    assert pairs(state.items(log(spark, [(7, b"a", b"1")]))) == [(b"a", b"1")]


def test_null_position_is_refused(spark):
    df = spark.createDataFrame([(None, bytearray(b"a"), 0, bytearray(b"1"))], LOG)
    with pytest.raises(Exception, match="null seq"):
        state.require_order(df).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1]), st.sampled_from([b"a", b"b", b"c", b"d"]), st.binary(max_size=2)), min_size=1, max_size=30), st.integers(0, 29))
def test_laws(spark, rows, cut):
    df = log(spark, rows)
    want = model(rows)
    assert pairs(state.items(df)) == want
    # repeated and reordered deliveries change nothing
    assert pairs(state.items(df.unionByName(df).orderBy(F.rand(1)))) == want
    # snapshot plus tail, and replay
    assert pairs(state.restore(state.snapshot(df, cut), df, cut).orderBy("key")) == want
    assert pairs(state.replay_until(df, cut).orderBy("key")) == model(rows[: cut + 1])
    # runs, partial compaction with tombstones kept, full compaction
    runs = state.flush_runs(df.withColumn("run_seq", F.floor(F.col("seq") / 7)))
    some = state.merge_runs(runs, 0, 2)
    rest = runs.where("run_seq > 2")
    assert pairs(state.compact(some.select(*runs.columns).unionByName(rest)).orderBy("key")) == want
    full = state.compact(runs)
    again = state.compact(full.withColumn("kind", F.lit(0)))
    assert pairs(again.orderBy("key")) == want


def test_ordered_operators_agree_with_plain_windows(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), i, r.choice([None, None, i])) for i in r.sample(range(100_000), 400)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {(x.k, x.i): (x.pos, x.n) for x in dense_index(df, "k", "i", "pos", "n", bucket=1000).collect()}
    asof = {(x.k, x.i): x.c for x in carry_forward(df, "k", "i", "v", "c", F.lit(-1), bucket=1000).collect()}
    for k in "abc":
        own, last = sorted((i, v) for q, i, v in rows if q == k), -1
        for pos, (i, v) in enumerate(own, 1):
            last = v if v is not None else last
            assert got[k, i] == (pos, len(own)) and asof[k, i] == last
    ranks = sorted((x.i, x.p) for x in global_rank(df, "i", "p", parts=7).collect())
    assert [p for _, p in ranks] == list(range(400))


def test_bloom_sizes_and_golden_hashes(spark):
    from tidemark.functions.hashing import bloom_bits, bloom_positions, bloom_probes, fnv1_32, fnv1a32

    sizes = spark.createDataFrame([(0,), (1,), (16,), (100,), (200,), (1000,), (10000,)], "n bigint")
    m = bloom_bits(F.col("n"))
    assert [tuple(r) for r in sizes.select(m, bloom_probes(F.col("n"), m)).collect()] == [(10, 7), (10, 7), (154, 7), (959, 7), (1918, 7), (9586, 7), (95851, 7)]
    keys = spark.createDataFrame([(bytearray(b"foobar"),), (bytearray(b""),), (bytearray(b"a"),), (bytearray(b"k0"),)], "b binary")
    assert [tuple(r) for r in keys.select(fnv1a32(F.col("b")), fnv1_32(F.col("b"))).collect()] == [(3214735720, 837857890), (2166136261, 2166136261), (3826002220, 84696446), (2537389870, 1719082412)]
    hashes = [f(F.col("b")) for f in (fnv1a32, fnv1_32)]
    at = keys.where("b = X'6b30'").select(bloom_positions(*hashes, F.lit(9586).cast("bigint"), F.lit(7).cast("bigint"))).head()[0]
    assert at == [4428, 702, 8222, 4496, 2430, 8290, 4564]


def test_bloom_has_no_false_negatives(spark):
    rows = spark.range(200).select(F.lit(0).cast("bigint").alias("run_seq"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("seq"), F.lit(0).alias("kind"))
    keys = rows.select("run_seq", "key")
    filters = storage.bloom_build(keys)
    probe = storage.bloom_probe(filters, keys)
    assert probe.where("not maybe").count() == 0 and probe.count() == 200
    absent = spark.range(200, 400).select(F.lit(0).cast("bigint").alias("run_seq"), F.concat(F.lit("k"), "id").alias("key"))
    assert storage.bloom_probe(filters, absent).where("maybe").count() < 30
    # the encoded filter says the same
    again = storage.bloom_decode(storage.bloom_encode(filters))
    same = lambda df: sorted(map(tuple, storage.bloom_probe(df, keys.union(absent)).collect()))
    assert same(again) == same(filters)
    block = bytes(storage.bloom_encode(filters).head().block)
    assert len(block) == 8 + (1918 + 7) // 8 and block[:8] == b"\x07\0\0\0" + (1918).to_bytes(4, "little")


def test_valid_prefix_and_offsets(spark):
    df = log(spark, [(0, b"k%d" % i, b"v") for i in range(6)])
    assert storage.valid_prefix(df, F.col("seq") != 3).count() == 3
    run = df.withColumn("run_seq", F.lit(1))
    assert [r.offset for r in storage.entry_offsets(run).orderBy("key").collect()] == [12 * i for i in range(6)]
