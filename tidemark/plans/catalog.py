"""Named queries over the driver's tables, each with an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import parse_peers, wal_checksum_ok, wal_record
from tidemark.operators import replica, state, storage
from tidemark.sources import adapters as a
from tidemark.session import materialise, scope, table
from tidemark.streaming import apply as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fragments that several oracles share.
LOG = """ev AS (SELECT concat(user_id::VARCHAR, ':', (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 10)::VARCHAR) AS key,
  event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, value, event_id // 1000 AS run_seq FROM events)"""
REPLICAS = "rep AS (SELECT user_id AS group_id, event_type AS peer, max(event_id) AS match_idx FROM events GROUP BY ALL)"
RAFT = """ent AS (SELECT user_id AS group_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  lead_log AS (SELECT group_id, idx, 1 + idx // 10 AS term FROM ent WHERE idx <= n - 3),
  foll_log AS (SELECT group_id, idx, least(1 + idx // 10, 5) AS term FROM ent WHERE idx <= 55)"""
KTH = """kth AS (SELECT group_id, count(*) AS n_peers, max(match_idx) AS last_idx, list_sort(list(match_idx), 'DESC')[(count(*) // 2 + 1)::INT] AS majority_idx FROM rep GROUP BY group_id)"""


def _newest(source: str, where: str = "true") -> str:
    return f"(SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def event_term(idx):
    """Terms of adapter D: a thousand positions each."""
    return F.floor(idx / 1000) + 1


STATE = f"WITH {LOG} SELECT key, seq, value FROM {_newest('ev')} WHERE kind <> 1"


@query("latest_state", STATE)
def latest_state(spark, d):
    return state.items(a.events_log(spark, d).drop("run_seq")).select("key", "seq", "value")


@query("point_get", f"WITH {LOG} SELECT key, seq, value FROM {_newest('ev')} WHERE kind <> 1 AND key = '7:3'")
def point_get(spark, d):
    return state.point_get(a.events_log(spark, d).drop("run_seq"), "7:3").select("key", "seq", "value")


@query(
    "multi_get",
    f"""WITH {LOG}, want AS (SELECT DISTINCT concat(user_id::VARCHAR, ':3') AS key FROM events UNION ALL SELECT 'nope:0')
  SELECT want.key, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS found, s.value FROM want LEFT JOIN (SELECT * FROM {_newest('ev')} WHERE kind <> 1) s ON s.key = want.key""",
)
def multi_get(spark, d):
    users = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":3")).alias("key")).distinct()
    wanted = users.union(spark.createDataFrame([("nope:0",)], "key string"))
    return state.multi_get(a.events_log(spark, d).drop("run_seq"), wanted).select("key", "found", "value")


@query("tombstoned_keys", f"WITH {LOG} SELECT key, seq FROM {_newest('ev')} WHERE kind = 1")
def tombstoned_keys(spark, d):
    return state.tombstoned(a.events_log(spark, d)).select("key", "seq")


RUNS = f"{LOG}, runs AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY run_seq, key ORDER BY seq DESC) = 1)"


@query("per_run_flush", f"WITH {RUNS} SELECT run_seq, key, seq, kind, value FROM runs")
def per_run_flush(spark, d):
    return state.flush_runs(a.events_log(spark, d)).select("run_seq", "key", "seq", "kind", "value")


@query("run_hit_histogram", f"WITH {RUNS} SELECT r AS run_seq, count(*) AS n_keys FROM (SELECT key, max(run_seq) AS r FROM runs GROUP BY key) GROUP BY r")
def run_hit_histogram(spark, d):
    return state.run_hits(state.flush_runs(a.events_log(spark, d)))


@query("compact_full", STATE)
def compact_full(spark, d):
    return state.compact(state.flush_runs(a.events_log(spark, d))).select("key", "seq", "value")


@query("compact_partial_keeps_tombstones", f"WITH {LOG} SELECT key, seq, kind, value, 4::BIGINT AS run_seq FROM {_newest('ev', 'run_seq <= 4')}")
def compact_partial(spark, d):
    return state.merge_runs(state.flush_runs(a.events_log(spark, d)), 0, 4).select("key", "seq", "kind", "value", "run_seq")


@query("replay_until", f"WITH {LOG} SELECT key, seq, value FROM {_newest('ev', 'seq <= 4999')} WHERE kind <> 1")
def replay_until(spark, d):
    return state.replay_until(a.events_log(spark, d), 4999).select("key", "seq", "value")


@query("snapshot_plus_tail", STATE)
def snapshot_plus_tail(spark, d):
    log = a.events_log(spark, d).drop("run_seq")
    return state.restore(state.snapshot(log, 5000), log, 5000).select("key", "seq", "value")


@query("live_log_length", "SELECT user_id AS group_id, count(*) AS last_idx, count(*) // 50 * 50 AS snapshot_idx, count(*) - count(*) // 50 * 50 AS live_entries FROM events GROUP BY user_id")
def live_log_length(spark, d):
    return replica.live_log(a.raft_entries(spark, d))


@query("memtable_bytes", f"WITH {RUNS} SELECT run_seq, sum(octet_length(key::BLOB) + 9)::BIGINT AS n_bytes, count(*) AS n_keys FROM runs GROUP BY run_seq")
def memtable_bytes(spark, d):
    return storage.memtable_bytes(a.events_log(spark, d))


@query("wal_valid_prefix", "SELECT count(*) AS n, max(event_id) AS last_seq FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9e18::BIGINT) FROM events WHERE event_id % 3001 = 3000)")
def wal_valid_prefix(spark, d):
    good = storage.valid_prefix(a.events_log(spark, d), F.col("seq") % 3001 != 3000)
    return good.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def _bytes_sql(text: str) -> str:
    # texts are ASCII, so code points are bytes
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"


def _u32_sql(n: str) -> str:
    return f"[({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255]::BIGINT[]"


def _crc_sql(octets: str) -> str:
    """CRC-32 by the table ``tab``: one list step a byte."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1])), 4294967295)"


CRC = """crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""


@query(
    "wal_crc",
    f"""WITH {LOG}, {CRC}, framed AS (SELECT seq, [kind]::BIGINT[] || {_u32_sql('length(key)')} || {_bytes_sql('key')} || {_u32_sql('length(value::VARCHAR)')} || {_bytes_sql('value::VARCHAR')} AS body FROM ev),
  summed AS (SELECT seq, body, {_crc_sql('body')} AS c FROM framed, crc)
  SELECT seq, upper(array_to_string(list_transform({_u32_sql('c')} || {_u32_sql('len(body)')} || body, lambda b: printf('%02x', b)), '')) AS record, true AS ok FROM summed""",
)
def wal_crc(spark, d):
    record = wal_record(F.col("kind"), F.col("key").cast("binary"), F.col("value").cast("string").cast("binary"))
    framed = a.events_log(spark, d).select("seq", record.alias("_r"))
    return framed.select("seq", F.hex("_r").alias("record"), wal_checksum_ok(F.col("_r")).alias("ok"))


@query("sparse_index", "SELECT key, pos FROM (SELECT url AS key, row_number() OVER (ORDER BY url) - 1 AS pos FROM pages) WHERE pos % 16 = 0")
def sparse_index(spark, d):
    return storage.sparse_index(a.pages_kv(spark, d)).select("key", "pos")


@query(
    "block_lookup",
    """WITH r AS (SELECT url AS key, row_number() OVER (ORDER BY url) - 1 AS pos FROM pages)
  SELECT key, pos, last_value(CASE WHEN pos % 16 = 0 THEN key END IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS anchor FROM r""",
)
def block_lookup(spark, d):
    return storage.block_lookup(a.pages_kv(spark, d)).select("key", "pos", "anchor")


SIZING = """sized AS (SELECT run_seq, n_keys, greatest(8, ceil(-n_keys * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS m_bits FROM (SELECT run_seq, count(*) AS n_keys FROM runs GROUP BY run_seq)),
  filters AS (SELECT *, greatest(1, round(m_bits / n_keys * ln(2)))::BIGINT AS k_probes FROM sized)"""


@query("bloom_sizing", f"WITH {RUNS}, {SIZING} SELECT run_seq, n_keys, m_bits, k_probes FROM filters")
def bloom_sizing(spark, d):
    return storage.bloom_sizing(a.events_log(spark, d))


def _fnv_sql(body: str) -> str:
    # keys are ASCII, so code points are bytes
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: unicode(c)::BIGINT)), lambda h, b: {body})"


BITS = f"""{SIZING}, hashed AS (SELECT run_seq, key, {_fnv_sql('(xor(h, b) * 16777619) & 4294967295')} AS h1, {_fnv_sql('xor((h * 16777619) & 4294967295, b)')} AS h2 FROM runs),
  probes AS (SELECT run_seq, key, ((h1 + i * h2) & 4294967295) % m_bits AS pos FROM hashed JOIN filters USING (run_seq), range(0, 16) t(i) WHERE i < k_probes)"""


@query("bloom_membership", f"WITH {RUNS}, {BITS} SELECT run_seq, count(DISTINCT pos) AS n_bits, (SELECT count(*) FROM runs r WHERE r.run_seq = probes.run_seq) AS n_maybe FROM probes GROUP BY run_seq")
def bloom_membership(spark, d):
    """Set bits per run, and how many of the run's own keys probe as present (all)."""
    with scope(spark) as keep:
        own = materialise(storage.bloom_hashes(state.flush_runs(a.events_log(spark, d)).select("run_seq", "key")), "run-keys")
        filters = materialise(storage.bloom_build(own), "filters")
        bits = filters.groupBy("run_seq").agg(F.sum(F.bitmap_count("bits")).alias("n_bits"))
        maybe = storage.bloom_probe(filters, own).groupBy("run_seq").agg(F.sum(F.col("maybe").cast("bigint")).alias("n_maybe"))
        return keep(bits.join(maybe, "run_seq").select("run_seq", "n_bits", "n_maybe"), "bloom-membership")


@query(
    "commit_index",
    f"""WITH {REPLICAS}, {KTH} SELECT group_id, n_peers, majority_idx, last_idx // 1000 + 1 AS current_term,
  CASE WHEN last_idx // 1000 = majority_idx // 1000 THEN majority_idx ELSE -1 END AS commit_idx FROM kth""",
)
def commit_index(spark, d):
    return replica.commit_index(a.replicas(spark, d), event_term)


@query(
    "config_as_of",
    """SELECT user_id AS group_id, event_id AS idx, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS config_in_force FROM events""",
)
def config_as_of(spark, d):
    return replica.config_as_of(a.config_log(spark, d), F.lit(-1)).select("group_id", "idx", "config_in_force")


COMMITS = f"{REPLICAS}, {KTH}, com AS (SELECT group_id, CASE WHEN last_idx // 1000 = majority_idx // 1000 THEN majority_idx ELSE -1 END AS commit_idx FROM kth)"


@query("committed_prefix", f"WITH {COMMITS} SELECT user_id AS group_id, count(*) FILTER (event_id <= commit_idx) AS n_committed, max(event_id) FILTER (event_id <= commit_idx) AS last_committed FROM events JOIN com ON group_id = user_id GROUP BY user_id")
def committed_prefix(spark, d):
    return replica.committed_prefix(a.config_log(spark, d), replica.commit_index(a.replicas(spark, d), event_term))


@query("pending_config", f"WITH {REPLICAS}, {KTH} SELECT user_id AS group_id, bool_or(event_type = 'signup' AND event_id > majority_idx) AS pending FROM events JOIN kth ON group_id = user_id GROUP BY user_id")
def pending_config(spark, d):
    return replica.pending_config(a.config_log(spark, d), replica.majority_index(a.replicas(spark, d)))


CUT = f"""{RAFT}, cut AS (SELECT e.group_id, coalesce(min(l.idx) FILTER (l.term <> f.term), max(f.idx) + 1) AS c, max(l.idx) AS leader_last, max(f.idx) AS follower_last
  FROM ent e LEFT JOIN lead_log l USING (group_id, idx) LEFT JOIN foll_log f USING (group_id, idx) GROUP BY e.group_id)"""


def _logs(spark, d):
    entries = a.raft_entries(spark, d)
    return a.leader_log(entries), a.follower_log(entries)


@query(
    "log_merge",
    f"""WITH {CUT} SELECT group_id, idx, term, 'kept' AS origin FROM foll_log JOIN cut USING (group_id) WHERE idx < c
  UNION ALL SELECT group_id, idx, term, 'leader' AS origin FROM lead_log JOIN cut USING (group_id) WHERE idx >= c""",
)
def log_merge(spark, d):
    return replica.merge_logs(*_logs(spark, d)).select("group_id", "idx", "term", "origin")


def _asked(leader, at):
    """(prev_idx, prev_term) of the leader's entry at min(end, ``at``)."""
    capped = leader if at is None else leader.where(F.col("idx") <= at)
    return replica.log_ends(capped).select("group_id", F.col("last_idx").alias("prev_idx"), F.col("last_term").alias("prev_term"))


def _reply_sql(limit: str) -> str:
    return f"""WITH {RAFT}, prev AS (SELECT group_id, max(idx) AS prev_idx, max(term) AS prev_term FROM lead_log {limit} GROUP BY group_id),
  fend AS (SELECT group_id, max(idx) AS e FROM foll_log GROUP BY group_id),
  runs AS (SELECT group_id, term, min(idx) AS first_idx FROM foll_log GROUP BY ALL),
  reply AS (SELECT p.group_id, prev_idx, CASE WHEN prev_idx > e THEN -1 WHEN f.term <> prev_term THEN f.term END AS conflict_term,
  CASE WHEN prev_idx > e THEN e + 1 WHEN f.term <> prev_term THEN greatest(first_idx, 1) END AS conflict_idx
  FROM prev p JOIN fend USING (group_id) LEFT JOIN foll_log f ON f.group_id = p.group_id AND f.idx = prev_idx LEFT JOIN runs r ON r.group_id = p.group_id AND r.term = f.term)"""


@query("conflict_index", f"{_reply_sql('')} SELECT group_id, prev_idx, conflict_term, conflict_idx FROM reply")
def conflict_index(spark, d):
    leader, follower = _logs(spark, d)
    return replica.conflict_reply(_asked(leader, None), follower)


@query(
    "next_index_backup",
    f"""{_reply_sql('WHERE idx <= 54')} SELECT r.group_id, conflict_term, conflict_idx, greatest(1, coalesce(
  (SELECT max(idx) + 1 FROM lead_log l WHERE l.group_id = r.group_id AND l.term = r.conflict_term), conflict_idx)) AS next_idx FROM reply r WHERE conflict_idx IS NOT NULL""",
)
def next_index_backup(spark, d):
    leader, follower = _logs(spark, d)
    return replica.next_index(replica.conflict_reply(_asked(leader, 54), follower), leader)


@query(
    "vote_tally",
    f"""WITH {REPLICAS} SELECT x.group_id, x.peer AS candidate, count(*) FILTER (y.match_idx <= x.match_idx) AS votes, count(*) FILTER (y.match_idx <= x.match_idx) > count(*) // 2 AS wins
  FROM rep x JOIN rep y ON x.group_id = y.group_id GROUP BY x.group_id, x.peer""",
)
def vote_tally(spark, d):
    return replica.vote_tally(a.replicas(spark, d))


@query(
    "up_to_date_pairs",
    f"""WITH {RAFT}, l AS (SELECT group_id, max(term) AS t, max(idx) AS i FROM lead_log GROUP BY group_id), f AS (SELECT group_id, max(term) AS t, max(idx) AS i FROM foll_log GROUP BY group_id)
  SELECT group_id, (coalesce(l.t, 0), coalesce(l.i, 0)) >= (coalesce(f.t, 0), coalesce(f.i, 0)) AS grants FROM l FULL JOIN f USING (group_id)""",
)
def up_to_date_pairs(spark, d):
    return replica.up_to_date(*_logs(spark, d))


@query("replicate_mode", f"WITH {REPLICAS}, {KTH} SELECT group_id, peer, CASE WHEN match_idx < majority_idx THEN 'snapshot' ELSE 'entries' END AS mode FROM rep JOIN kth USING (group_id)")
def replicate_mode(spark, d):
    progress = a.replicas(spark, d)
    return replica.replicate_mode(progress, replica.majority_index(progress))


@query("replica_lag", f"WITH {REPLICAS} SELECT group_id, peer, match_idx, max(match_idx) OVER (PARTITION BY group_id) - match_idx AS lag FROM rep")
def replica_lag(spark, d):
    return replica.replica_lag(a.replicas(spark, d))


@query(
    "node_stats",
    f"""WITH {COMMITS}, n AS (SELECT user_id AS group_id, count(*) AS c FROM events GROUP BY user_id)
  SELECT group_id, commit_idx AS applied_idx, c - c // 50 * 50 AS live_entries, c // 50 * 50 AS snapshot_idx FROM com JOIN n USING (group_id)""",
)
def node_stats(spark, d):
    applied = replica.commit_index(a.replicas(spark, d), event_term).select("group_id", F.col("commit_idx").alias("applied_idx"))
    return applied.join(replica.live_log(a.raft_entries(spark, d)), "group_id").select("group_id", "applied_idx", "live_entries", "snapshot_idx")


@query("apply_agreement", f"WITH {RAFT} SELECT group_id, idx, l.term AS leader_term, f.term AS follower_term FROM lead_log l JOIN foll_log f USING (group_id, idx) WHERE l.term <> f.term")
def apply_agreement(spark, d):
    return replica.disagreements(*_logs(spark, d)).select("group_id", "idx", "leader_term", "follower_term")


@query("leaders_per_term", "SELECT event_id // 1000 + 1 AS term, count(DISTINCT user_id) AS n_leaders FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def leaders_per_term(spark, d):
    claims = table(spark, d, "events").where(F.col("event_type") == "purchase").select(event_term(F.col("event_id")).alias("term"), F.col("user_id").alias("node"))
    return replica.leaders_per_term(claims)


LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


@query(
    "line_latest",
    f"""SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in LINE_ORDER)}) = 1""",
)
def line_latest(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER)
    return state.latest(lines, ("l_orderkey", "l_linenumber"), LINE_ORDER)


@query("range_scan", "SELECT url AS key, max(page_id) AS seq FROM pages WHERE url >= 'https://m' AND url < 'https://t' GROUP BY url")
def range_scan(spark, d):
    return state.range_scan(a.pages_kv(spark, d), "https://m", "https://t").select("key", "seq")


@query("shard_route", f"WITH {LOG}, {CRC} SELECT key, ({_crc_sql(_bytes_sql('key'))}) % 16 AS shard FROM {_newest('ev')} q, crc WHERE kind <> 1")
def shard_route(spark, d):
    return state.latest_state(a.events_log(spark, d)).select("key", state.shard_of(F.col("key"), 16).alias("shard"))


@query("apply_stream", STATE)
def apply_stream(spark, d):
    return streaming.run_events(spark, d)


@query("flush_stream", STATE)
def flush_stream(spark, d):
    return streaming.run_events(spark, d, streaming.flush_stream)


@query("replica_divergence", f"WITH {LOG}, x AS (SELECT key, value FROM {_newest('ev', 'seq <= 4999')} WHERE kind <> 1), y AS (SELECT key, value FROM {_newest('ev')} WHERE kind <> 1) (SELECT key, value, 'left' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) UNION ALL (SELECT key, value, 'right' AS side FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x))")
def replica_divergence(spark, d):
    log = a.events_log(spark, d)
    return state.diff_state(state.replay_until(log, 4999).select("key", "value"), state.latest_state(log).select("key", "value"))


# -- decisions of the replicated log, on requests and replies made of events ----------
@query(
    "grant_votes",
    """WITH asked AS (SELECT event_id AS arrival, user_id % 50 AS voter, 1 + event_id // 2000 AS term, user_id % 5 AS candidate, event_id % 7 AS lt, event_id % 100 AS li FROM events WHERE event_type = 'click'),
  own AS (SELECT DISTINCT user_id % 50 AS voter, 2 AS own_term, CASE WHEN user_id % 2 = 0 THEN 3 ELSE -1 END AS voted_for FROM events),
  e AS (SELECT asked.*, term >= greatest(max(term) OVER (PARTITION BY voter ORDER BY arrival), own_term) AND (lt, li) >= (3, 50) AND (term > own_term OR voted_for IN (-1, candidate)) AS eligible FROM asked JOIN own USING (voter))
  SELECT arrival, voter, term, candidate, coalesce(eligible AND candidate = arg_min(candidate, arrival) FILTER (eligible) OVER (PARTITION BY voter, term), false) AS granted FROM e""",
)
def grant_votes(spark, d):
    events = table(spark, d, "events")
    voter, user = (F.col("user_id") % 50).alias("voter"), F.col("user_id")
    asked = events.where("event_type = 'click'").select(
        F.col("event_id").alias("arrival"), voter, (1 + F.floor(F.col("event_id") / 2000)).alias("term"),
        (user % 5).alias("candidate"), (F.col("event_id") % 7).alias("last_term"), (F.col("event_id") % 100).alias("last_idx"),
    )
    voted = F.when(user % 2 == 0, 3).otherwise(-1)
    voters = events.select(voter, F.lit(2).alias("term"), voted.alias("voted_for"), F.lit(3).alias("last_term"), F.lit(50).alias("last_idx")).distinct()
    return replica.grant_votes(asked, voters)


@query(
    "install_snapshot",
    f"""WITH {RAFT}, cut AS (SELECT DISTINCT group_id, 20 AS snap_idx, 3 + group_id % 2 AS snap_term FROM ent)
  SELECT group_id, idx, term FROM foll_log f JOIN cut USING (group_id) WHERE idx > snap_idx AND EXISTS (SELECT 1 FROM foll_log x WHERE x.group_id = f.group_id AND x.idx = snap_idx AND x.term = snap_term)""",
)
def install_snapshot(spark, d):
    _, follower = _logs(spark, d)
    groups = table(spark, d, "events").select(F.col("user_id").alias("group_id")).distinct()
    boundary = groups.select("group_id", F.lit(20).alias("snap_idx"), (3 + F.col("group_id") % 2).alias("snap_term"))
    return replica.install_snapshot(follower, boundary).select("group_id", "idx", "term")


def _compacted(spark, d):
    boundary = replica.majority_index(a.replicas(spark, d)).select("group_id", F.col("majority_idx").alias("snap_idx"))
    base = boundary.select("group_id", F.lit(-1).cast("bigint").alias("base_config"))
    return replica.compact_log(a.config_log(spark, d), boundary, base)


@query("compact_log", f"WITH {REPLICAS}, {KTH} SELECT user_id AS group_id, event_id AS idx, CASE WHEN event_type = 'signup' THEN event_id END AS config FROM events JOIN kth ON group_id = user_id WHERE event_id > majority_idx")
def compact_log(spark, d):
    return _compacted(spark, d)[0]


@query("folded_config", f"WITH {REPLICAS}, {KTH} SELECT user_id AS group_id, coalesce(max(event_id) FILTER (event_type = 'signup' AND event_id <= majority_idx), -1) AS base_config FROM events JOIN kth ON group_id = user_id GROUP BY user_id")
def folded_config(spark, d):
    return _compacted(spark, d)[1]


@query(
    "acknowledge",
    f"""WITH {REPLICAS}, ack AS (SELECT user_id AS group_id, event_type AS peer, max(event_id + event_id % 5) AS m FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
  SELECT group_id, peer, greatest(match_idx, coalesce(m, match_idx)) AS match_idx, greatest(match_idx, coalesce(m, match_idx)) + 1 AS next_idx FROM rep LEFT JOIN ack USING (group_id, peer)""",
)
def acknowledge(spark, d):
    event = F.col("event_id")
    acks = table(spark, d, "events").select(F.col("user_id").alias("group_id"), F.col("event_type").alias("peer"), event.alias("prev_idx"), (event % 5).alias("n_entries"), (event % 3 == 0).alias("success"))
    return replica.acknowledge(a.replicas(spark, d), acks)


@query(
    "acknowledge_snapshot",
    f"""WITH {REPLICAS}, ack AS (SELECT user_id AS group_id, event_type AS peer, max(event_id // 50 * 50 + 50) AS m FROM events WHERE event_id % 4 = 0 GROUP BY ALL)
  SELECT group_id, peer, greatest(match_idx, coalesce(m, 0)) AS match_idx, greatest(match_idx, coalesce(m, 0)) + 1 AS next_idx FROM rep LEFT JOIN ack USING (group_id, peer)""",
)
def acknowledge_snapshot(spark, d):
    event = F.col("event_id")
    acks = table(spark, d, "events").where(event % 4 == 0).select(F.col("user_id").alias("group_id"), F.col("event_type").alias("peer"), (F.floor(event / 50) * 50 + 50).alias("snap_idx"))
    return replica.acknowledge_snapshot(a.replicas(spark, d), acks)


@query("follower_commit", f"WITH {REPLICAS}, {KTH} SELECT group_id, peer, match_idx AS last_idx, majority_idx AS leader_commit, greatest(match_idx // 2, CASE WHEN majority_idx > match_idx // 2 THEN least(majority_idx, match_idx) ELSE 0 END) AS commit_idx FROM rep JOIN kth USING (group_id)")
def follower_commit(spark, d):
    progress = a.replicas(spark, d)
    joined = progress.join(replica.majority_index(progress).select("group_id", "majority_idx"), "group_id")
    status = joined.select("group_id", "peer", F.col("match_idx").alias("last_idx"), F.col("majority_idx").alias("leader_commit"), F.floor(F.col("match_idx") / 2).alias("commit_idx"))
    return replica.follower_commit(status)


@query(
    "propose",
    f"""WITH {RAFT}, ends AS (SELECT group_id, max(idx) AS e FROM foll_log GROUP BY group_id)
  SELECT user_id AS group_id, event_id AS ord, CASE WHEN user_id % 3 > 0 THEN e + row_number() OVER (PARTITION BY user_id ORDER BY event_id) ELSE -1 END AS idx, 9 AS term, user_id % 3 > 0 AS accepted
  FROM events JOIN ends ON group_id = user_id WHERE event_type = 'purchase'""",
)
def propose(spark, d):
    _, follower = _logs(spark, d)
    group = F.col("user_id").alias("group_id")
    commands = table(spark, d, "events").where("event_type = 'purchase'").select(group, F.col("event_id").alias("ord"))
    role = F.when(F.col("user_id") % 3 > 0, "Leader").otherwise("Follower")
    status = table(spark, d, "events").select(group, role.alias("role"), F.lit(9).alias("term")).distinct()
    return replica.propose(follower, commands, status)


@query("to_apply", "SELECT user_id AS group_id, event_id AS idx FROM events WHERE event_id BETWEEN 251 AND 3000 AND event_type <> 'signup'")
def to_apply(spark, d):
    return replica.to_apply(a.config_log(spark, d), 100, 3000, 250).select("group_id", "idx")


@query(
    "entry_offsets",
    f"""WITH {RUNS} SELECT run_seq, key, coalesce(sum(octet_length(key::BLOB) + octet_length(seq::VARCHAR::BLOB) + 9) OVER (PARTITION BY run_seq ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM runs""",
)
def entry_offsets(spark, d):
    runs = state.flush_runs(a.events_log(spark, d)).select("run_seq", "key", F.col("seq").cast("string").alias("value"))
    return storage.entry_offsets(runs).select("run_seq", "key", "offset")


@query("waiters_done", f"WITH {REPLICAS}, {KTH} SELECT user_id AS node, event_id AS idx FROM events JOIN kth ON group_id = user_id WHERE event_id <= majority_idx")
def waiters_done(spark, d):
    waiters = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("idx"))
    status = replica.majority_index(a.replicas(spark, d)).select(F.col("group_id").alias("node"), F.col("majority_idx").alias("applied_idx"))
    return replica.waiters_done(waiters, status)


@query(
    "refresh_progress",
    f"""WITH {REPLICAS}, {RAFT}, ends AS (SELECT group_id, max(idx) AS last_idx FROM foll_log GROUP BY group_id),
  members AS (SELECT group_id, peer FROM rep WHERE peer <> 'error' UNION ALL SELECT DISTINCT group_id, 'learner' FROM rep)
  SELECT m.group_id, m.peer, coalesce(match_idx, 0) AS match_idx, coalesce(match_idx + 1, coalesce(last_idx, 0) + 1) AS next_idx FROM members m LEFT JOIN rep USING (group_id, peer) LEFT JOIN ends ON ends.group_id = m.group_id""",
)
def refresh_progress(spark, d):
    progress = a.replicas(spark, d).withColumn("next_idx", F.col("match_idx") + 1)
    learners = progress.select("group_id", F.lit("learner").alias("peer")).distinct()
    members = progress.where("peer <> 'error'").select("group_id", "peer").union(learners)
    return replica.refresh_progress(progress, members, replica.log_ends(_logs(spark, d)[1]))


STATUS = """st AS (SELECT user_id AS node, 1 + min(event_id) % 5 AS term, CASE WHEN user_id % 4 = 0 THEN 'Leader' WHEN user_id % 4 = 1 THEN 'Candidate' ELSE 'Follower' END AS role,
  user_id % 3 AS voted_for, user_id % 5 = 0 AS down, max(event_id) % 400 AS elapsed_ms, 250 + user_id % 200 AS timeout_ms, CASE WHEN user_id % 7 = 0 THEN []::BIGINT[] ELSE [user_id, user_id + 1] END AS config FROM events GROUP BY user_id)"""


def _status(spark, d):
    """node, term, role, voted_for, down, elapsed_ms, timeout_ms, config: a node per user."""
    user = F.col("user_id")
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("_l"), F.max("event_id").alias("_u"))
    role = F.when(user % 4 == 0, 2).when(user % 4 == 1, 1).otherwise(0)
    members = F.when(user % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(user, user + 1))
    return per.select(
        user.alias("node"), (1 + F.col("_l") % 5).alias("term"), replica.role_text(role).alias("role"), (user % 3).alias("voted_for"), (user % 5 == 0).alias("down"),
        (F.col("_u") % 400).alias("elapsed_ms"), (250 + user % 200).alias("timeout_ms"), members.alias("config"),
    )


@query("step_down", f"WITH {STATUS}, seen AS (SELECT user_id AS node, max(event_id % 8) AS t FROM events GROUP BY ALL) SELECT node, greatest(term, t) AS term, CASE WHEN t > term THEN 'Follower' ELSE role END AS role, CASE WHEN t > term THEN -1 ELSE voted_for END AS voted_for FROM st JOIN seen USING (node)")
def step_down(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("node"), (F.col("event_id") % 8).alias("term"))
    return replica.step_down(_status(spark, d).select("node", "term", "role", "voted_for"), seen)


@query("election_due", f"WITH {STATUS} SELECT node, term + 1 AS term, node AS voted_for FROM st WHERE role <> 'Leader' AND list_contains(config, node) AND elapsed_ms >= timeout_ms")
def election_due(spark, d):
    return replica.election_due(_status(spark, d))


@query("find_leader", f"WITH {STATUS} SELECT coalesce(min(node), -1) AS leader FROM st WHERE role = 'Leader' AND NOT down")
def find_leader(spark, d):
    return replica.find_leader(_status(spark, d))


@query("reachable", "SELECT event_id, user_id % 10 AS src, event_id % 10 AS dst FROM events WHERE user_id % 10 NOT IN (3, 7) AND event_id % 10 NOT IN (3, 7)")
def reachable(spark, d):
    traffic = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("src"), (F.col("event_id") % 10).alias("dst"))
    return replica.reachable(traffic, spark.createDataFrame([(3,), (7,)], "node bigint"))


@query("read_from", f"WITH {LOG}, n AS (SELECT max(seq) - 50 AS a FROM ev WHERE kind = 1) SELECT key, seq, value FROM (SELECT ev.* FROM ev, n WHERE seq <= a QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind <> 1")
def read_from(spark, d):
    """Node 1 lags: it has applied up to fifty positions before the last delete."""
    log = a.events_log(spark, d).drop("run_seq")
    status = log.groupBy(F.col("kind").alias("node")).agg((F.max("seq") - 50).alias("applied_idx"))
    return replica.read_from(log, status, 1).select("key", "seq", "value")


@query("applied_nodes", "SELECT event_id % 1000 AS idx, count(DISTINCT user_id) AS n_nodes, min(event_type) = max(event_type) AS agree FROM events GROUP BY ALL")
def applied_nodes(spark, d):
    return replica.applied_nodes(table(spark, d, "events").select((F.col("event_id") % 1000).alias("idx"), F.col("user_id").alias("node"), F.col("event_type").alias("command")))


@query("snapshot_epochs", "SELECT user_id AS group_id, event_id AS idx, event_id // 50 AS epoch FROM events WHERE event_id % 50 = 0 AND event_type <> 'signup'")
def snapshot_epochs(spark, d):
    return replica.snapshot_epochs(a.config_log(spark, d))


@query("boot", f"WITH {STATUS} SELECT node, term, voted_for, 'Follower' AS role, elapsed_ms AS snap_idx, term - 1 AS snap_term, elapsed_ms AS commit_idx, elapsed_ms AS applied_idx FROM st")
def boot(spark, d):
    status = _status(spark, d)
    return replica.boot(status.select("node", "term", "voted_for", F.col("elapsed_ms").alias("snap_idx"), (F.col("term") - 1).alias("snap_term")))


@query("config_change", f"WITH {STATUS} SELECT node, array_to_string(list_filter(n, lambda x: NOT list_contains(o, x)), ',') AS added, array_to_string(list_filter(o, lambda x: NOT list_contains(n, x)), ',') AS removed, len(list_filter(n, lambda x: NOT list_contains(o, x))) + len(list_filter(o, lambda x: NOT list_contains(n, x))) <= 1 AS one_step FROM (SELECT node, config AS o, CASE WHEN node % 2 = 0 THEN [node, node + 2] ELSE [node] END AS n FROM st)")
def config_change(spark, d):
    node = F.col("node")
    new = F.when(node % 2 == 0, F.array(node, node + 2)).otherwise(F.array(node))
    change = replica.config_change(F.col("config"), new)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _status(spark, d).select("node", change.alias("c")).select("node", text(F.col("c.added")).alias("added"), text(F.col("c.removed")).alias("removed"), "c.one_step")


@query("peers", "SELECT DISTINCT user_id AS node, array_to_string([user_id % 7 + 1, user_id % 7 + 10], ',') AS ids, 'host' || (user_id % 7 + 10)::VARCHAR || ':7000' AS last_address FROM events")
def peers(spark, d):
    one, two = F.col("user_id") % 7 + 1, F.col("user_id") % 7 + 10
    part = lambda i: F.concat(i.cast("string"), F.lit("=host"), i.cast("string"), F.lit(":7000"))
    parsed = table(spark, d, "events").select(F.col("user_id").alias("node")).distinct().withColumnRenamed("node", "user_id")
    parsed = parsed.select(F.col("user_id").alias("node"), parse_peers(F.concat_ws(",", part(two), part(one))).alias("p"), two.cast("string").alias("last"))
    return parsed.select("node", F.array_join(replica.peer_order(F.col("p")).cast("array<string>"), ",").alias("ids"), F.element_at("p", F.col("last")).alias("last_address"))


@query(
    "routed_writes",
    f"""WITH {REPLICAS}, nodes AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY peer) - 1 AS node, match_idx FROM rep),
  lead_node AS (SELECT group_id, min(node) AS node, arg_min(match_idx, node) AS last_idx FROM nodes WHERE (group_id + node) % 3 = 0 AND (group_id + node) % 4 > 0 GROUP BY group_id),
  sent AS (SELECT user_id AS group_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'purchase')
  SELECT s.group_id, ord, coalesce(node, -1) AS node, coalesce(last_idx + r, -1) AS idx, CASE WHEN node IS NULL THEN 'not_leader' WHEN (last_idx + r) % 5 > 0 AND (last_idx + r) % 5 * 1000 <= 3000 THEN 'ok' ELSE 'timeout' END AS outcome FROM sent s LEFT JOIN lead_node USING (group_id)""",
)
def routed_writes(spark, d):
    """An index is applied after its remainder by five in seconds; multiples of five never."""
    from pyspark.sql import Window

    nodes = a.replicas(spark, d).withColumn("node", F.row_number().over(Window.partitionBy("group_id").orderBy("peer")) - 1)
    turn = F.col("group_id") + F.col("node")
    role = F.when(turn % 3 == 0, "Leader").otherwise("Follower")
    status = nodes.select("group_id", "node", role.alias("role"), (turn % 4 == 0).alias("down"), F.lit(1).alias("term"), F.col("match_idx").alias("last_idx"))
    commands = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("ord"), F.lit(3000).alias("waits_ms"))
    reach = commands.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    idx = F.explode(F.sequence(F.col("last_idx") + 1, F.col("last_idx") + F.col("_n")))
    applied = status.join(reach, "group_id").select("group_id", "node", idx.alias("idx")).where(F.col("idx") % 5 > 0)
    return replica.routed_writes(commands, status, applied.withColumn("at_ms", F.col("idx") % 5 * 1000))


# -- the durable table and its files ------------------------------------------------------
def _filled(spark, d, cuts, then) -> DataFrame:
    """Events appended in ranges of positions; ``then`` acts on the table
    after each.  key, seq of what the table's reader returns."""
    from tidemark.operators.table import VersionedTable
    from tidemark.session import remove, scratch_path

    root = scratch_path(spark, "table")
    log = a.events_log(spark, d).select("seq", F.col("key").cast("binary").alias("key"), "kind", F.col("seq").cast("string").cast("binary").alias("value"))
    t = VersionedTable(spark, root)
    with scope(spark) as keep:
        for low, high in zip([0, *cuts], [*cuts, 1 << 62], strict=True):
            t.append(log.where((F.col("seq") >= low) & (F.col("seq") < high)).withColumn("seq", F.col("seq") - low))
            then(t)
        found = keep(_decoded(VersionedTable(spark, root).items()), "table")
        remove(spark, root)
    return found


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("bigint").alias("seq"))


KEYS = f"WITH {LOG} SELECT key, seq FROM {_newest('ev')} WHERE kind <> 1"


@query("flush_then_read", KEYS)
def flush_then_read(spark, d):
    """Two runs and a tail that no run holds."""
    return _filled(spark, d, (400, 700), lambda t: t.flush() if t.at.n_runs < 2 else None)


@query("reopen_after_compaction", KEYS)
def reopen_after_compaction(spark, d):
    def settle(t):
        t.flush()
        t.compact()
        t.vacuum()

    return _filled(spark, d, (300, 600), settle)


@query("as_of_run_end", f"WITH {LOG} SELECT key, seq FROM {_newest('ev', 'seq < 500')} WHERE kind <> 1")
def as_of_run_end(spark, d):
    """The state at the first run's end, read after a second flush."""
    from tidemark.session import remove, scratch_path

    found = []

    def look(t):
        t.flush()
        if t.at.n_runs == 2:
            path = scratch_path(spark, "as-of")
            rows = _decoded(t.as_of(499))
            rows.write.parquet(path)
            found.append((path, rows.schema))

    _filled(spark, d, (500,), look)
    path, schema = found[0]
    with scope(spark) as keep:
        out = keep(spark.read.schema(schema).parquet(path), "as-of")
        remove(spark, path)
    return out


@query("run_files", f"WITH {RUNS} SELECT run_seq, key, kind, seq FROM runs")
def run_files(spark, d):
    """Every run written in the byte format of runs and read back."""
    from tidemark.session import remove, scratch_path
    from tidemark.sources import runs as files

    folder = scratch_path(spark, "run-bytes")
    flushed = state.flush_runs(a.events_log(spark, d)).select("run_seq", F.col("key").cast("binary").alias("key"), "kind", F.col("seq").cast("string").cast("binary").alias("value"))
    with scope(spark) as keep:
        made = files.write_runs(flushed, folder)
        back = files.read_runs(spark, [r.file for r in made.select("file").collect()])
        out = keep(back.select(files.run_number(F.col("file")).alias("run_seq"), F.col("key").cast("string").alias("key"), F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").cast("bigint").alias("seq")), "run-files-read")
        remove(spark, folder)
    return out


@query(
    "bloom_codec",
    f"""WITH {RUNS}, {BITS}, octets AS (SELECT run_seq, pos // 8 AS i, sum(1 << (pos % 8)::INT) AS v FROM (SELECT DISTINCT run_seq, pos FROM probes) GROUP BY ALL),
  every AS (SELECT run_seq, m_bits, k_probes, unnest(range((m_bits + 7) // 8)) AS i FROM filters)
  SELECT run_seq, upper(array_to_string(list_transform({_u32_sql('any_value(k_probes)')} || {_u32_sql('any_value(m_bits)')}, lambda b: printf('%02x', b)), '') || string_agg(printf('%02x', coalesce(v, 0)::BIGINT), '' ORDER BY i)) AS block
  FROM every LEFT JOIN octets USING (run_seq, i) GROUP BY run_seq""",
)
def bloom_codec(spark, d):
    keys = state.flush_runs(a.events_log(spark, d)).select("run_seq", "key")
    filters = storage.bloom_decode(storage.bloom_encode(storage.bloom_build(keys)))
    return storage.bloom_encode(filters).select("run_seq", F.hex("block").alias("block"))
