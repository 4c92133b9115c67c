"""Decision rules of the replicated log on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replica


def logs(spark, terms, group=1):
    return spark.createDataFrame([(group, i, t) for i, t in enumerate(terms, 1)], "group_id int, idx bigint, term bigint")


def merged(spark, leader, follower):
    rows = replica.merge_logs(logs(spark, leader), logs(spark, follower)).orderBy("idx").collect()
    return [r.term for r in rows]


@pytest.mark.parametrize("matches,want", [([5], 5), ([5, 3], 3), ([9, 7, 5], 7), ([9, 7, 5, 1], 5), ([9, 8, 7, 2, 1], 7)])
def test_majority_index(spark, matches, want):
    df = spark.createDataFrame([(1, str(i), m) for i, m in enumerate(matches)], "group_id int, peer string, match_idx bigint")
    assert replica.majority_index(df).head().majority_idx == want


def test_only_current_terms_commit(spark):
    df = spark.createDataFrame([(1, "a", 2500), (1, "b", 1999), (1, "c", 3)], "group_id int, peer string, match_idx bigint")
    term = lambda i: F.floor(i / 1000) + 1
    assert replica.commit_index(df, term).head().commit_idx == -1
    df = df.withColumn("match_idx", F.when(F.col("peer") == "b", 2001).otherwise(F.col("match_idx")))
    assert replica.commit_index(df, term).head().commit_idx == 2001


def test_merge(spark):
    assert merged(spark, [1, 1, 2], [1, 1]) == [1, 1, 2]
    assert merged(spark, [1, 1], [1, 1, 1]) == [1, 1, 1]  # a prefix match does not cut
    assert merged(spark, [1, 2, 2], [1, 1, 1, 1]) == [1, 2, 2]
    assert merged(spark, [1], []) == [1]


def test_conflicts_and_backup(spark):
    follower = logs(spark, [1, 1, 2, 2, 2])
    prev = spark.createDataFrame([(1, 9, 3)], "group_id int, prev_idx bigint, prev_term bigint")
    assert tuple(replica.conflict_reply(prev, follower).head())[2:] == (-1, 6)
    prev = spark.createDataFrame([(1, 4, 3)], "group_id int, prev_idx bigint, prev_term bigint")
    reply = replica.conflict_reply(prev, follower)
    assert tuple(reply.head())[2:] == (2, 3)
    assert tuple(replica.conflict_reply(prev, follower, included=3).head())[2:] == (2, 4)
    assert replica.next_index(reply, logs(spark, [1, 2, 3, 3])).head().next_idx == 3  # after its own last of term 2
    assert replica.next_index(reply, logs(spark, [1, 1, 3, 3])).head().next_idx == 3  # the conflict's index
    prev = spark.createDataFrame([(1, 4, 2)], "group_id int, prev_idx bigint, prev_term bigint")
    assert replica.conflict_reply(prev, follower).head().conflict_idx is None


def test_votes(spark):
    voters = spark.createDataFrame([(1, 3, -1, 2, 5), (2, 3, 9, 2, 5)], "voter int, term bigint, voted_for int, last_term bigint, last_idx bigint")
    ask = [(1, 1, 2, 7, 9, 9), (2, 1, 3, 7, 2, 4), (3, 1, 3, 8, 2, 5), (4, 1, 3, 7, 3, 1), (5, 1, 4, 7, 3, 1), (6, 2, 3, 7, 9, 9), (7, 2, 3, 9, 2, 6), (8, 1, 3, 8, 9, 9)]
    requests = spark.createDataFrame(ask, "arrival int, voter int, term bigint, candidate int, last_term bigint, last_idx bigint")
    got = [r.granted for r in replica.grant_votes(requests, voters).orderBy("arrival").collect()]
    assert got == [False, False, True, False, True, False, True, False]


def test_snapshot_install(spark):
    log = logs(spark, [1, 1, 2, 2])
    at = lambda i, t: spark.createDataFrame([(1, i, t)], "group_id int, snap_idx bigint, snap_term bigint")
    assert [r.idx for r in replica.install_snapshot(log, at(2, 1)).orderBy("idx").collect()] == [3, 4]
    assert replica.install_snapshot(log, at(2, 7)).count() == 0


def test_acks_commits_configs_and_traffic(spark):
    progress = spark.createDataFrame([(1, "a", 4), (1, "b", 2)], "group_id int, peer string, match_idx bigint")
    acks = spark.createDataFrame([(1, "a", 1, 2, True), (1, "b", 2, 5, True), (1, "b", 9, 9, False)], "group_id int, peer string, prev_idx bigint, n_entries bigint, success boolean")
    assert sorted((r.peer, r.match_idx, r.next_idx) for r in replica.acknowledge(progress, acks).collect()) == [("a", 4, 5), ("b", 7, 8)]
    status = spark.createDataFrame([(5, 3, 9), (5, 9, 7), (2, 1, 9)], "leader_commit bigint, commit_idx bigint, last_idx bigint")
    assert [r.commit_idx for r in replica.follower_commit(status).collect()] == [5, 9, 2]
    change = spark.createDataFrame([([1, 2, 3], [1, 2, 4])], "o array<int>, n array<int>").select(replica.config_change(F.col("o"), F.col("n")).alias("c")).head().c
    assert (change.added, change.removed, change.one_step) == ([4], [3], False)
    nodes = spark.createDataFrame([(0, "Leader", True), (2, "Leader", False), (1, "Follower", False)], "node int, role string, down boolean")
    assert replica.find_leader(nodes).head().leader == 2
    assert replica.find_leader(nodes.where("node <> 2")).head().leader == -1
    traffic = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src int, dst int")
    assert [tuple(r) for r in replica.reachable(traffic, spark.createDataFrame([(0,)], "node int")).collect()] == [(1, 2)]


def test_due_entries(spark):
    log = spark.createDataFrame([(i, [1] if i == 4 else None) for i in range(1, 8)], "idx bigint, config array<int>")
    assert [r.idx for r in replica.to_apply(log, 2, 6, 2).orderBy("idx").collect()] == [3, 5, 6]


def test_propose_elect_and_step_down(spark):
    log = logs(spark, [1, 1])
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "group_id int, ord int")
    status = spark.createDataFrame([(1, "Leader", 4), (2, "Follower", 4)], "group_id int, role string, term bigint")
    assert sorted((r.group_id, r.idx, r.accepted) for r in replica.propose(log, asked, status).collect()) == [(1, 3, True), (1, 4, True), (2, -1, False)]
    nodes = [(0, "Leader", 3, 0, [0, 1], 900, 300), (1, "Follower", 3, 0, [0, 1], 300, 300), (2, "Follower", 3, -1, [], 900, 300), (3, "Follower", 3, -1, [3], 10, 300)]
    df = spark.createDataFrame(nodes, "node int, role string, term bigint, voted_for int, config array<int>, elapsed_ms int, timeout_ms int")
    assert [tuple(r) for r in replica.election_due(df).collect()] == [(1, 4, 1)]
    seen = spark.createDataFrame([(0, 5), (1, 2)], "node int, term bigint")
    got = {r.node: (r.role, r.term, r.voted_for) for r in replica.step_down(df, seen).collect()}
    assert got[0] == ("Follower", 5, -1) and got[1] == ("Follower", 3, 0) and got[2][1] == 3


def test_trackers(spark):
    progress = spark.createDataFrame([(1, "a", 4, 5), (1, "b", 2, 3)], "group_id int, peer string, match_idx bigint, next_idx bigint")
    acks = spark.createDataFrame([(1, "b", 9), (1, "a", 1)], "group_id int, peer string, snap_idx bigint")
    assert sorted(tuple(r) for r in replica.acknowledge_snapshot(progress, acks).collect()) == [(1, "a", 4, 5), (1, "b", 9, 10)]
    members = spark.createDataFrame([(1, "a"), (1, "c")], "group_id int, peer string")
    ends = spark.createDataFrame([(1, 7)], "group_id int, last_idx bigint")
    assert sorted(tuple(r) for r in replica.refresh_progress(progress, members, ends).collect()) == [(1, "a", 4, 5), (1, "c", 0, 8)]


def test_compaction_folds_membership(spark):
    log = spark.createDataFrame([(1, i, 1, [0, 1, 2, 3] if i == 2 else [0, 1] if i == 4 else None) for i in range(1, 6)], "group_id int, idx bigint, term bigint, config array<int>")
    base = spark.createDataFrame([(1, [0, 1, 2])], "group_id int, base_config array<int>")
    at = lambda i: spark.createDataFrame([(1, i)], "group_id int, snap_idx bigint")
    for i, left, config in ((1, [2, 3, 4, 5], [0, 1, 2]), (3, [4, 5], [0, 1, 2, 3]), (5, [], [0, 1]), (9, [1, 2, 3, 4, 5], [0, 1, 2])):
        kept, folded = replica.compact_log(log, at(i), base)
        assert sorted(r.idx for r in kept.collect()) == left and folded.head().base_config == config
    assert [tuple(r) for r in replica.snapshot_epochs(log, 2).collect()] == []
    assert [r.idx for r in replica.snapshot_epochs(log, 3).collect()] == [3]


def test_reads_and_waiters(spark):
    log = spark.createDataFrame([(1, "k", 0, "a"), (2, "k", 0, "b"), (3, "k", 1, "")], "seq bigint, key string, kind int, value string")
    status = spark.createDataFrame([(0, 3), (1, 2), (2, 0)], "node int, applied_idx bigint")
    assert [[r.value for r in replica.read_from(log, status, n).collect()] for n in (0, 1, 2)] == [[], ["b"], []]
    waiters = spark.createDataFrame([(0, 3), (1, 3), (1, 2)], "node int, idx bigint")
    assert sorted(tuple(r) for r in replica.waiters_done(waiters, status).collect()) == [(0, 3), (1, 2)]
    applied = spark.createDataFrame([(0, 1, "x"), (1, 1, "x"), (0, 2, "y"), (1, 2, "z")], "node int, idx bigint, command string")
    assert sorted(tuple(r) for r in replica.applied_nodes(applied).collect()) == [(1, 2, True), (2, 2, False)]
