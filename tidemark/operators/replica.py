"""Decision rules of a majority-replicated log as relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import carry_forward


def majority(n: Column) -> Column:
    """Strict majority with integer division."""
    return F.floor(n / 2) + 1


def majority_index(progress: DataFrame) -> DataFrame:
    """group_id, n_peers, last_idx, majority_idx: the (n div 2 + 1)-th largest
    match.  A group has as many rows as members, so its array is small."""
    sized = progress.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_peers"), F.max("match_idx").alias("last_idx"), F.sort_array(F.collect_list("match_idx"), asc=False).alias("_m"))
    return sized.select("group_id", "n_peers", "last_idx", F.element_at("_m", majority(F.col("n_peers")).cast("int")).alias("majority_idx"))


def commit_index(progress: DataFrame, term_of, committed: Column | int = -1) -> DataFrame:
    """An index commits once a strict majority holds it and its term is the
    current one (the term of the last entry here)."""
    found = majority_index(progress)
    now, at = term_of(F.col("last_idx")), term_of(F.col("majority_idx"))
    committed = F.lit(committed) if isinstance(committed, int) else committed
    advances = (now == at) & (F.col("majority_idx") > committed)
    return found.select("group_id", "n_peers", "majority_idx", now.alias("current_term"), F.when(advances, F.col("majority_idx")).otherwise(committed.cast("bigint")).alias("commit_idx"))


def config_as_of(log: DataFrame, base: Column) -> DataFrame:
    """Membership in force at every index: the last config entry at or before it."""
    return carry_forward(log, "group_id", "idx", "config", "config_in_force", base)


def committed_prefix(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Entries at or below the commit index, per group."""
    kept = log.join(commits.select("group_id", "commit_idx"), "group_id")
    return kept.groupBy("group_id").agg(F.sum((F.col("idx") <= F.col("commit_idx")).cast("bigint")).alias("n_committed"), F.max(F.when(F.col("idx") <= F.col("commit_idx"), F.col("idx"))).alias("last_committed"))


def pending_config(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether a config entry lies above ``majority_idx``."""
    seen = log.join(bounds.select("group_id", "majority_idx"), "group_id")
    above = F.col("config").isNotNull() & (F.col("idx") > F.col("majority_idx"))
    return seen.groupBy("group_id").agg(F.max(above).alias("pending"))


def compare_logs(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """group_id, conflict_at (first index with different terms, or null),
    follower_last, leader_last."""
    both = leader.select("group_id", "idx", F.col("term").alias("lt")).join(follower.select("group_id", "idx", F.col("term").alias("ft")), ["group_id", "idx"], "full")
    return both.groupBy("group_id").agg(
        F.min(F.when(F.col("lt") != F.col("ft"), F.col("idx"))).alias("conflict_at"),
        F.coalesce(F.max(F.when(F.col("ft").isNotNull(), F.col("idx"))), F.lit(0)).alias("follower_last"),
        F.coalesce(F.max(F.when(F.col("lt").isNotNull(), F.col("idx"))), F.lit(0)).alias("leader_last"),
    )


def merge_logs(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's log after the leader's entries were appended: cut at the
    first different term; a mere prefix match never shortens the follower."""
    cut = compare_logs(leader, follower).withColumn("cut", F.coalesce("conflict_at", F.col("follower_last") + 1)).select("group_id", "cut")
    kept = follower.join(cut, "group_id").where(F.col("idx") < F.col("cut")).withColumn("origin", F.lit("kept"))
    sent = leader.join(cut, "group_id").where(F.col("idx") >= F.col("cut")).withColumn("origin", F.lit("leader"))
    return kept.unionByName(sent).drop("cut")


def term_runs(log: DataFrame) -> DataFrame:
    """First and last index of each term."""
    return log.groupBy("group_id", "term").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def conflict_reply(prev: DataFrame, follower: DataFrame, included: Column | int = 0) -> DataFrame:
    """The follower's reply to (prev_idx, prev_term) per group.

    Beyond its end: term -1 and end + 1.  Different term: that term and the
    first index of its run, not below the snapshot's next index.  Else null.
    """
    included = F.lit(included) if isinstance(included, int) else included
    ends = follower.groupBy("group_id").agg(F.max("idx").alias("end_idx"))
    at = follower.select("group_id", F.col("idx").alias("prev_idx"), F.col("term").alias("own_term"))
    runs = term_runs(follower).select("group_id", F.col("term").alias("own_term"), "first_idx")
    asked = prev.join(ends, "group_id", "left").join(at, ["group_id", "prev_idx"], "left").join(runs, ["group_id", "own_term"], "left")
    end = F.coalesce("end_idx", F.lit(0))
    beyond, differs = F.col("prev_idx") > end, F.col("own_term") != F.col("prev_term")
    floor = F.when(F.col("prev_idx") == included, F.col("prev_idx")).otherwise(F.greatest(F.col("first_idx"), included + 1))
    return asked.select(
        "group_id", "prev_idx",
        F.when(beyond, F.lit(-1)).when(differs, F.col("own_term")).cast("bigint").alias("conflict_term"),
        F.when(beyond, end + 1).when(differs, floor).cast("bigint").alias("conflict_idx"),
    )


def next_index(replies: DataFrame, leader: DataFrame) -> DataFrame:
    """Where the leader resumes: after its own last entry of the conflicting
    term, else at the conflict index; never below 1."""
    runs = term_runs(leader).select("group_id", F.col("term").alias("conflict_term"), F.col("last_idx"))
    found = replies.where(F.col("conflict_idx").isNotNull()).join(runs, ["group_id", "conflict_term"], "left")
    return found.select("group_id", "conflict_term", "conflict_idx", F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.col("last_idx") + 1, "conflict_idx")).alias("next_idx"))


def vote_tally(progress: DataFrame) -> DataFrame:
    """Every peer as a candidate: a peer grants iff its own last index is not
    ahead; the candidate wins with more than n div 2 votes.  Groups are as
    small as their membership."""
    a = progress.select("group_id", F.col("peer").alias("candidate"), F.col("match_idx").alias("c"))
    b = progress.select("group_id", F.col("match_idx").alias("v"))
    votes = a.join(b, "group_id").groupBy("group_id", "candidate").agg(F.sum((F.col("v") <= F.col("c")).cast("bigint")).alias("votes"), F.count(F.lit(1)).alias("n"))
    return votes.select("group_id", "candidate", "votes", (F.col("votes") > F.floor(F.col("n") / 2)).alias("wins"))


def grant_votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """Vote requests (arrival, voter, term, candidate, last_term, last_idx)
    against voters (voter, term, voted_for, last_term, last_idx): a stale term
    is refused; per voter and term the first eligible candidate wins, a vote
    cast before binds."""
    own = voters.select("voter", F.col("term").alias("own_term"), "voted_for", F.col("last_term").alias("own_last_term"), F.col("last_idx").alias("own_last_idx"))
    asked = requests.join(own, "voter")
    high = F.max("term").over(Window.partitionBy("voter").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.struct("last_term", "last_idx") >= F.struct(F.col("own_last_term").alias("last_term"), F.col("own_last_idx").alias("last_idx"))
    free = (F.col("term") > F.col("own_term")) | (F.col("voted_for") == -1) | (F.col("voted_for") == F.col("candidate"))
    asked = asked.withColumn("eligible", (F.col("term") >= F.greatest(high, F.col("own_term"))) & fresh & free)
    first = F.first(F.when(F.col("eligible"), F.col("candidate")), ignorenulls=True).over(Window.partitionBy("voter", "term").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    return asked.select("arrival", "voter", "term", "candidate", F.coalesce(F.col("eligible") & (F.col("candidate") == first), F.lit(False)).alias("granted"))


def log_ends(log: DataFrame) -> DataFrame:
    """(term, idx) of the last entry per group."""
    return log.groupBy("group_id").agg(F.max_by("term", "idx").alias("last_term"), F.max("idx").alias("last_idx"))


def up_to_date(candidate: DataFrame, voter: DataFrame) -> DataFrame:
    """Lexicographic comparison of log ends; an empty log is (0, 0)."""
    c = log_ends(candidate).select("group_id", F.col("last_term").alias("ct"), F.col("last_idx").alias("ci"))
    v = log_ends(voter).select("group_id", F.col("last_term").alias("vt"), F.col("last_idx").alias("vi"))
    both = c.join(v, "group_id", "full").fillna(0, ["ct", "ci", "vt", "vi"])
    fresh = (F.col("ct") > F.col("vt")) | ((F.col("ct") == F.col("vt")) & (F.col("ci") >= F.col("vi")))
    return both.select("group_id", fresh.alias("grants"))


def replicate_mode(progress: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ship a snapshot to peers behind the snapshot boundary, entries to the others."""
    joined = progress.join(bounds.select("group_id", F.col("majority_idx").alias("boundary")), "group_id")
    return joined.select("group_id", "peer", F.when(F.col("match_idx") < F.col("boundary"), "snapshot").otherwise("entries").alias("mode"))


def replica_lag(progress: DataFrame) -> DataFrame:
    """Entries each peer is behind the most advanced of its group."""
    top = progress.groupBy("group_id").agg(F.max("match_idx").alias("_top"))
    return progress.join(top, "group_id").select("group_id", "peer", "match_idx", (F.col("_top") - F.col("match_idx")).alias("lag"))


def disagreements(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Indices at which two logs hold different terms; none on clean data."""
    f = follower.select("group_id", "idx", F.col("term").alias("follower_term"))
    return leader.withColumnRenamed("term", "leader_term").join(f, ["group_id", "idx"]).where(F.col("leader_term") != F.col("follower_term"))


def leaders_per_term(claims: DataFrame) -> DataFrame:
    """Distinct claimants of each term."""
    return claims.groupBy("term").agg(F.count_distinct("node").alias("n_leaders"))


def live_log(entries: DataFrame, every: int = 50) -> DataFrame:
    """Entries left after snapshots at every ``every``-th index."""
    n = entries.groupBy("group_id").agg(F.max("idx").alias("last_idx"))
    snap = F.floor(F.col("last_idx") / every) * every
    return n.select("group_id", "last_idx", snap.alias("snapshot_idx"), (F.col("last_idx") - snap).alias("live_entries"))


def install_snapshot(log: DataFrame, boundary: DataFrame) -> DataFrame:
    """Log after a snapshot (group_id, snap_idx, snap_term): the suffix stays
    iff the own term at the boundary matches, else the whole log goes."""
    at = log.join(boundary, "group_id").where((F.col("idx") == F.col("snap_idx")) & (F.col("term") == F.col("snap_term"))).select("group_id", F.lit(True).alias("_same"))
    kept = log.join(boundary, "group_id", "left").join(at, "group_id", "left")
    return kept.where(F.col("snap_idx").isNull() | (F.coalesce("_same", F.lit(False)) & (F.col("idx") > F.col("snap_idx")))).select(*log.columns)


def acknowledge(progress: DataFrame, acks: DataFrame) -> DataFrame:
    """match = max(match, prev + n) over successful acks, next = match + 1."""
    best = acks.where("success").groupBy("group_id", "peer").agg(F.max(F.col("prev_idx") + F.col("n_entries")).alias("_m"))
    joined = progress.join(best, ["group_id", "peer"], "left")
    match = F.greatest(F.col("match_idx"), F.coalesce("_m", F.col("match_idx")))
    return joined.select("group_id", "peer", match.alias("match_idx"), (match + 1).alias("next_idx"))


def follower_commit(status: DataFrame) -> DataFrame:
    """commit = min(leader_commit, last_idx), only ever forward."""
    moved = F.when(F.col("leader_commit") > F.col("commit_idx"), F.least("leader_commit", "last_idx")).otherwise(F.col("commit_idx"))
    return status.withColumn("commit_idx", F.greatest(moved, F.col("commit_idx")))


def config_change(old: Column, new: Column) -> Column:
    """struct(added, removed, one_step): members in one set and not the other."""
    added, removed = F.array_except(new, old), F.array_except(old, new)
    return F.struct(added.alias("added"), removed.alias("removed"), (F.size(added) + F.size(removed) <= 1).alias("one_step"))


def find_leader(status: DataFrame) -> DataFrame:
    """The first reachable node that reports itself leader, else -1."""
    return status.where((F.col("role") == "Leader") & ~F.col("down")).agg(F.coalesce(F.min("node"), F.lit(-1)).alias("leader"))


def reachable(traffic: DataFrame, down: DataFrame) -> DataFrame:
    """Messages whose two ends are up; ``down`` lists the nodes that are not."""
    src = down.select(F.col("node").alias("src"))
    dst = down.select(F.col("node").alias("dst"))
    return traffic.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*traffic.columns)


def to_apply(log: DataFrame, applied: int, commit: int, snapshot_idx: int = 0) -> DataFrame:
    """Entries due for the state machine: committed, new, above the snapshot,
    and no membership entries."""
    due = F.col("idx").between(max(applied, snapshot_idx) + 1, commit)
    return log.where(due & F.col("config").isNull())


def propose(log: DataFrame, commands: DataFrame, status: DataFrame) -> DataFrame:
    """(group_id, ord, idx, term, accepted) of proposed commands (group_id,
    ord): a leader appends them after its last entry with its own term, any
    other node answers -1.  status: group_id, role, term."""
    ends = log.groupBy("group_id").agg(F.max("idx").alias("_e"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("ord"))
    asked = commands.withColumn("_r", place).join(status, "group_id").join(ends, "group_id", "left")
    leads = F.col("role") == "Leader"
    return asked.select("group_id", "ord", F.when(leads, F.coalesce("_e", F.lit(0)) + F.col("_r")).otherwise(F.lit(-1)).cast("bigint").alias("idx"), "term", leads.alias("accepted"))


def election_due(status: DataFrame) -> DataFrame:
    """Nodes that start an election: no leaders, members of their own
    configuration (a learner with an empty one never is), timeout passed."""
    return status.where((F.col("role") != "Leader") & F.array_contains("config", F.col("node")) & (F.col("elapsed_ms") >= F.col("timeout_ms"))).select("node", (F.col("term") + 1).alias("term"), F.col("node").alias("voted_for"))


def step_down(status: DataFrame, seen: DataFrame) -> DataFrame:
    """A node that has seen a higher term follows it and has not voted in it."""
    top = seen.groupBy("node").agg(F.max("term").alias("_t"))
    joined = status.join(top, "node", "left")
    behind = F.coalesce(F.col("_t") > F.col("term"), F.lit(False))
    changed = {"term": F.col("_t"), "role": F.lit("Follower"), "voted_for": F.lit(-1)}
    return joined.select(*(F.when(behind, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in status.columns))


def acknowledge_snapshot(progress: DataFrame, acks: DataFrame) -> DataFrame:
    """match = max(match, boundary) of snapshots that peers have installed."""
    best = acks.groupBy("group_id", "peer").agg(F.max("snap_idx").alias("_m"))
    match = F.greatest(F.col("match_idx"), F.coalesce("_m", F.col("match_idx")))
    return progress.join(best, ["group_id", "peer"], "left").select("group_id", "peer", match.alias("match_idx"), (match + 1).alias("next_idx"))


def refresh_progress(progress: DataFrame, members: DataFrame, ends: DataFrame) -> DataFrame:
    """Trackers (group_id, peer) of a new configuration: kept ones keep their
    place, new ones start after the last entry, others go."""
    joined = members.join(progress, ["group_id", "peer"], "left").join(ends.select("group_id", "last_idx"), "group_id", "left")
    return joined.select("group_id", "peer", F.coalesce("match_idx", F.lit(0)).cast("bigint").alias("match_idx"), F.coalesce("next_idx", F.coalesce("last_idx", F.lit(0)) + 1).cast("bigint").alias("next_idx"))


def compact_log(log: DataFrame, boundary: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log above the boundary, group_id + base_config): a snapshot at
    boundary (group_id, snap_idx) folds the membership in force there into the
    base (group_id, base_config); a boundary beyond the log is ignored."""
    ends = log.groupBy("group_id").agg(F.max("idx").alias("_e"))
    cut = boundary.join(ends, "group_id").where(F.col("snap_idx") <= F.col("_e")).drop("_e")
    joined = log.join(cut, "group_id", "left")
    kept = joined.where(F.col("snap_idx").isNull() | (F.col("idx") > F.col("snap_idx"))).select(*log.columns)
    under = joined.where(F.col("config").isNotNull() & (F.col("idx") <= F.col("snap_idx"))).groupBy("group_id").agg(F.max_by("config", "idx").alias("_c"))
    return kept, base.join(under, "group_id", "left").select("group_id", F.coalesce("_c", "base_config").alias("base_config"))


def read_from(log: DataFrame, status: DataFrame, node: int) -> DataFrame:
    """What node ``node`` answers: the state of the mutations up to its own
    applied index, which may be stale.  log: seq, key, kind, value."""
    from tidemark.operators.state import latest_state

    applied = status.where(F.col("node") == node).agg(F.max("applied_idx").alias("_a"))  # one row
    return latest_state(log.crossJoin(F.broadcast(applied)).where(F.col("seq") <= F.col("_a")).drop("_a"))


def applied_nodes(applied: DataFrame) -> DataFrame:
    """How many nodes have applied each index, and whether they agree on it."""
    return applied.groupBy("idx").agg(F.count_distinct("node").alias("n_nodes"), (F.min("command") == F.max("command")).alias("agree"))


def waiters_done(waiters: DataFrame, status: DataFrame) -> DataFrame:
    """Waiters (node, idx) whose index their node has applied."""
    return waiters.join(status.select("node", "applied_idx"), "node").where(F.col("idx") <= F.col("applied_idx")).select(*waiters.columns)


def snapshot_epochs(log: DataFrame, every: int = 50) -> DataFrame:
    """Indices at which a snapshot is taken: multiples of ``every`` that are
    commands; a membership entry there skips its turn."""
    return log.where((F.col("idx") % every == 0) & F.col("config").isNull()).select("group_id", "idx", F.floor(F.col("idx") / every).alias("epoch"))


class NotLeader(RuntimeError):
    """The asked node does not lead."""


class Timeout(RuntimeError):
    """The entry was not applied in time."""


def routed_writes(commands: DataFrame, status: DataFrame, applied: DataFrame) -> DataFrame:
    """(group_id, ord, node, idx, outcome) of client commands (group_id, ord,
    waits_ms).

    status: group_id, node, role, down, term, last_idx; a command goes to the
    group's first reachable node that reports itself leader, behind its last
    entry and the commands before it.  applied: group_id, node, idx, at_ms,
    when a node applied an index.  Outcomes: ``ok``, ``timeout`` (not applied
    there within waits_ms), ``not_leader`` (no reachable leader; node and idx
    are -1).  Other commands of a group are counted by range-free ranks: one
    window per group, groups being client sessions."""
    leads = status.where((F.col("role") == "Leader") & ~F.col("down"))
    leader = leads.groupBy("group_id").agg(F.min_by(F.struct("node", "last_idx"), "node").alias("_l")).select("group_id", "_l.*")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("ord"))
    sent = commands.withColumn("_r", place).join(leader, "group_id", "left").withColumn("idx", F.col("last_idx") + F.col("_r"))
    done = sent.join(applied.select("group_id", "node", "idx", "at_ms"), ["group_id", "node", "idx"], "left")
    outcome = F.when(F.col("node").isNull(), "not_leader").when(F.col("at_ms") <= F.col("waits_ms"), "ok").otherwise("timeout")
    none = F.lit(-1)
    return done.select("group_id", "ord", F.coalesce("node", none).alias("node"), F.coalesce("idx", none).cast("bigint").alias("idx"), outcome.alias("outcome"))


def accepted(outcome: str) -> None:
    """The outcome of one command as the caller's exception."""
    if outcome == "not_leader":
        raise NotLeader
    if outcome == "timeout":
        raise Timeout


def boot(record: DataFrame) -> DataFrame:
    """What nodes (node, term, voted_for, snap_idx, snap_term) are after a
    restart: followers whose commit and applied index is their snapshot's."""
    return record.select("node", "term", "voted_for", F.lit("Follower").alias("role"), "snap_idx", "snap_term", F.col("snap_idx").alias("commit_idx"), F.col("snap_idx").alias("applied_idx"))


def role_text(role: Column) -> Column:
    """0, 1, 2 as Follower, Candidate, Leader; anything else as Unknown."""
    return F.when(role == 0, "Follower").when(role == 1, "Candidate").when(role == 2, "Leader").otherwise("Unknown")


def peer_order(peers: Column) -> Column:
    """The ids of a peer map (``parse_peers``) in ascending numeric order."""
    return F.array_sort(F.transform(F.map_keys(peers), lambda k: k.cast("int")))
