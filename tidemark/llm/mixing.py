"""Mixing sources by temperature, in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected until the weights meet a target entropy, or until no
source is repeated more than a limit.  Weights become token budgets, and each
budget a sequence of whole blocks: permutation after permutation of the
source's blocks, until the budget is used up.

A source is cut by hash into BLOCKS blocks whatever its size, so the plan has
at most BLOCKS rows a source, a source with a third of all rows is spread over
all its blocks, and no window sees more than one source's blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, fresh_names, quoted
from tidemark.session import materialise, scope

BLOCKS = 1024
LEVELS = 6  # bisections per pass over the shares
PASSES = 5
WORD_GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """``repetition``: the most epochs of any source while none is cut below
    one.  ``entropy``: nats of the weight distribution; sources then share the
    corpus's own token count, so large ones are cut."""

    repetition: float | None = 2.0
    entropy: float | None = None


def n_tokens(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    found = F.size(F.split(F.trim(F.regexp_replace(text, WORD_GAP, " ")), " "))
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, WORD_GAP, " ")), F.lit("")) == "", 0).otherwise(found).cast("bigint")


def draw(*parts: Column) -> Column:
    """An integer in [0, 2**32) from a digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def shares(tokens: DataFrame) -> DataFrame:
    """source, tokens, share of sources that have tokens."""
    per = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = per.agg(F.sum("tokens").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("_t")).alias("share"))  # one row


def exponent(share: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] that meets the target.

    Bisection, LEVELS steps a pass: a pass aggregates the shares at all the
    midpoints that these steps could ask for, so only a fixed number of rows
    comes to the driver, however many sources there are.
    """
    low, high = 0.0, 1.0
    steps = 1 << LEVELS
    for _ in range(PASSES):
        grid = F.array(*(F.lit(low + (high - low) * i / steps) for i in range(1, steps)))
        at = share.select("share", F.posexplode(grid).alias("i", "x"))
        power = F.pow("share", F.col("x"))
        facts = at.groupBy("i").agg(F.sum(power).alias("z"), F.sum(power * F.col("x") * F.log("share")).alias("e"), F.max(F.pow("share", F.col("x") - 1)).alias("most"), F.min(F.pow("share", F.col("x") - 1)).alias("least"))
        rows = {r.i: r for r in facts.collect()}
        if not rows:
            return 1.0

        def meets(i: int, rows=rows) -> bool:
            """Whether the weights at grid point i are flat enough already."""
            r = rows[i - 1]
            if target.entropy is not None:
                import math

                return math.log(r.z) - r.e / r.z >= target.entropy
            return r.most / r.least > target.repetition

        left, right = 0, steps
        while right - left > 1:  # larger exponents are less flat
            mid = (left + right) // 2
            left, right = (mid, right) if meets(mid) else (left, mid)
        low, high = low + (high - low) * left / steps, low + (high - low) * right / steps
    return high if target.entropy is None else low


def weights(share: DataFrame, target: Target) -> DataFrame:
    """source, tokens, share, weight, budget (tokens to emit)."""
    x = exponent(share, target)
    powered = share.withColumn("_p", F.pow("share", F.lit(x)))
    sums = powered.agg(F.sum("_p").alias("_z"), F.sum("tokens").alias("_t"), F.max(F.col("share") / F.col("_p")).alias("_m"))
    joined = powered.crossJoin(F.broadcast(sums))  # one row
    weight = F.col("_p") / F.col("_z")
    # under a repetition limit the total is what uses the most cut source once
    total = F.col("_t") * F.col("_m") * F.col("_z") if target.entropy is None else F.col("_t")
    return joined.select("source", "tokens", "share", weight.alias("weight"), F.round(weight * total).cast("bigint").alias("budget"))


def plan(tokens: DataFrame, target: Target, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """source, block, epoch, rank, weight: the blocks to emit.

    Whole epochs emit all blocks.  The last epoch takes blocks of its own
    permutation while they fit: a block is taken if the blocks before it leave
    at least half of it within the budget, which is the nearest whole number
    of blocks."""
    weighed = weights(shares(tokens), target).withColumn("_full", F.expr("budget div tokens")).withColumn("_rest", F.expr("budget % tokens"))
    sizes = tokens.groupBy("source", "block").agg(F.sum("n_tokens").alias("_n"))
    joined = sizes.join(weighed, "source")
    each = joined.select("source", "block", "_n", "weight", "_full", "_rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full"))).alias("epoch"))
    order = draw(F.lit(str(seed)), F.col("epoch").cast("string"), F.col("source"), F.col("block").cast("string"))
    each = each.withColumn("_o", order)
    one = Window.partitionBy("source", "epoch").orderBy("_o", "block")  # at most BLOCKS rows
    before = F.coalesce(F.sum("_n").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("rank", F.row_number().over(one)).withColumn("_b", before)
    whole = F.col("epoch") < F.col("_full")
    last = (F.col("_rest") > 0) & (2 * F.col("_b") + F.col("_n") <= 2 * F.col("_rest"))
    return ranked.where(whole | last).select("source", "block", "epoch", "rank", "weight")


def with_block(docs: DataFrame, names: list[str], seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with the columns ``names``: source (null as ''), block and
    n_tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    at = draw(F.lit(f"block{seed}"), F.col("doc_id").cast("string")) % blocks
    made = (source, at, n_tokens(F.col("text").cast("string")))
    return docs.select("*", *(c.alias(n) for c, n in zip(made, names, strict=True)))


def mix(docs: DataFrame, target: Target = Target(), seed: int = 0, keep: list[str] | None = None, facts: bool = True) -> DataFrame:
    """Rows of ``docs`` as often as their blocks are planned: columns ``keep``
    (all if None) and, with ``facts``, mix_tokens, epoch, rank and weight.

    Documents without tokens (null and empty texts) carry no weight; they go
    with their block.  A source without any token has no budget and goes out
    once, unchanged; a null source is the source ''.  Repeated rows and rows
    that share a doc_id lie in one block and go out together; rows without a
    doc_id lie in one block too.  Texts may be of any length.  Ties of a
    permutation fall to the smaller block.  The caller's columns keep their
    values whatever their names; the four facts get underscores in front where
    a kept column has their name (``common.free_name``).
    """
    with scope(docs.sparkSession) as out:
        sized = with_block(docs.select("doc_id", "source", "text"), ["_source", "_block", "_tokens"], seed)
        sized = sized.select(F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_tokens").alias("n_tokens"))
        tokens = materialise(sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens")), "mix-blocks")
        chosen = materialise(plan(tokens, target, seed), "mix-plan")
        idle = tokens.groupBy("source").agg(F.sum("n_tokens").alias("_t")).where("_t = 0").select("source")
        once = tokens.join(idle, "source").select("source", "block", F.lit(0).cast("bigint").alias("epoch"), F.lit(0).alias("rank"), F.lit(0.0).alias("weight"))
        # a row an epoch of a block: a tiny source with many epochs is many rows, in no one's memory
        table = out(chosen.unionByName(once), "mix-table")
    keep = keep if keep is not None else docs.columns
    own = fresh_names(docs, "source", "block", "tokens")
    carried = with_block(docs, own, seed).select(*(F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(keep)), *(F.col(c).alias(n) for c, n in zip(own, ("_source", "_block", "_tokens"), strict=True)))
    table = table.select(*(F.col(c).alias(f"_{c}") for c in ("source", "block", "epoch", "rank", "weight")))
    rows = carried.join(table, ["_source", "_block"])
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]
    if not facts:
        return rows.select(*kept)
    facts_of = {"mix_tokens": F.col("_tokens"), "epoch": F.col("_epoch"), "rank": F.col("_rank"), "weight": F.col("_weight")}
    held = docs.select(*map(quoted, keep))
    return rows.select(*kept, *(c.alias(free_name(held, n)) for n, c in facts_of.items()))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, n_tokens, epoch, rank: every emitted row."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    mixed = mix(source.withColumn("block", draw(F.lit("block0"), F.col("doc_id").cast("string")) % BLOCKS), keep=["doc_id", "source", "block"])
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "block", F.col("mix_tokens").alias("n_tokens"), "epoch", "rank")
