"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is a bit, its
measurement is kept.  A policy is a version name and a mask: applying another
policy, or asking what a rule alone removes, reads the ledger, not the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import WORD, map_arrow, quoted

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_alpha_words", "n_distinct_words", "n_ellipsis_lines", "n_bullet_lines"]
MEASURED = ", ".join(f"{m} bigint" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; integer arithmetic only, so every
    engine agrees."""

    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "capitals", "2 * n_upper_words > n_words"),
    Rule(7, "no_letters", "2 * n_alpha_words < n_words"),
    Rule(8, "few_distinct_words", "20 * n_distinct_words < n_words AND n_words < 2000"),
    Rule(9, "ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule(10, "bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule(11, "many_words", "n_words > 100000"),
    # as rule 8 below 2000 words, where both bounds meet; from there on the square root of the words
    Rule(12, "few_distinct_words_any_length", "20 * n_distinct_words < n_words AND n_distinct_words * n_distinct_words < 5 * n_words"),
]
BIT = {r.name: 1 << r.bit for r in RULES}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Rules 0 to 11, which v2 and strict were made of.
FIRST_RULES = (1 << 12) - 1
#: Policies are only ever added; a version never changes its mask.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["capitals"] | BIT["no_letters"],
    "v2": FIRST_RULES & ~BIT["many_words"],
    "strict": FIRST_RULES,
    "v3": FIRST_RULES & ~BIT["many_words"] & ~BIT["few_distinct_words"] | BIT["few_distinct_words_any_length"],
}
CURRENT = "v3"
BULLETS = ("•", "-", "*", "‣", "◦", "–")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; null has none of anything."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x and WORD.search(x)]
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    distinct = list(seen)
    counts = np.bincount(ids, minlength=len(seen))
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in distinct), bool, len(distinct))
    alpha = np.fromiter((any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(seen)),
        len(lines),
        int(counts[upper].sum()),
        int(counts[alpha].sum()),
        len(seen),
        sum(x.rstrip().endswith(("...", "…")) for x in lines),
        sum(x.lstrip().startswith(BULLETS) for x in lines),
    )


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * distinct + ids[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.r_[same, False] | np.r_[False, same]
    covered = np.zeros(len(ids), bool)
    at = order[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def _measure(batches):
    """Column ``text`` goes, the measurements come behind the other columns;
    without that column the texts are those in ``_row``."""
    for batch in batches:
        texts = batch.column("text") if "text" in batch.schema.names else batch.column("_row").field("text")
        rows = np.array([measure(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(MEASURES))
        held = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], [*held, *MEASURES])


def failure_bits() -> Column:
    """All rules at once over the measurement columns."""
    bits = F.lit(0).cast("bigint")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``bits`` of every row; no shuffle.

    Rows are taken as they come: repeated rows, repeated and null doc_ids give
    rows of their own, a null or empty text has no words (it fails few_words),
    texts may be of any length, other columns are not read."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, _measure, f"doc_id bigint, {MEASURED}").withColumn("bits", failure_bits())


def store(docs: DataFrame, path: str) -> DataFrame:
    """The ledger of ``docs`` written under ``path`` and read back: policies
    and ablations of any later day start from it, not from the texts."""
    led = ledger(docs)
    led.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(led.schema).parquet(path)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """``kept`` under a policy, from the bits alone."""
    return led.withColumn("kept", F.col("bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(led: DataFrame) -> DataFrame:
    """version, rule, n_failed, n_only: what each rule of each policy rejects,
    and what it alone rejects.  Documents are first counted by bit pattern,
    map-side; patterns are at most 2 to the number of rules."""
    patterns = led.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    policies = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(m).cast("bigint").alias("mask")) for v, m in POLICIES.items()))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES))
    rows = patterns.select("bits", "n", F.explode(policies).alias("p")).select("bits", "n", "p.*", F.explode(rules).alias("r")).select("bits", "n", "version", "mask", "r.*").where("(mask & bit) <> 0")
    return rows.groupBy("version", "rule").agg(F.sum(F.expr("if((bits & bit) <> 0, n, 0L)")).alias("n_failed"), F.sum(F.expr("if((bits & mask) = bit, n, 0L)")).alias("n_only"))


def filter_rejected(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, all columns, that the policy keeps.

    Row, measurements and bits stay together, so nothing is joined or
    shuffled; the rules are those of the ledger.  Nulls, empty and long texts
    and repeated rows as in ``ledger``; columns may have any names."""
    row = F.struct(*map(quoted, docs.columns)).alias("_row")
    # a text that is a string already goes to Python once, within its row
    own = [] if dict(docs.dtypes).get("text") == "string" else [F.col("text").cast("string").alias("text")]
    held = docs.select(row, *own)
    schema = StructType([held.schema["_row"], *(StructField(m, LongType()) for m in MEASURES)])
    kept = map_arrow(held, _measure, schema).where(failure_bits().bitwiseAND(F.lit(POLICIES[version])) == 0)
    return kept.select("_row.*")
