"""What several operators share: tables, batches, words, edges and components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, scope, ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_ROWS = 512
MAX_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts handled together in numpy hold about so many characters.
GROUP_CHARS = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows, for texts can be long;
    Spark bounds their bytes.  A bound that the caller has set lower stays."""
    held = int(spark.conf.get(MAX_ROWS))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(MAX_ROWS, str(BATCH_ROWS))


def map_arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; a task's free memory goes back to
    the system, for its worker waits for the next one."""
    small_batches(df.sparkSession)
    ship_package(df.sparkSession)

    def run(batches):
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand memory that Arrow and the C library hold but do not use back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` behind a prefix with which no column of ``df`` begins, so
    that helper columns never meet the caller's."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as make it new in ``df``: a result
    column never replaces one of the caller's."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) slices of at most ``limit`` characters, one text at least;
    null becomes the empty text."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > low and size + n > limit:
            yield low, [t or "" for t in texts[low:i]]
            low, size = i, 0
        size += n
    if low < len(texts):
        yield low, [t or "" for t in texts[low:]]


class Bounded(dict):
    """A cache of two generations: beyond ``limit`` entries the younger one
    becomes the older one, which goes.  It saves time, never results."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def missing(self, wanted: set) -> list:
        """The wanted keys without a value; all others are at hand afterwards."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        found = wanted.difference(self)
        if self.old:
            held = found.intersection(self.old)
            self.update(zip(held, map(self.old.__getitem__, held), strict=True))
            found -= held
        return list(found)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that gather the slices [start, start + length) one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", label: str = "component") -> DataFrame:
    """Smallest node id reachable from each node: (node, component).

    ``edges`` has columns a, b.  Rounds of large-star and small-star turn the
    edges into stars around each component's smallest node.  The number of
    edges never grows, every half round is written to the shared folder, and
    one row comes to the driver.  Minima are taken by partial aggregates, and
    the edges of a hub are joined with one row, so a large star is no group
    in anyone's memory.
    """
    with scope(nodes.sparkSession) as keep:
        links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "cc")
        seen = None
        while True:
            # large star: larger neighbours of u go to the smallest neighbour of u
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = materialise(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_u"), F.least("a", "_m").alias("_m")), "cc")
            links = materialise(links.join(least, links.b == least._u).select("a", F.col("_m").alias("b")).distinct(), "cc")
            # small star: u and its smaller neighbours go to the smallest of them
            least = materialise(links.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_u"), "_m"), "cc")
            moved = links.join(least, links.a == least._u).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            links = materialise(moved.unionByName(least.select(F.col("_u").alias("a"), F.col("_m").alias("b"))).distinct(), "cc")
            now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).head())
            if now == seen or not now[0]:
                break
            seen = now
        found = links.select(F.col("a").alias("_n"), F.col("b").alias("_c"))
        return keep(nodes.select(node).join(found, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("_c", node).alias(label)), "components")
