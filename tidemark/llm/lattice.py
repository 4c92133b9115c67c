"""Embedding near duplicates by lattice hashing.

Each table projects a vector to two blocks of eight dimensions and decodes
each to the nearest point of the E8 lattice; the two points are the cell.  A
vector is indexed by its cell and also probes the cells whose one block is
among the nearest neighbouring lattice points.  Colliding vectors are
verified by their cosine in double precision.

Groups of near copies are not compared pair by pair.  Vectors of a crowded
cell that lie within half the threshold's angle of their common centre form a
core: any two of them are linked, by the triangle inequality of angles.  A
core enters the lattice as one object with a radius; two objects whose radii
and distance decide for all pairs at once are one row, and only where they do
not are the members compared, in blocks of one matrix product each.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, map_arrow, mix64
from tidemark.session import materialise, scope

THRESHOLD = 0.95
TABLES = 14  # a pair at cosine 0.95 is missed with probability below 0.0004
SCALE = 5.0
PROBES = 8  # neighbours probed per block
ANGLE = math.acos(THRESHOLD)
#: Angles nearer to a bound than this are decided by the cosine itself.
MARGIN = 1e-6
CROWD = 8  # owners from which on a cell is tried as a core
BLOCK = 256  # members of a core that are compared by one product


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


MINIMAL = _minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by one half: the nearer of the two."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _hash(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of lattice points (doubled, they are integers)."""
    h = np.zeros(points.shape[:-1], np.uint64)
    for i in range(8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., i]).astype(np.int64).astype(np.uint64))
    return h


_PLANES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def planes(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection (dim, 16) and offset of a table; the columns of each block
    are orthonormal times SCALE * sqrt(dim / 64)."""
    if (dim, table) not in _PLANES:
        rng = np.random.default_rng([dim, table, 20240])
        wide = max(dim, 16)
        q = np.linalg.qr(rng.normal(size=(wide, 16)))[0][:dim]
        _PLANES[dim, table] = q * (SCALE * np.sqrt(wide / 64)), rng.uniform(size=16)
    return _PLANES[dim, table]


def cells(unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, probed cells of shape (n, 1 + 2 * PROBES)) as 64-bit keys."""
    q, off = planes(unit.shape[1], table)
    x = unit @ q + off
    own, near = [], []
    for block in (x[:, :8], x[:, 8:]):
        c = nearest_e8(block)
        away = -2 * (block - c) @ MINIMAL.T  # squared distance but for a constant
        best = np.argpartition(away, PROBES, axis=1)[:, :PROBES]
        own.append(_hash(c))
        near.append(_hash(c[:, None] + MINIMAL[best]))
    salt = np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    key = lambda a, b: mix64(mix64(a + salt) * np.uint64(0xD1B54A32D192ED03) + b)
    mine = key(own[0], own[1])
    probes = np.concatenate([mine[:, None], key(near[0], own[1][:, None]), key(own[0][:, None], near[1])], axis=1)
    return mine.view(np.int64), probes.view(np.int64)


# -- vectors and cells -------------------------------------------------------------
def matrices(column: pa.ListArray):
    """(rows, unit vectors as a matrix) of each dimension in a column of lists
    without nulls; every vector has a component other than zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _own(batches):
    """id, first, copies, unit vector and own cells of every vector."""
    for batch in batches:
        for rows, unit in matrices(batch.column("embedding")):
            mine = np.stack([cells(unit, t)[0] for t in range(TABLES)], 1)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("id", "first", "copies")), _lists(unit), _lists(mine)],
                ["id", "first", "copies", "unit", "cells"],
            )


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _probes(batches):
    """object, cell of every cell that one of the batch's members probes."""
    for batch in batches:
        objects = batch.column("object").to_numpy()
        for rows, unit in matrices(batch.column("unit")):
            for table in range(TABLES):
                probes = cells(unit, table)[1]
                pair = np.stack([np.repeat(objects[rows], probes.shape[1]), probes.ravel()], 1)
                if len(np.unique(objects[rows])) < len(rows):
                    pair = np.unique(pair, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["object", "cell"])


# -- cores ---------------------------------------------------------------------------
def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: str, b: str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def cores(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id -> object of members, object -> first, centre, radius, n, weight).

    Every vector chooses its most crowded own cell; the centre of a cell is
    the direction of the sum of those that chose it, added up as integers in
    partial aggregates, so that a hot cell is one row per task.  Members lie
    within half of ANGLE of the centre.
    """
    own = vectors.select("id", F.size("unit").alias("dim"), F.explode("cells").alias("cell"))
    crowded = materialise(own.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD), "crowded-cells")
    choice = own.join(crowded, ["dim", "cell"]).groupBy("id").agg(F.max(F.struct("n", "cell")).alias("c"))
    chosen = materialise(vectors.select("id", "first", "copies", "unit", F.size("unit").alias("dim")).join(choice.select("id", "c.cell"), "id"), "chosen")
    sums = chosen.select("dim", "cell", F.posexplode("unit").alias("at", "x")).groupBy("dim", "cell", "at").agg(F.sum(F.round(F.col("x") * (1 << 30)).cast("bigint")).alias("x"))
    lists = sums.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x")))).alias("s"))
    centres = lists.select("dim", "cell", F.col("s.x").alias("s")).withColumn("w", F.sqrt(dot("s", "s"))).where("w > 0")
    centres = materialise(centres.select("dim", "cell", F.transform("s", lambda x: x / F.col("w")).alias("centre")), "centres")
    near = chosen.join(centres, ["dim", "cell"]).withColumn("away", angle("unit", "centre")).where(F.col("away") <= ANGLE / 2 - MARGIN)
    near = materialise(near.select("dim", "cell", "id", "first", "copies", "away"), "core-members")
    made = near.groupBy("dim", "cell").agg(F.min("id").alias("object"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("copies").alias("weight"), F.max("away").alias("radius")).where("n > 1")
    made = materialise(made.join(centres, ["dim", "cell"]), "cores")
    return near.join(made.select("dim", "cell", "object"), ["dim", "cell"]).select("id", "object"), made.select("object", "first", "centre", "radius", "n", "weight")


# -- links -----------------------------------------------------------------------------
def meetings(placed: DataFrame) -> DataFrame:
    """(a, b), a < b: objects of which a member of one owns a cell that a
    member of the other probes."""
    own = placed.select("object", F.explode("cells").alias("cell")).distinct()
    probe = map_arrow(placed.select("object", "unit"), _probes, "object bigint, cell bigint").distinct()
    joined = own.withColumnRenamed("object", "x").join(probe.withColumnRenamed("object", "y"), "cell").where("x <> y")
    return materialise(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "meetings")


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the two sides of a block of links: label i is row
    i of the left side, rows without a link keep -1."""
    some = hit.any(1)
    left = np.where(some, np.arange(len(hit)), len(hit))
    while True:
        right = np.where(hit, left[:, None], len(hit)).min(0)
        new = np.minimum(left, np.where(hit, right[None], len(hit)).min(1))
        if (new == left).all():
            break
        left = new
    return np.where(some, left, -1), np.where(hit.any(0), right, -1)


def _compare(batches):
    """Every row holds two blocks of members.  Rows (id, links): how many
    vectors of the other block a member is linked with, copies counted; rows
    (id, other): links that connect what the block connects."""
    for batch in batches:
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = x.values, y.values
            ids, weights, units = zip(*((p.field("id").to_numpy(), p.field("copies").to_numpy(), p.field("unit")) for p in (x, y)), strict=True)
            a, b = (u.flatten().to_numpy().reshape(len(u), -1) for u in units)
            hit = a @ b.T >= THRESHOLD
            if not hit.any():
                continue
            counts = np.r_[hit @ weights[1], weights[0] @ hit]
            left, right = spanning(hit)
            label, every = np.r_[left, right], np.r_[ids[0], ids[1]]
            linked = label >= 0
            yield pa.RecordBatch.from_arrays([pa.array(every[linked]), pa.array(counts[linked].astype(np.int64)), pa.array(ids[0][label[linked]])], ["id", "links", "other"])


def compared(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """id, links, other of the members of object pairs that are neither all
    linked nor all apart.  Large cores are dealt into blocks, so a pair of
    objects is as many rows as pairs of blocks."""
    wanted = pairs.select(F.col("a").alias("object")).union(pairs.select(F.col("b").alias("object"))).distinct()
    members = placed.join(wanted, "object")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    blocks = materialise(members.groupBy("object", block.alias("block")).agg(F.collect_list(F.struct("id", "copies", "unit")).alias("m")), "blocks")
    x = blocks.select(F.col("object").alias("a"), F.col("m").alias("x"))
    y = blocks.select(F.col("object").alias("b"), F.col("m").alias("y"))
    joined = pairs.select("a", "b").join(x, "a").join(y, "b")
    return materialise(map_arrow(joined.select("x", "y"), _compare, "id bigint, links bigint, other bigint"), "compared")


def judged(vectors: DataFrame) -> DataFrame:
    """id, n_links, component_id (smallest ``first``) of distinct vectors (id,
    first, copies, embedding)."""
    vectors = materialise(map_arrow(vectors.select("id", "first", "copies", "embedding"), _own, "id bigint, first bigint, copies bigint, unit array<double>, cells array<bigint>"), "units")
    member, core = cores(vectors)
    placed = vectors.join(member, "id", "left").withColumn("object", F.coalesce("object", "id"))
    placed = materialise(placed.join(core.select("object", "n"), "object", "left").withColumn("n", F.coalesce("n", F.lit(1))), "placed")
    alone = placed.where("n = 1").select("object", "first", F.col("unit").alias("centre"), F.lit(0.0).alias("radius"), "n", F.col("copies").alias("weight"))
    objects = materialise(core.unionByName(alone), "objects")
    side = lambda k: objects.select(F.col("object").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("centre", "radius", "weight")))
    pairs = meetings(placed).join(side("a"), "a").join(side("b"), "b").where(F.size("a_centre") == F.size("b_centre"))
    away, wide = angle("a_centre", "b_centre"), F.col("a_radius") + F.col("b_radius")
    pairs = pairs.select("a", "b", "a_weight", "b_weight", away.alias("away"), wide.alias("wide")).where(F.col("away") - F.col("wide") <= ANGLE + MARGIN)
    pairs = materialise(pairs.withColumn("sure", F.col("away") + F.col("wide") <= ANGLE - MARGIN), "object-pairs")
    sure = pairs.where("sure")
    partial = compared(pairs.where("not sure"), placed)
    outside = sure.select(F.col("a").alias("object"), F.col("b_weight").alias("w")).union(sure.select(F.col("b").alias("object"), F.col("a_weight").alias("w")))
    outside = outside.groupBy("object").agg(F.sum("w").alias("outside"))
    some = partial.groupBy("id").agg(F.sum("links").alias("some"))
    # a core is connected, so objects are the nodes
    object_of = placed.select("id", "object")
    edges = partial.select("id", "other").join(object_of, "id").join(object_of.select(F.col("id").alias("other"), F.col("object").alias("b")), "other")
    edges = sure.select("a", "b").union(edges.select(F.col("object").alias("a"), "b"))
    parts = components(objects.select(F.col("object").alias("id")), edges).withColumnRenamed("id", "object")
    # what a component has in common is found among its objects, of which a
    # group of near copies is a few, not among its rows
    facts = materialise(objects.select("object", "first", "weight").join(outside, "object", "left").join(parts, "object"), "object-facts")
    least = facts.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = facts.join(least, "component").select("object", "weight", "outside", "component_id")
    links = F.col("weight") - 1 + F.coalesce("outside", F.lit(0)) + F.coalesce("some", F.lit(0))
    each = placed.select("id", "object").join(facts, "object").join(some, "id", "left")
    return each.select("id", links.cast("bigint").alias("n_links"), "component_id")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Equal vectors are one vector with a count, so a very common one costs
    nothing: its copies are linked with each other and share all links.  Rows
    count as vectors of their own whatever their vec_id: rows that share one
    are told apart by their vectors, and rows without one count too; a
    component is named by its smallest vec_id (null if it holds none), and
    ``kept`` says that a row's vec_id is that one.  Unusable vectors (null,
    empty, zero, null or non-finite components) have no link and are their own
    component.  Vectors of different dimensions are never linked.  Other
    columns are not read."""
    with scope(embeddings.sparkSession) as keep:
        source = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        usable = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        # adding zero makes minus zero equal to zero
        source = materialise(source.withColumn("embedding", F.when(F.coalesce(usable, F.lit(False)), F.transform("embedding", lambda x: x + F.lit(0.0)))), "vectors")
        classes = source.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        facts = classes.select("id", "embedding").join(judged(classes), "id").drop("id")
        joined = source.join(materialise(facts, "facts"), "embedding", "left")
        own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
        return keep(out, "near-vectors")
