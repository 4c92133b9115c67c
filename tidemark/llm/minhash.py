"""Near duplicates by improved consistent weighted sampling.

Texts become five-word shingles weighted by term frequency times a compressed
inverse document frequency; consistent weighted samples in bands propose
pairs, the exact weighted Jaccard similarity of the texts decides, and linked
texts form components.

The inverse document frequency lies in [1, 1 + IDF_SPAN]: were it larger, the
few words in which copies of a text differ would weigh so much more than what
thousands of copies share that large groups would lose their links.  Document
frequencies are counted over all documents in a count-mean sketch of fixed
size (2**DF_BITS counters, expected collisions subtracted), so the weights
take the same few MB at any size.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, fresh_names, groups, map_arrow, mix64, quoted
from tidemark.session import materialise, scope

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 3, 12  # a pair at 0.8 is missed with probability 0.0003
IDF_SPAN = 0.25
DF_BITS = 22
CHUNK = 1 << 14
SIGNATURE = ROWS * BANDS
FILTER_BITS = 1 << 24
GROUP = 1 << 20
BLOCK = 1 << 14


# -- texts to shingles ---------------------------------------------------------
HASH_BITS = 44  # of a shingle: the other 20 bits of a sort key number the texts
#: Odd multipliers of a window's words.
STEPS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1) for k in range(SHINGLE)]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")
PART = 1 << 18
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0 .. n - 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(max(n, PART + 1024), x, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if n > 4 * PART:  # a very long word: not kept
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of some UTF-8 bytes: a polynomial of its
    bytes modulo 2**64, as a difference of running sums, then mixed."""
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = np.r_[[0] if not blank[0] else [], edges, [len(data)] if not blank[-1] else []].astype(np.int64)
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, up[: len(data)], out=sums[1:], dtype=np.uint64, casting="unsafe")
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lower-case words one after another, words per text).
    Bytes are taken in parts that end at white space, so a long text needs no
    more memory than its words."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(data):
        end = at + PART
        if end < len(data):
            m = NEXT_BLANK.search(data, end)
            end = m.start() if m else len(data)
        starts, h = word_hashes(np.frombuffer(data[at:end], np.uint8))
        found.append((starts + at, h))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts = np.concatenate([f[0] for f in found])
    return np.concatenate([f[1] for f in found]), np.diff(np.searchsorted(starts, bounds))


def shingled(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of every text's distinct five-word windows, in
    order of text and hash.  A text of fewer words is one window; a text
    without words has none."""
    ends = np.cumsum(n)
    low = (1 << 64) - 1 >> (64 - HASH_BITS)
    keys = []
    if len(flat) >= SHINGLE:
        m = len(flat) - SHINGLE + 1
        h = flat[:m] * STEPS[0]
        for k in range(1, SHINGLE):
            h += flat[k : k + m] * STEPS[k]
        inside = np.ones(m, bool)
        for k in range(1, SHINGLE):  # windows that would cross a text's end
            over = ends - k
            inside[over[(over >= 0) & (over < m)]] = False
        owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)[:m]
        keys.append((owner[inside] << np.uint64(HASH_BITS)) | (mix64(h[inside]) & np.uint64(low)))
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        part = flat[ends[i] - n[i] : ends[i]]
        h = mix64(np.array([sum(int(x) * int(c) for x, c in zip(part, STEPS, strict=False)) + int(n[i]) & (1 << 64) - 1], np.uint64))
        keys.append(np.uint64(i << HASH_BITS) | (h & np.uint64(low)))
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    key = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, count = key[at], np.diff(np.r_[at, len(key)])
    return key & np.uint64(low), (key >> np.uint64(HASH_BITS)).astype(np.int64), count


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingled`` of texts."""
    return shingled(*hashed_words(texts))


def slot(h: np.ndarray) -> np.ndarray:
    """The counter of a shingle: the top bits of its hash."""
    return (h >> np.uint64(HASH_BITS - DF_BITS)).astype(np.int64)


# -- document frequencies -------------------------------------------------------
def text_keys(flat: np.ndarray, words: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each text's words; null where there is none."""
    ends = np.cumsum(words)
    return [hashlib.blake2b(flat[e - w : e].tobytes(), digest_size=16).digest() if w else None for w, e in zip(words.tolist(), ends.tolist(), strict=True)]


def _count(batches):
    """Key of each text; at the end of the task its counters, in chunks."""
    counters = np.zeros(1 << DF_BITS, np.uint32)
    names = ["doc_id", "t", "u", "key", "chunk", "data"]
    for batch in batches:
        for low, texts in groups(batch.column("text").to_pylist(), GROUP):
            flat, words = hashed_words(texts)
            h, _, _ = shingled(flat, words)
            np.add.at(counters, slot(h), np.uint32(1))
            k = len(texts)
            own = [batch.column(c).slice(low, k) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(text_keys(flat, words), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    for c in range(len(counters) // CHUNK):
        part = counters[c * CHUNK : (c + 1) * CHUNK]
        top = int(part.max())
        if top:
            kind = "<u1" if top < 256 else "<u2" if top < 65536 else "<u4"
            none = [pa.nulls(1, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.array([c], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names)


def _add(batches):
    """Sum chunks as they come; a task holds its own few chunks."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
            part = np.frombuffer(data, f"<u{len(data) // CHUNK}")
            held[c] = held.get(c, 0) + part.astype(np.uint64)
    for c, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([part.astype("<u8").tobytes()], pa.binary())], ["chunk", "total", "data"])


def idf_levels(counts: DataFrame, n_docs: int) -> np.ndarray:
    """One byte per counter: 255 * log(N / df) / log N.  The table has
    2**DF_BITS bytes at any input size, which bounds what the driver gathers
    and broadcasts."""
    summed = materialise(map_arrow(counts.select("chunk", "data").where("chunk is not null").repartition("chunk"), _add, "chunk int, total bigint, data binary"), "df")
    total = summed.agg(F.sum("total")).head()[0] or 0
    m = 1 << DF_BITS

    def level(batches):
        for batch in batches:
            out = []
            for data in batch.column("data").to_pylist():
                c = np.frombuffer(data, "<u8").astype(np.float64)
                df = np.clip(c - (total - c) / (m - 1), 1, max(1, n_docs))
                out.append(np.rint(255 * (1 - np.log(df) / math.log(max(2, n_docs)))).clip(0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "data"])

    levels = np.full(m, 255, np.uint8)
    for c, data in map_arrow(summed.select("chunk", "data"), level, "chunk int, data binary").collect():
        levels[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(data, np.uint8)
    return levels


def idf(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return 1 + IDF_SPAN / 255 * levels[slot(h)]


# -- consistent weighted samples --------------------------------------------------
class Draws:
    """The random variates of a hash function, as functions of an element:
    quantile tables of Gamma(2, 1) and the unit interval, indexed by bits of
    the element's remixed hash."""

    def __init__(self, bits: int = 14):
        u = (np.arange(1 << bits) + 0.5) / (1 << bits)
        lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
        for _ in range(60):  # quantiles of Gamma(2, 1) by bisection
            mid = (lo + hi) / 2
            low = 1 - np.exp(-mid) * (1 + mid) < u
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        self.r = lo.astype(np.float32)
        self.inverse = (1 / lo).astype(np.float32)
        self.log_c = np.log(lo).astype(np.float32)
        self.beta = u.astype(np.float32)
        self.bits, self.mask = bits, (1 << bits) - 1


_DRAWS: list[Draws] = []


_ODD = [np.uint64((0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 * (2 * k + 2)) % (1 << 64) | 1) for k in range(SIGNATURE)]


def signatures(h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, SIGNATURE) samples; segments must not be empty.  Texts go in
    blocks that fit the processor's cache."""
    if not _DRAWS:
        _DRAWS.append(Draws())
    log_w = log_w.astype(np.float32)
    ends = np.r_[starts[1:], len(h)]
    out = np.empty((len(starts), SIGNATURE), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        part = slice(int(starts[i]), int(ends[j - 1]))
        _sample(h[part], log_w[part], starts[i:j] - starts[i], out[i:j])
        i = j
    return out


def _sample(h: np.ndarray, log_w: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    d = _DRAWS[0]
    place = np.arange(len(h), dtype=np.int64)
    top, low = np.uint64(64 - d.bits), np.uint64(64 - 2 * d.bits)
    last = np.uint64(64 - 3 * d.bits)
    for k in range(SIGNATURE):
        x = h * _ODD[k]
        i = (x >> top).astype(np.int64)
        j = ((x >> low).astype(np.int64)) & d.mask
        b = d.beta[((x >> last).astype(np.int64)) & d.mask]
        t = np.floor(log_w * d.inverse[i] + b)
        a = d.log_c[j] - d.r[i] * (t - b + 1)
        # order-preserving integers with the place below: ties go to the
        # smallest hash, for a text's shingles are sorted
        v = a.view(np.int32)
        v ^= (v >> 31) & 0x7FFFFFFF
        at = np.minimum.reduceat((v.astype(np.int64) << 32) | place, starts) & 0xFFFFFFFF
        out[:, k] = mix64(h[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(sig), 0)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS][:, :BANDS])
    return key.view(np.int64)


def sketch(docs: DataFrame, levels) -> DataFrame:
    """key, mean_idf, size, bands of every text that has words.  All four
    depend on the words alone: texts of one key have one sketch."""

    def run(batches):
        table = levels.value
        for batch in batches:
            for _, texts in groups(batch.column("text").to_pylist(), GROUP):
                flat, words = hashed_words(texts)
                h, owner, count = shingled(flat, words)
                if not len(h):
                    continue
                named = pa.array(text_keys(flat, words), pa.binary())
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                w = count * (g := idf(h, table))
                keys = band_keys(signatures(h, np.log(w), starts))
                mean = np.add.reduceat(g, starts) / np.diff(np.r_[starts, len(h)])
                size = np.add.reduceat(w, starts)
                yield pa.RecordBatch.from_arrays(
                    [named.take(pa.array(owner[starts])), pa.array(mean, pa.float64()), pa.array(size, pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))],
                    ["key", "mean_idf", "size", "bands"],
                )

    return map_arrow(docs.select("text"), run, "key binary, mean_idf double, size double, bands array<bigint>")


# -- verification -----------------------------------------------------------------
def weighted_jaccards(left: list[str], right: list[str], table: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity of pairs; a text that comes again is
    shingled once."""
    number = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    sets = []
    for _, texts in groups(list(number), GROUP):
        h, owner, count = shingles(texts)
        w = count * idf(h, table)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        sets += zip(np.split(h, cuts), np.split(w, cuts), strict=True)
    out = []
    for a, b in zip(left, right, strict=True):
        (x, v), (y, w) = sets[number[a]], sets[number[b]]
        if len(x) > len(y):
            x, v, y, w = y, w, x, v
        if not len(x):
            out.append(0.0)
            continue
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        hit = y[at] == x
        both = np.minimum(v[hit], w[at[hit]]).sum()
        out.append(float(both / (v.sum() + w.sum() - both)))
    return out


def member_filter(hashes: DataFrame) -> bytes:
    """A bitmap of 2 MB that holds every hash of column ``h``: it never misses
    one, and its size does not depend on their number."""
    at = F.pmod("h", F.lit(FILTER_BITS)) + 1  # the functions count from 1
    bits = hashes.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    out = bytearray(FILTER_BITS // 8)
    for k, b in bits.collect():
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(b)] = b
    return bytes(out)


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted rows (id, NAME), written out.  A bitmap drops
    most other rows before the join, so texts that no pair needs are not
    shuffled."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast(np.frombuffer(member_filter(wanted.select(F.xxhash64(*NAME).alias("h"))), np.uint8))

    def keep(batches):
        for batch in batches:
            p = batch.column("p").to_numpy()
            hit = (held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    source = rows.select(*NAME, "text", F.pmod(F.xxhash64(*NAME), F.lit(FILTER_BITS)).alias("p"))
    likely = map_arrow(source, keep, "d bigint, t bigint, u bigint, text string, p bigint").drop("p")
    # rows of one name hold one text
    found = materialise(likely.join(wanted, list(NAME)).groupBy("id").agg(F.min("text").alias("text")), "texts")
    held.destroy()
    return found


def similarities(pairs: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """a, b, s: the weighted Jaccard similarity of every pair."""

    def run(batches):
        for batch in batches:
            found = weighted_jaccards(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), levels.value)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "s"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return map_arrow(joined, run, "a bigint, b bigint, s double")


def novelty(texts: DataFrame, parts: DataFrame, levels) -> DataFrame:
    """id, novel, single: the weight of each text's shingles that no text of
    another component has, and of those that no other text has.  parts: id,
    component."""

    def run(batches):
        for batch in batches:
            ids, own = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            for low, part in groups(batch.column("text").to_pylist(), GROUP):
                h, owner, count = shingles(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low + owner]), pa.array(own[low + owner]), pa.array(h.view(np.int64)), pa.array(count * idf(h, levels.value))], ["id", "component", "h", "w"])

    rows = materialise(map_arrow(texts.join(parts, "id").select("id", "component", "text"), run, "id bigint, component bigint, h bigint, w double"), "shingles")
    # counted map-side first, so a common shingle is a few rows
    own = rows.groupBy("h").agg(F.min("component").alias("_l"), F.max("component").alias("_u"), F.count(F.lit(1)).alias("_n")).where("_l = _u").select("h", (F.col("_n") == 1).alias("_one"))
    return rows.join(materialise(own, "own-shingles"), "h").groupBy("id").agg(F.sum("w").alias("novel"), F.sum(F.when(F.col("_one"), F.col("w")).otherwise(0.0)).alias("single"))


def stray_pairs(rest: DataFrame, everyone: DataFrame) -> DataFrame:
    """Pairs of different components of a bucket that can still be links.

    Two exact bounds on the common weight of x and y decide, and nothing that
    could be a link is left out; a link needs
    ``common * (1 + t) >= t * (|x| + |y|)``.

    * Shingles that no other component has lie in no common part:
      ``common <= min(|x| - novel(x), |y| - novel(y))``.
    * With the bucket's hub h, ``in(x)`` the weight x shares with h (known from
      their similarity) and ``out(x)`` the rest of x without the shingles that
      x alone has: ``common <= min(in(x), in(y)) + min(out(x), out(y))``.

    A text too far from its hub on its own account therefore links with
    nothing, and for the others the weight of a partner is bounded on both
    sides: partners are looked up by bucket and weight class, one percent wide.
    """
    t, step = THRESHOLD, math.log(1.01)
    level = lambda x: F.floor(F.log(x) / step).cast("int")
    most = (F.col("size") - F.col("novel")) * ((1 + t) / t) - F.col("size")
    able = rest.withColumn("_most", most * (1 + 1e-9)).where(F.col("_most") >= t * F.col("size"))
    facts = ["id", "component", "size", "novel", "inner", "outer"]
    probes = able.select(F.col("band").alias("_band"), *(F.col(c).alias(f"_{c}") for c in facts), F.explode(F.sequence(level(t * F.col("size")) - 1, level(F.col("_most")) + 1)).alias("_slot"))
    partners = everyone.select("band", *facts, level(F.col("size")).alias("slot"))
    common = F.least(F.col("size") - F.col("novel"), F.col("_size") - F.col("_novel"), F.least("inner", "_inner") + F.least("outer", "_outer"))
    fits = common * (1 + t) * (1 + 1e-9) >= t * (F.col("size") + F.col("_size"))
    joined = probes.join(partners, (F.col("band") == F.col("_band")) & (F.col("slot") == F.col("_slot")) & (F.col("component") != F.col("_component")) & fits)
    return joined.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def candidate_links(members: DataFrame, rows: DataFrame, classes: DataFrame, levels) -> DataFrame:
    """(a, b) verified links that connect every component of the candidate
    graph: members has id, mean_idf, size (weight), band (a bucket's key);
    classes says which of the rows holds each id's text.

    In every bucket all members are compared with its hub, the member with
    the commonest shingles.  Members that are not connected with their hub
    are then compared with all others of the bucket that they can still be
    linked with.
    """
    ids = materialise(members.select("id").distinct(), "ids")
    texts = texts_of(rows, classes.join(ids, "id").select("id", *NAME))
    hubs = members.groupBy("band").agg(F.min(F.struct("mean_idf", "id", "size")).alias("h"))
    hubs = materialise(hubs.select("band", F.col("h.id").alias("hub"), F.col("h.size").alias("hub_size")), "hubs")
    placed = materialise(members.join(hubs, "band").select("band", "id", "size", "hub", "hub_size", F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")), "placed")
    star = materialise(similarities(placed.where("a < b").select("a", "b").distinct(), texts, levels), "star")
    links = star.where(F.col("s") >= THRESHOLD).select("a", "b")
    known = materialise(components(ids, links), "parts")
    other = known.select(F.col("id").alias("hub"), F.col("component").alias("_h"))
    own = materialise(placed.join(known, "id").join(other, "hub"), "own")
    open_ = materialise(own.where("component <> _h").select("band").distinct(), "open")
    if open_.isEmpty():
        return links
    around = materialise(own.join(open_, "band").join(star, ["a", "b"], "left"), "around")
    novel = novelty(texts, around.select("id", "component").distinct(), levels)
    # a hub is all inside itself
    inner = F.when(F.col("id") == F.col("hub"), F.col("size")).otherwise((F.col("size") + F.col("hub_size")) * F.col("s") / (1 + F.col("s")))
    around = around.join(novel, "id", "left").withColumn("novel", F.coalesce("novel", F.lit(0.0))).withColumn("inner", inner)
    single = F.when(F.col("id") == F.col("hub"), F.lit(0.0)).otherwise(F.coalesce("single", F.lit(0.0)))
    around = around.withColumn("outer", F.greatest(F.lit(0.0), F.col("size") - F.col("inner") - single) + 1e-9 * F.col("size"))
    around = materialise(around.select("band", "id", "component", "_h", "size", "novel", "inner", "outer"), "around")
    pairs = materialise(stray_pairs(around.where("component <> _h"), around), "stray-pairs")
    more = similarities(pairs, texts, levels).where(F.col("s") >= THRESHOLD).select("a", "b")
    return materialise(links.unionByName(more).distinct(), "links")


#: A row's name: its doc_id (the smallest number where null) and 128 bits of
#: its text.  Rows of one name hold one text under one doc_id.
NAME = ("d", "t", "u")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, NAME, text of every row; a null text becomes the empty one."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", *name_columns(), "text")


def name_columns() -> list[Column]:
    """NAME from columns doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(7), text).alias("u")]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, NAME, class_id, component_id, kept of every row of ``docs``, to
    be called in a ``scope``.

    Rows with the same words are one class under a number of its own, whatever
    their doc_ids; classes are sketched and compared.  A component's first row
    (smallest doc_id, null last, then the text's hash) is the one that is kept.
    """
    context = docs.sparkSession.sparkContext
    rows = named(docs)
    counted = map_arrow(rows.select("doc_id", "t", "u", "text"), _count, "doc_id bigint, t bigint, u bigint, key binary, chunk int, data binary")
    # numbers are given as rows are written: equal rows stay apart
    counted = materialise(counted.withColumn("n", F.monotonically_increasing_id()), "keys")
    keys = counted.where("chunk is null").drop("chunk", "data")
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "u", "n")
    classes = keys.where("key is not null").groupBy("key").agg(F.min(first).alias("first"))
    d = F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("d")
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "key", "first", d, "first.t", "first.u"), "classes")
    levels = context.broadcast(idf_levels(counted, keys.count()))
    sketches = sketch(rows, levels).groupBy("key").agg(F.min(F.struct("mean_idf", "size", "bands")).alias("s"))
    exploded = classes.select("id", "key").join(sketches, "key").select("id", "s.mean_idf", "s.size", F.explode("s.bands").alias("band"))
    exploded = materialise(exploded, "bands")
    crowded = materialise(exploded.groupBy("band").agg(F.min("id").alias("_l"), F.max("id").alias("_u")).where("_l < _u").select("band"), "crowded")
    members = materialise(exploded.join(crowded, "band").distinct(), "members")
    links = candidate_links(members, rows, classes, levels)
    levels.destroy()
    parts = classes.select("id", "key", "first").join(components(classes.select("id"), links, "id"), "id")
    parts = materialise(parts, "class-parts")
    least = parts.groupBy("component").agg(F.min("first").alias("least"))
    facts = parts.join(least, "component").select("key", F.col("first.doc_id").alias("c"), F.col("least.doc_id").alias("p"), F.col("least.n").alias("k"))
    worded = F.col("key").isNotNull()
    return keys.join(materialise(facts, "class-facts"), "key", "left").select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "t", "u",
        F.when(worded, F.col("c")).otherwise(F.col("doc_id")).alias("class_id"), F.when(worded, F.col("p")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(worded, F.col("n") == F.col("k")).otherwise(F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), component_id
    (smallest doc_id reachable by links), kept (one row of each component).

    One row per row of ``docs``, whatever its doc_id: each distinct text is
    compared, rows without a doc_id and rows that share one too.  Where rows
    share a doc_id or have none, class_id and component_id may be shared by
    unlike texts or null; ``kept`` still names one row of each component: the
    smallest doc_id (null last), among rows that share it one of the text with
    the smallest hash.  Texts without words, null ones too, link with nothing
    and are kept.  Texts may be of any length; other columns are not read.
    """
    with scope(docs.sparkSession) as keep:
        return keep(judged(docs).select("doc_id", "class_id", "component_id", "kept"), "near-duplicates")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one that
    ``near_duplicates`` keeps.  Rows equal in doc_id and text count as copies
    of each other, of which one stays (the first by its other columns'
    JSON); rows without words stay as they are."""
    d, t, u, odd = names = fresh_names(docs, "d", "t", "u", "odd")
    with scope(docs.sparkSession) as keep:
        per = judged(docs).groupBy(*NAME).agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
        # 1: no row stays, 2: one of several
        per = keep(per.where("not all").select(*(F.col(c).alias(n) for c, n in zip(NAME, names, strict=False)), F.when(F.col("some"), 2).otherwise(1).alias(odd)), "near-gone")
    rows = docs.select("*", *(c.alias(n) for c, n in zip(name_columns(), names, strict=False)))
    out = rows.join(per, [d, t, u], "left_anti").select(*map(quoted, docs.columns))
    several = per.where(F.col(odd) == 2)
    if several.isEmpty():
        return out
    whole = F.struct(*map(quoted, docs.columns))
    one = rows.join(several, [d, t, u]).groupBy(d, t, u).agg(F.min_by(whole, F.to_json(whole)).alias(odd))
    return out.unionByName(one.select(f"{odd}.*"))
