"""Statistics and lookup structures over runs: sizes, anchors, blooms, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import read_u32, u32
from tidemark.functions.hashing import bloom_bits, bloom_positions, bloom_probes, fnv_pair
from tidemark.operators.ordered import global_rank, range_bounds
from tidemark.operators.state import flush_runs

INDEX_EVERY = 16


def memtable_bytes(log: DataFrame, value_bytes: Column | int = 8) -> DataFrame:
    """Bytes of each run's distinct keys: key, value and a kind byte each."""
    size = F.octet_length("key") + value_bytes + 1
    return flush_runs(log).groupBy("run_seq").agg(F.sum(size).alias("n_bytes"), F.count(F.lit(1)).alias("n_keys"))


def sparse_index(keys: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    """Every ``every``-th key in order, with its position."""
    return global_rank(keys, "key", "pos").where(F.col("pos") % every == 0)


def block_lookup(keys: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    """For every key the last anchor at or below it: the first key of its block."""
    ranked = global_rank(keys, "key", "pos").withColumn("block", F.floor(F.col("pos") / every))
    return ranked.withColumn("anchor", F.min("key").over(Window.partitionBy("block")))


def entry_offsets(run: DataFrame, parts: int = 64) -> DataFrame:
    """Byte offset of each entry of its run: frames of 9 bytes plus key and
    value.  Running sums go by ranges of the key order and one summary row a
    range, so a large run is not one task."""
    bounds = range_bounds(run, "key", parts)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    sized = run.withColumn("_z", F.octet_length("key") + F.octet_length("value") + 9).withColumn("_b", at)
    sums = sized.groupBy("run_seq", "_b").agg(F.sum("_z").alias("_s"))
    earlier = Window.partitionBy("run_seq").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("run_seq", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("run_seq", "_b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_l", F.coalesce(F.sum("_z").over(inside), F.lit(0)))
    return local.join(sums, ["run_seq", "_b"]).withColumn("offset", F.col("_l") + F.col("_o")).drop("_z", "_b", "_l", "_o")


def bloom_sizing(log: DataFrame, rate: float = 0.01) -> DataFrame:
    """Bits and probes of the filter of each run."""
    return _sized(flush_runs(log).select("run_seq", "key"), rate)


def _sized(keys: DataFrame, rate: float) -> DataFrame:
    n = keys.groupBy("run_seq").agg(F.count(F.lit(1)).alias("n_keys"))
    n = n.withColumn("m_bits", bloom_bits(F.col("n_keys"), rate))
    return n.withColumn("k_probes", bloom_probes(F.col("n_keys"), F.col("m_bits")))


def bloom_hashes(keys: DataFrame) -> DataFrame:
    """run_seq, key and both hashes; what has them already stays as it is.  A
    generator of one row holds them, so that each key is hashed once."""
    if "h1" in keys.columns:
        return keys
    return keys.select("run_seq", "key", F.inline(F.array(fnv_pair(F.col("key").cast("binary")))))


def _places(keys: DataFrame, sized: DataFrame) -> DataFrame:
    """run_seq, key, m_bits, k_probes, at: the probed bits of every key."""
    at = bloom_positions(F.col("h1"), F.col("h2"), F.col("m_bits"), F.col("k_probes"))
    return bloom_hashes(keys).join(sized.select("run_seq", "m_bits", "k_probes"), "run_seq").select("run_seq", "key", "m_bits", "k_probes", at.alias("at"))


def bloom_build(keys: DataFrame, rate: float = 0.01) -> DataFrame:
    """run_seq, m_bits, k_probes, bucket, bits: the filters of runs with
    distinct (run_seq, key), as bitmaps of 4096 bytes.  Bits are set in
    partial aggregates, so a task sends one bitmap a bucket."""
    each = _places(keys, _sized(keys, rate)).select("run_seq", "m_bits", "k_probes", F.explode("at").alias("p"))
    # Spark's bitmap functions count from 1
    bucket, bit = F.bitmap_bucket_number(F.col("p") + 1), F.bitmap_bit_position(F.col("p") + 1)
    return each.groupBy("run_seq", "m_bits", "k_probes", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def bloom_encode(filters: DataFrame) -> DataFrame:
    """run_seq, block: every run's filter as bytes: probes u32, bits u32, both
    little-endian, then the bits, eight to a byte, lowest first."""
    size = F.floor((F.col("m_bits") + 7) / 8).cast("int")
    per = filters.groupBy("run_seq", "m_bits", "k_probes").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("_b"))
    empty = F.unhex(F.repeat(F.lit("00"), 4096))
    every = F.transform(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("m_bits") / 32768)), lambda i: F.hex(F.coalesce(F.element_at("_b", i), empty)))
    block = F.concat(u32(F.col("k_probes")), u32(F.col("m_bits")), F.substring(F.unhex(F.array_join(every, "")), F.lit(1), size))
    return per.select("run_seq", block.alias("block"))


def bloom_decode(blocks: DataFrame) -> DataFrame:
    """The filters of encoded blocks (run_seq, block): as ``bloom_build`` has
    them, the last bitmap of a run being as short as its bits."""
    m = read_u32(F.col("block"), 4)
    each = blocks.select("run_seq", m.alias("m_bits"), read_u32(F.col("block"), 0).alias("k_probes"), "block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(m / 32768))).alias("bucket"))
    return each.select("run_seq", "m_bits", "k_probes", "bucket", F.substring("block", (F.col("bucket") * 4096 - 4087).cast("int"), F.lit(4096)).alias("bits"))


def bloom_probe(filters: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_seq, key, maybe of distinct wanted (run_seq, key): whether all
    probed bits of the run's filter are set."""
    sized = filters.select("run_seq", "m_bits", "k_probes").distinct()
    bucket = lambda p: F.floor(p / 32768) + 1
    places = _places(wanted, sized).select("run_seq", "key", "at", F.explode(F.array_distinct(F.transform("at", bucket))).alias("bucket"))

    def is_set(p: Column) -> Column:
        # ISO-8859-1 has one code point a byte
        octet = F.substring("bits", (F.floor(p % 32768 / 8) + 1).cast("int"), F.lit(1))
        return F.getbit(F.ascii(F.decode(octet, "ISO-8859-1")), (p % 8).cast("int")) == 1

    found = places.join(filters.select("run_seq", "bucket", "bits"), ["run_seq", "bucket"], "left")
    hit = F.forall("at", lambda p: (bucket(p) != F.col("bucket")) | is_set(p))
    return found.groupBy("run_seq", "key").agg(F.min(F.coalesce(hit, F.lit(False))).alias("maybe"))


def valid_prefix(log: DataFrame, ok: Column) -> DataFrame:
    """The rows before the first bad record; good rows after it are not read."""
    bad = log.where(~ok).agg(F.min("seq").alias("_bad"))
    # a single aggregated row
    return log.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")
