"""32-bit FNV hashes and bloom-filter arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published 32-bit FNV offset basis and prime.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK32 = 4294967295


def _octets(data: Column) -> Column:
    """The bytes of a BINARY column as an array of INT; empty for b''.

    ISO-8859-1 has one code point a byte, so characters are bytes."""
    chars = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) > 0, F.transform(chars, F.ascii)).otherwise(F.array().cast("array<int>"))


def fnv_pair(data: Column) -> Column:
    """struct(h1, h2): FNV-1a and FNV-1, 32 bits, of a BINARY column, in one
    pass over its bytes."""

    def step(h: Column, byte: Column) -> Column:
        wide = byte.cast("bigint")
        h1 = (h["h1"].bitwiseXOR(wide) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
        h2 = (h["h2"] * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32)).bitwiseXOR(wide)
        return F.struct(h1.alias("h1"), h2.alias("h2"))

    start = F.lit(FNV_OFFSET).cast("bigint")
    return F.aggregate(_octets(data), F.struct(start.alias("h1"), start.alias("h2")), step)


def fnv1a32(data: Column) -> Column:
    """FNV-1a, 32 bits, of a BINARY column, as BIGINT."""
    return fnv_pair(data)["h1"]


def fnv1_32(data: Column) -> Column:
    """FNV-1, 32 bits, of a BINARY column, as BIGINT."""
    return fnv_pair(data)["h2"]


def bloom_bits(n: Column, rate: float = 0.01) -> Column:
    """Bits for ``n`` keys (at least one key, at least 8 bits)."""
    keys = F.greatest(n.cast("double"), F.lit(1.0))
    return F.greatest(F.lit(8).cast("bigint"), F.ceil(-keys * F.log(F.lit(rate)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("bigint"))


def bloom_probes(n: Column, bits: Column) -> Column:
    """Probes per key for a filter of ``bits`` bits."""
    keys = F.greatest(n.cast("double"), F.lit(1.0))
    return F.greatest(F.lit(1).cast("bigint"), F.round(bits / keys * F.log(F.lit(2.0))).cast("bigint"))


def bloom_positions(h1: Column, h2: Column, bits: Column, probes: Column) -> Column:
    """Probe positions by double hashing of columns that hold both hashes; the
    32-bit wrap precedes the modulus."""
    at = lambda i: (h1 + i * h2).bitwiseAND(F.lit(MASK32)) % bits
    return F.transform(F.sequence(F.lit(0).cast("bigint"), probes - 1), at)
