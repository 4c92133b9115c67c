"""Little-endian frames of log records and commands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUT, DELETE = 0, 1


def u32(value: Column) -> Column:
    """An integer as four little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))))


def u8(value: Column) -> Column:
    """An integer below 256 as one byte."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2, "0"))


def read_u32(data: Column, at: Column | int) -> Column:
    """The little-endian u32 at byte ``at`` (from 0) of a BINARY column; null
    where fewer than four bytes are left."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.hex(F.substring(data, at + 1, F.lit(4)))
    flipped = F.concat(*(F.substring(part, i, 2) for i in (7, 5, 3, 1)))
    return F.when(F.length(part) == 8, F.conv(flipped, 16, 10).cast("bigint"))


def frame(kind: Column, key: Column, value: Column) -> Column:
    """``kind u8, key length u32, key, value length u32, value``; shared by
    log bodies and commands."""
    value = F.coalesce(value, F.lit(b""))
    return F.concat(u8(kind), u32(F.octet_length(key)), key, u32(F.octet_length(value)), value)


def wal_record(kind: Column, key: Column, value: Column) -> Column:
    """``crc32 u32, body length u32, body``."""
    body = frame(kind, key, value)
    return F.concat(u32(F.crc32(body)), u32(F.octet_length(body)), body)


def decode_frame(data: Column) -> Column:
    """struct(kind, key, value) of a frame; null where it is malformed
    (short, or a length that reaches beyond the end, or bytes left over)."""
    size = F.octet_length(data)
    key_len = read_u32(data, 1)
    value_len = read_u32(data, F.lit(5) + key_len)
    kind = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("tinyint")
    whole = (size >= 9) & (size == F.lit(9) + key_len + value_len)
    made = F.struct(
        kind.alias("kind"),
        F.substring(data, F.lit(6), key_len.cast("int")).alias("key"),
        F.substring(data, (F.lit(10) + key_len).cast("int"), value_len.cast("int")).alias("value"),
    )
    return F.when(whole, made)


def wal_checksum_ok(record: Column) -> Column:
    """True where a whole record's checksum holds over its body."""
    length = read_u32(record, 4)
    body = F.substring(record, F.lit(9), length.cast("int"))
    return F.coalesce((F.octet_length(body) == length) & (F.crc32(body) == read_u32(record, 0)), F.lit(False))


def parse_peers(text: Column) -> Column:
    """``1=host:port,2=host:port`` as a map from id to address."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def squeeze(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
