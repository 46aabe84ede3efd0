"""Column functions: guarded integers, record sizes and checksums, command names, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a data record's header and of an index entry's header (fixed format).
RECORD_HEADER, INDEX_HEADER = 21, 29
KEY_LIMIT, VALUE_LIMIT = 65_536, 256 << 20

#: The closed set of command names that metrics tell apart (fixed values).
COMMANDS = ("ping", "echo", "set", "get", "del", "exists", "incr", "decr", "dbsize", "compact", "info", "config", "command", "quit")


def parse_integer(text: Column) -> Column:
    """The 64-bit integer that the whole text spells, else null: no sign but a minus, no blanks."""
    return F.when(F.regexp_like(text, F.lit("^-?[0-9]+$")), text.try_cast("bigint"))


def record_size(key: Column, value: Column) -> Column:
    return (F.lit(RECORD_HEADER) + F.octet_length(key) + F.octet_length(value)).cast("bigint")


def sizes_valid(key: Column, value: Column) -> Column:
    """Whether a write is accepted: 1..65,536 bytes of key, at most 256 MiB of value."""
    return F.octet_length(key).between(1, KEY_LIMIT) & (F.octet_length(value) <= VALUE_LIMIT)


def command_name(raw: Column) -> Column:
    """Lower-case name out of the closed set; anything else, and null, is `unknown`."""
    return F.when(F.lower(raw).isin(*COMMANDS), F.lower(raw)).otherwise(F.lit("unknown"))


def little_endian(number: Column, width: int) -> Column:
    """Binary of ``width`` bytes, least significant first."""
    text = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(width)]))


def encode_record(seq: Column, tombstone: Column, key: Column, value: Column) -> Column:
    """Binary of a checksummed record: crc32, seq, sizes, flags, key, value."""
    body = F.concat(
        little_endian(seq, 8), little_endian(F.octet_length(key), 4), little_endian(F.octet_length(value), 4),
        F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), key, value,
    )
    return F.concat(little_endian(F.crc32(body), 4), body)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0: the space amplification rule."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))
