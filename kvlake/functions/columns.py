"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEQ = (1 << 56) - 1
PUT, DELETE = 1, 0


def pack_tag(seq: Column, typ: Column) -> Column:
    """The 8-byte tag of an internal key: sequence shifted over the type."""
    return F.shiftleft(seq, 8).bitwiseOR(typ.cast("long"))


def tag_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_type(tag: Column) -> Column:
    """Unknown types read as puts."""
    return F.when(tag.bitwiseAND(255) == DELETE, DELETE).otherwise(PUT)


def varint_length(n: Column) -> Column:
    """Bytes of n as a base-128 varint; null of a null."""
    out = F.lit(1)
    for bytes_ in range(2, 10):
        out = F.when(n >= (1 << (7 * (bytes_ - 1))), F.lit(bytes_)).otherwise(out)
    return F.when(n.isNotNull(), out)


_LOW32 = 0xFFFFFFFF
_DELTA = 0xA282EAD8


def mask_crc(crc: Column) -> Column:
    """Rotate right by 15 and add a constant, modulo 2 ** 32, so that a checksum of checksums is not degenerate."""
    rotated = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(_LOW32))
    return (rotated + F.lit(_DELTA)).bitwiseAND(F.lit(_LOW32))


def unmask_crc(masked: Column) -> Column:
    rotated = (masked - F.lit(_DELTA)).bitwiseAND(F.lit(_LOW32))
    return F.shiftright(rotated, 17).bitwiseOR(F.shiftleft(rotated, 15)).bitwiseAND(F.lit(_LOW32))


def filter_index(offset: Column, base_lg2: int = 11) -> Column:
    """Which filter of a table covers a block that starts at offset."""
    return F.shiftright(offset, base_lg2)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; 0 beside a null."""
    longest = F.least(F.length(a), F.length(b))
    lengths = F.filter(F.sequence(F.lit(0), longest), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.coalesce(F.array_max(lengths), F.lit(0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


_PATTERNS = {
    "log": r"^(\d+)\.log$",
    "table": r"^(\d+)\.(?:sst|ldb)$",
    "temp": r"^(\d+)\.dbtmp$",
    "descriptor": r"^MANIFEST-(\d+)$",
}


def file_type(name: Column) -> Column:
    """log, table, temp, descriptor, current, lock, infolog, or null for names of no such kind."""
    out = F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "infolog")
    for kind, pattern in _PATTERNS.items():
        out = out.when(name.rlike(pattern), kind)
    return out


def file_number(name: Column) -> Column:
    """The number in a file's name; 0 where its kind has none, null for other names."""
    digits = F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, 1)) for p in _PATTERNS.values()])
    return F.coalesce(digits.cast("long"), F.when(file_type(name).isNotNull(), F.lit(0).cast("long")))


_NAMES = {"log": "%06d.log", "table": "%06d.ldb", "descriptor": "MANIFEST-%06d", "temp": "%06d.dbtmp"}


def file_name(kind: str, number: Column) -> Column:
    return F.format_string(_NAMES[kind], number)
