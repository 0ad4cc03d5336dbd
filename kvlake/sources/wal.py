"""Write-ahead log records: framing into blocks of 32 KiB, as a plan over sizes and as bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.errors import Corruption
from kvlake.functions.bytestrings import crc32c, read_varint, varint

BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def fragments(records: DataFrame) -> DataFrame:
    """records(record, size, at), at being the place in its block where a record begins -> record, fragment, bytes, kind."""
    room = F.lit(BLOCK - HEADER) - F.col("at")
    whole = BLOCK - HEADER
    more = F.when(F.col("size") <= room, 0).otherwise(F.ceil((F.col("size") - room) / whole)).cast("int")
    each = records.withColumn("more", more).withColumn("fragment", F.explode(F.sequence(F.lit(0), F.col("more"))))
    bytes_ = F.when(F.col("fragment") == 0, F.least(F.col("size"), room)).otherwise(F.least(F.col("size") - room - (F.col("fragment") - 1) * whole, F.lit(whole)))
    kind = F.when(F.col("more") == 0, "full").when(F.col("fragment") == 0, "first").when(F.col("fragment") == F.col("more"), "last").otherwise("middle")
    return each.select("record", "fragment", bytes_.cast("long").alias("bytes"), kind.alias("kind"))


def encode(records: Iterable[bytes]) -> bytes:
    """Records framed one after another: masked checksum over kind and data, length, kind, data; block ends are zeros."""
    out = bytearray()
    for record in records:
        at, first = 0, True
        while first or at < len(record):
            left = BLOCK - len(out) % BLOCK
            if left < HEADER:
                out += bytes(left)
                left = BLOCK
            part = record[at : at + left - HEADER]
            at += len(part)
            last = at >= len(record)
            kind = (FULL if last else FIRST) if first else (LAST if last else MIDDLE)
            out += mask(crc32c(bytes([kind]) + part)).to_bytes(4, "little") + len(part).to_bytes(2, "little") + bytes([kind]) + part
            first = False
    return bytes(out)


def decode(data: bytes) -> Iterator[bytes]:
    """The whole records of a log; a bad checksum raises Corruption, an unfinished end is no error."""
    at, parts = 0, b""
    while at + HEADER <= len(data):
        if BLOCK - at % BLOCK < HEADER:
            at += BLOCK - at % BLOCK
            continue
        crc, size, kind = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 6], "little"), data[at + 6]
        part = data[at + HEADER : at + HEADER + size]
        if len(part) < size or kind == 0:
            return
        if mask(crc32c(bytes([kind]) + part)) != crc:
            raise Corruption(f"checksum of the record at byte {at}")
        at += HEADER + size
        parts = part if kind in (FULL, FIRST) else parts + part
        if kind in (FULL, LAST):
            yield parts


def encode_batch(seq: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """A batch as one record: sequence, count, then type, key and, for puts, value."""
    out = seq.to_bytes(8, "little") + len(ops).to_bytes(4, "little")
    for typ, key, value in ops:
        out += bytes([typ]) + varint(len(key)) + key + (varint(len(value or b"")) + (value or b"") if typ == 1 else b"")
    return out


def decode_batch(record: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    seq, n, at, ops = int.from_bytes(record[:8], "little"), int.from_bytes(record[8:12], "little"), 12, []
    for _ in range(n):
        typ = record[at]
        size, at = read_varint(record, at + 1)
        key, at, value = record[at : at + size], at + size, None
        if typ == 1:
            size, at = read_varint(record, at)
            value, at = record[at : at + size], at + size
        ops.append((typ, key, value))
    return seq, ops


class WriteBatch:
    """Operations in order, and the bytes that a log holds of them."""

    def __init__(self, ops: Iterable[tuple[int, bytes, bytes | None]] = ()):
        self.ops = list(ops)

    def put(self, key: bytes, value: bytes) -> None:
        self.ops.append((1, key, value))

    def delete(self, key: bytes) -> None:
        self.ops.append((0, key, None))

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes | None]]:
        return iter(self.ops)

    def encode(self, seq: int) -> bytes:
        return encode_batch(seq, self.ops)

    def byte_size(self) -> int:
        return len(self.encode(0))

    def set_contents(self, record: bytes) -> int:
        """Take the operations of an encoded batch in place of these; its sequence."""
        seq, self.ops = decode_batch(record)
        return seq


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files under path as rows: file, k, seq, typ, v, and bad, true in one row where a file's rest can't be read.

    A file is decoded by one task; records shorter than a header are passed over; what follows a bad record is not replayed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, bad = [], False
                records = decode(data)
                while True:
                    try:
                        record = next(records, None)
                    except Corruption:
                        bad = True
                        break
                    if record is None:
                        break
                    if len(record) >= 12:
                        seq, ops = decode_batch(record)
                        rows += [(k, seq + i, typ, v) for i, (typ, k, v) in enumerate(ops)]
                if bad:
                    rows.append((None, None, None, None))
                k, s, t, v = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(k, pa.binary()), pa.array(s, pa.int64()), pa.array(t, pa.int32()), pa.array(v, pa.binary()), pa.array([x is None for x in k], pa.bool_())], ["file", "k", "seq", "typ", "v", "bad"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, k binary, seq long, typ int, v binary, bad boolean")
