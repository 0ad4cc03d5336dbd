"""Sorted-table blocks: prefix-compressed entries with restart points, as Parquet's encodings make them unnecessary but
other readers may want them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from kvlake.errors import Corruption, InvalidArgument
from kvlake.functions.bytestrings import crc32c, read_varint, varint
from kvlake.sources import codecs
from kvlake.sources.wal import mask


def build(entries: list[tuple[bytes, bytes]], restart: int = 16, order: Callable = bytes) -> bytes:
    """Strictly ascending entries as a block: shared, non-shared and value lengths, key rest, value; then restart offsets and their number."""
    out, restarts, last = bytearray(), [0], b""
    for i, (key, value) in enumerate(entries):
        if i and order(key) <= order(last):
            raise InvalidArgument(f"keys must ascend: {last!r}, {key!r}")
        shared = 0
        if i % restart:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        elif i:
            restarts.append(len(out))
        out += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        last = key
    return bytes(out) + b"".join(r.to_bytes(4, "little") for r in restarts) + len(restarts).to_bytes(4, "little")


def entries(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    return (e for _, e in _placed(block, at))


def _placed(block: bytes, at: int = 0) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
    """Entries from a restart point on, each with the place where it begins."""
    end = len(block) - 4 - 4 * int.from_bytes(block[-4:], "little")
    key = b""
    while at < end:
        began = at
        shared, at = read_varint(block, at)
        rest, at = read_varint(block, at)
        size, at = read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        yield began, (key, block[at + rest : at + rest + size])
        at += rest + size


def _restarts(block: bytes) -> list[int]:
    n = int.from_bytes(block[-4:], "little")
    return [] if len(block) <= 8 else [int.from_bytes(block[len(block) - 4 - 4 * (n - i) :][:4], "little") for i in range(n)]


def seek(block: bytes, key: bytes, order: Callable = bytes) -> tuple[bytes, bytes] | None:
    """The first entry not below key: binary search over restart points, then a scan."""
    starts = _restarts(block)
    if not starts:
        return None
    at = bisect_left(starts, order(key), key=lambda s: order(next(entries(block, s))[0]))
    return next((e for e in entries(block, starts[max(0, at - 1)]) if order(e[0]) >= order(key)), None)


def before(block: bytes, key: bytes, order: Callable = bytes) -> tuple[bytes, bytes] | None:
    """The last entry below key: from the last restart point that is below it."""
    starts = _restarts(block)
    at = bisect_left(starts, order(key), key=lambda s: order(next(entries(block, s))[0])) - 1
    last = None
    for e in entries(block, starts[at]) if at >= 0 else ():
        if order(e[0]) >= order(key):
            break
        last = e
    return last


def backwards(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the last to the first, one run between restart points at a time."""
    starts = _restarts(block)
    for n in range(len(starts) - 1, -1, -1):
        upto = starts[n + 1] if n + 1 < len(starts) else None
        run = []
        for at, e in _placed(block, starts[n]):
            if at == upto:
                break
            run.append(e)
        yield from reversed(run)


def seal(block: bytes, codec: int = 0) -> bytes:
    """A block, compressed, with its codec and a masked checksum over both after it."""
    data = codecs.pack(codec, block) + bytes([codec])
    return data + mask(crc32c(data)).to_bytes(4, "little")


def unseal(data: bytes) -> bytes:
    """The block that seal() was given; a wrong checksum or a block that can't be unpacked is Corruption."""
    if len(data) < 5 or mask(crc32c(data[:-4])) != int.from_bytes(data[-4:], "little"):
        raise Corruption("checksum of a block")
    return codecs.unpack(data[-5], data[:-5])
