"""Compression of blocks by number: a registry that users may add to."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa

from kvlake.errors import CompressionError, NotSupported
from kvlake.functions.bytestrings import read_varint


@dataclass(frozen=True)
class Codec:
    name: str
    pack: Callable[[bytes], bytes]
    unpack: Callable[[bytes], bytes]


def _inflate(bits: int) -> Callable[[bytes], bytes]:
    def run(data: bytes) -> bytes:
        z = zlib.decompressobj(bits)
        return z.decompress(data) + z.flush()

    return run


def _deflate(bits: int) -> Callable[[bytes], bytes]:
    def run(data: bytes) -> bytes:
        z = zlib.compressobj(wbits=bits)
        return z.compress(data) + z.flush()

    return run


#: Fixed values of the format: 0 none, 1 snappy, 2 zlib, 4 deflate without header.
CODECS: dict[int, Codec] = {
    0: Codec("none", bytes, bytes),
    1: Codec("snappy", lambda d: pa.compress(d, "snappy", asbytes=True), lambda d: pa.decompress(d, read_varint(d)[0], "snappy", asbytes=True)),
    2: Codec("zlib", _deflate(15), _inflate(15)),
    4: Codec("deflate", _deflate(-15), _inflate(-15)),
}


def register(number: int, codec: Codec) -> None:
    """Another codec under a number from 0 to 255; a number that is taken is not given away."""
    if not 0 <= number < 256 or number in CODECS:
        raise NotSupported(f"codec number {number}")
    CODECS[number] = codec


def pack(number: int, data: bytes) -> bytes:
    if number not in CODECS:
        raise NotSupported(f"no codec {number}")
    return CODECS[number].pack(data)


def unpack(number: int, data: bytes) -> bytes:
    if number not in CODECS:
        raise NotSupported(f"no codec {number}")
    try:
        return CODECS[number].unpack(data)
    except Exception as e:
        raise CompressionError(f"{CODECS[number].name}: {e}") from e
