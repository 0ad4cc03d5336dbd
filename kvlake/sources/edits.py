"""Edits of a store's history as bytes: tagged fields, each a number, a text or a file."""

from __future__ import annotations

from dataclasses import dataclass, field

from kvlake.errors import Corruption, IOFailure
from kvlake.functions.bytestrings import read_varint, varint

#: Fixed values of the format: the tag of each field.
COMPARATOR, LOG, NEXT_FILE, LAST_SEQ, POINTER, DELETED, ADDED, PREV_LOG = 1, 2, 3, 4, 5, 6, 7, 9
_NUMBERS = {LOG: "log_number", PREV_LOG: "prev_log_number", NEXT_FILE: "next_file_number", LAST_SEQ: "last_seq"}


@dataclass
class Edit:
    """pointers: (level, key); deleted: (level, number); added: (level, number, size, smallest, largest)."""

    comparator: str | None = None
    log_number: int | None = None
    prev_log_number: int | None = None
    next_file_number: int | None = None
    last_seq: int | None = None
    pointers: list[tuple[int, bytes]] = field(default_factory=list)
    deleted: set[tuple[int, int]] = field(default_factory=set)
    added: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)

    def encode(self) -> bytes:
        def text(x: bytes) -> bytes:
            return varint(len(x)) + x

        out = b"" if self.comparator is None else varint(COMPARATOR) + text(self.comparator.encode())
        for tag, name in _NUMBERS.items():
            if getattr(self, name) is not None:
                out += varint(tag) + varint(getattr(self, name))
        out += b"".join(varint(POINTER) + varint(level) + text(key) for level, key in self.pointers)
        out += b"".join(varint(DELETED) + varint(level) + varint(num) for level, num in sorted(self.deleted))
        return out + b"".join(varint(ADDED) + varint(level) + varint(num) + varint(size) + text(lo) + text(hi) for level, num, size, lo, hi in self.added)

    @classmethod
    def decode(cls, data: bytes) -> Edit:
        """An unknown tag or a text that isn't UTF-8 is Corruption, an edit that ends within a field a failure of reading."""
        out, at = cls(), 0

        def number() -> int:
            nonlocal at
            try:
                n, at = read_varint(data, at)
            except IndexError:
                raise IOFailure(f"an edit ends at byte {len(data)} within a field") from None
            return n

        def text() -> bytes:
            nonlocal at
            size = number()
            if at + size > len(data):
                raise IOFailure(f"an edit ends at byte {len(data)} within a field")
            at += size
            return data[at - size : at]

        while at < len(data):
            tag = number()
            if tag == COMPARATOR:
                try:
                    out.comparator = text().decode()
                except UnicodeDecodeError:
                    raise Corruption("the comparator's name") from None
            elif tag in _NUMBERS:
                setattr(out, _NUMBERS[tag], number())
            elif tag == POINTER:
                out.pointers.append((number(), text()))
            elif tag == DELETED:
                out.deleted.add((number(), number()))
            elif tag == ADDED:
                out.added.append((number(), number(), number(), text(), text()))
            else:
                raise Corruption(f"no field has tag {tag}")
        return out
