"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a whitespace marker after another character, so no merge crosses the start
of a run of markers: a text falls into chunks, each a run of spaces and what follows, that are
segmented independently. Each worker segments each distinct chunk once and joins ids back by position.
The table lives in the worker for as long as its task, not in a shuffle: joining ids back across the cluster would
move every word of the corpus, some six times the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.shared import steps

#: Chunks that a worker's table holds before it forgets those not in use.
TABLE_CHUNKS = 200_000

_CHUNK = re.compile(r" +[^ ]*")


class Pieces:
    """Encodes as the library does with an end id and no sampling, and decodes as its decode(ids)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.vocab_size())) if "▁" in p.lstrip("▁")]
        if crossing or not self.sp.encode(" ") or self.sp.decode(self.sp.encode("a  b ")) != "a  b ":
            raise ValueError(f"pieces cross whitespace markers, or the model trims spaces: {crossing[:3]}")
        self.end = self.sp.eos_id()
        self.table: dict[str, tuple[str, int, str]] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Put the distinct chunks of these texts into the table, all that it lacks in one call."""
        now = set().union(*texts)
        new = list(now - self.table.keys())
        if len(self.table) + len(new) > TABLE_CHUNKS:
            self.table = {c: self.table[c] for c in now & self.table.keys()}
        ids = self.sp.encode([c[1:] for c in new])
        lone = [self.sp.piece_to_id("▁")]  # the library drops an empty text before it adds the marker
        ids = [i or lone for i in ids]
        for chunk, i, decoded in zip(new, ids, self.sp.decode(ids), strict=True):
            self.table[chunk] = "".join([f"{x} " for x in i]), len(i), " " + decoded

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """The marked words of a text, each starting with a space; the first space is the marker that the library adds."""
        if not text:
            return []
        text = " " + text.replace("▁", " ")
        if text[-1] == " " or "  " in text:
            return _CHUNK.findall(text)
        return [f" {x}" for x in text[1:].split(" ")]

    def segmented(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, str]]]:
        """For each text, its chunks' (ids as text with a space after each, number of ids, decoded text)."""
        step, size = [], 0
        for n, text in enumerate(texts, 1):
            step.append(self.chunks(text))
            size += len(step[-1])
            if size > TABLE_CHUNKS // 4 or n == len(texts):
                self.learn(step)
                yield from ([self.table[c] for c in x] for x in step)
                step, size = [], 0

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, and sha256 of the ids' text and of the decoded text."""
        for parts in self.segmented(texts):
            ids = "".join([p[0] for p in parts]) + str(self.end)
            decoded = "".join([p[2] for p in parts])[1:]
            yield sum([p[1] for p in parts]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def coded(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids with the end id, and the decoded text."""
        for parts in self.segmented(texts):
            ids = "".join([p[0] for p in parts]) + str(self.end)
            yield np.fromiter(map(int, ids.split()), np.int32), "".join([p[2] for p in parts])[1:]


_LOADED: dict[bytes, Pieces] = {}


def _loaded(model: bytes) -> Pieces:
    """The model outlives its task, its table does not: workers are used again by other stages."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    _LOADED[model].table = {}
    return _LOADED[model]


def _in_steps(model: bytes, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[Pieces, pa.RecordBatch]]:
    pieces = _loaded(model)

    def last() -> Iterator[pa.RecordBatch]:
        yield from batches
        pieces.table = {}

    for b in steps(last(), column):
        yield pieces, b


def _model(path: str | None) -> bytes:
    """The vocabulary file, half a megabyte, goes to the tasks with the code."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text is an empty one: the end id alone. Null and repeated doc_ids are passed on row by row; an
    empty table gives no rows; other columns are not read.
    """
    model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, b in _in_steps(model, batches, 1):
            made = list(pieces.digests(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows of docs with token_ids (array of int, end id last) and decoded; columns of those names are replaced.

    A null text gives the end id alone and an empty decoded text. Rows are independent: null or repeated ids are passed on,
    an empty table gives no rows.
    """
    model = _model(model_path)
    docs = docs.drop("token_ids", "decoded")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, b in _in_steps(model, batches, at):
            coded = list(pieces.coded(b.column(at).to_pylist()))
            ends = np.cumsum([0, *(len(c[0]) for c in coded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([c[0] for c in coded])))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array([c[1] for c in coded], pa.string())], [*b.schema.names, "token_ids", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, token_ids array<int>, decoded string")
