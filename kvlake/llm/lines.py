"""Line dedup by pairwise alignment: documents that share rare hashes are aligned, and common blocks leave the later one.

A line starts after a newline, else where a sentence does, else, in long sentences, at a word whose hash is
the least of its neighbourhood, and every eight words where some few are repeated in turn; no line has fewer than LINE_WORDS
words, if its text has as many. Where a passage is cut depends on the passage alone but for a few words at its ends.

A line of itself is no sign of overlap: thousands of documents may hold it. What is hashed is a run of lines, the
shortest of MIN_BLOCK_WORDS words or more that starts, or ends, at each line; two documents that share a run's hash
overlap in a block. Runs that one document alone holds, most of them, are dropped. Each run that is left makes a pair
of a later document and the first that holds it, so a run in a third of all documents makes as many pairs as it has
copies. Any block of MIN_BLOCK_WORDS words that a document shares with any earlier one is made of such runs, and each
run has a first holder that has all of it, so none is missed and no pairs of a group are spelled out.

The points (line here, line there) of each pair are aligned by patience sorting, which deals them into the fewest
runs that ascend on both sides: passages may stand in another order, or several times. Blocks are consecutive lines
on both sides of one pair; what is deleted is the union of a document's blocks, each of which is long enough by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import minhash
from kvlake.llm.shared import drop, keep, steps

LINE_WORDS, MIN_BLOCK_WORDS = 5, 20
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
#: Odd factors of a word's place in its line, and of a line's place in its run.
_PLACE = np.random.default_rng(13).integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)


def _starts(raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words that start a line. A word is preferred by what comes before it, then by hash; the least of LINE_WORDS to either side wins."""
    near = LINE_WORDS - 1
    n = len(h)
    if n < 2 * LINE_WORDS:
        return np.zeros(min(n, 1), int)
    rank = h >> np.uint64(2)
    rank[1:][_STOP[raw[end[:-1] - 1]]] >>= np.uint64(20)
    breaks = np.flatnonzero(raw == 0x0A)
    after = np.searchsorted(start, breaks)  # the word that follows each newline
    after = after[(after > 0) & (after < n)]
    rank[np.unique(after)] >>= np.uint64(40)
    for period in range(1, LINE_WORDS):  # words that go round have no least one: every eighth of them is preferred
        same = h[period:] == h[:-period]
        if np.count_nonzero(same) >= 8:
            n_th = np.arange(1, len(same) + 1)
            streak = n_th - np.maximum.accumulate(np.where(same, 0, n_th))
            rank[period:][(streak > 0) & (streak % 8 == 0)] >>= np.uint64(10)
    inner = rank[LINE_WORDS : n - near]
    least = np.ones(len(inner), bool)
    for k in range(1, LINE_WORDS):
        least &= (inner < rank[LINE_WORDS - k : n - near - k]) & (inner <= rank[LINE_WORDS + k : n - near + k])
    return np.concatenate(([0], np.flatnonzero(least) + LINE_WORDS))


def lines_of(text: str) -> np.ndarray:
    """Columns start, length (in characters), words, hash of each line; together they are the text. Without words there are none."""
    encoded = text.encode("utf-8", "surrogatepass")
    h, start, end = minhash.word_spans(encoded)
    raw = np.frombuffer(encoded, np.uint8)
    first = _starts(raw, h, start, end)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    words = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, words)
    digest = np.add.reduceat(h * _PLACE[place & 4095], first, dtype=np.uint64) + words.astype(np.uint64)
    at = start[first]
    at[0] = 0
    size = np.diff(np.append(at, len(raw)))
    if len(text) != len(raw):
        size = np.add.reduceat((raw & 0xC0) != 0x80, at, dtype=np.int64)
        at = np.cumsum(size) - size
    return np.column_stack((at, size, words, minhash.mix(digest).view(np.int64)))


def runs_of(words: np.ndarray, digest: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of each shortest run of min_words words or more that starts, or ends, at some line."""
    upto = np.concatenate(([0], np.cumsum(words)))
    first = np.arange(np.searchsorted(upto, upto[-1] - min_words, "right"))  # lines with as many words from them on
    last = np.searchsorted(upto, upto[first] + min_words) - 1
    ends = np.arange(last[0], len(words)) if len(first) else first
    begins = np.searchsorted(upto, upto[ends + 1] - min_words, "right") - 1
    other = last[begins] != ends
    first, last = np.concatenate((first, begins[other])), np.concatenate((last, ends[other]))
    total = (last - first + 1).astype(np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        inside = first + k <= last
        total[inside] += digest[first[inside] + k].view(np.uint64) * _PLACE[k & 4095]
    return first, last, minhash.mix(total).view(np.int64)


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 1):
            ids, out = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start, length, words, digest = lines_of(text or "").T
                if words.sum() >= max(min_words, 1):
                    first, last, h = runs_of(words, digest, min_words)
                    ids.append(np.full(len(first), doc))
                    out.append((first, start[first], start[last] + length[last] - start[first], h))
            if out:
                pos, begin, size, h = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), *(pa.array(c.astype(np.int32)) for c in (pos, begin, size)), pa.array(h)], ["doc_id", "pos", "start", "length", "h"])

    return run


def patience(there: list[int]) -> list[int]:
    """Places in the other document, in this one's order, dealt into the fewest strictly ascending runs: the number of each one's run.

    Each goes on the run whose last is the greatest below it, found by bisection, as cards go on piles.
    """
    last: list[int] = []
    name: list[int] = []
    out = []
    for p in there:
        i = bisect_left(last, p) - 1
        if i < 0:
            last.insert(0, p)
            name.insert(0, len(name))
            i = 0
        else:
            last[i] = p
        out.append(name[i])
    return out


def blocks_of(of: np.ndarray, pos: np.ndarray, there: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """One document's runs of lines, with the earlier document and the line there that each leads to -> its blocks (earlier document, start, end)."""
    order = np.lexsort((there, pos, of))
    of, pos, there, start, end = (c[order] for c in (of, pos, there, start, end))
    chain = np.zeros(len(of), int)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    for lo, hi in zip(edge, edge[1:]):
        if hi - lo > 1 and (np.diff(there[lo:hi]) < 1).any():
            chain[lo:hi] = patience(there[lo:hi].tolist())
    order = np.lexsort((end, pos, chain, of))
    of, pos, there, start, end, chain = (c[order] for c in (of, pos, there, start, end, chain))
    step = np.diff(pos)
    new = np.concatenate(([True], (np.diff(of) != 0) | (np.diff(chain) != 0) | (step != np.diff(there)) | (step > 1)))
    at = np.flatnonzero(new)
    return list(zip(of[at].tolist(), start[at].tolist(), np.maximum.reduceat(end, at).tolist(), strict=True))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each document's shared runs: its blocks, and the (start, length) of what they cover, merged."""
    block_type, cut_type = (pa.list_(pa.struct([(n, t) for n, t in f])) for f in ([("of", pa.int64()), ("start", pa.int32()), ("length", pa.int32())], [("start", pa.int32()), ("length", pa.int32())]))
    for b in batches:
        runs = b.column(1)
        bound = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        of, there, pos, start, length = (c.to_numpy().astype(np.int64) for c in runs.flatten().flatten())
        blocks, cuts = [], []
        for lo, hi in zip(bound, bound[1:]):
            found = blocks_of(of[lo:hi], pos[lo:hi], there[lo:hi], start[lo:hi], start[lo:hi] + length[lo:hi])
            merged: list[list[int]] = []
            for s, e in sorted((s, e) for _, s, e in found):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            blocks.append([{"of": o, "start": s, "length": e - s} for o, s, e in found])
            cuts.append([{"start": s, "length": e - s} for s, e in merged])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blocks, block_type), pa.array(cuts, cut_type)], ["doc_id", "blocks", "cuts"])


def repeats(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """doc_id, blocks and cuts of each document that has any.

    blocks: (of, start, length) in characters of each block aligned with the earlier document `of`; cuts: the parts that
    they cover, apart and in order. Earlier is the smaller doc_id. Texts that are null, empty or under min_words words, or
    that share no run of lines, have no row, nor have rows without doc_id. Where an earlier document holds a run several
    times, it may be led to any of them, which changes blocks but not cuts. Equal texts of min_words words are cut whole from
    all but the first. Rows that repeat a doc_id aren't compared with each other; what either shares with an earlier
    document counts for both. An empty table gives no rows. Other columns are not read. Runs are compared by 64-bit hash.
    """
    runs = keep(docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_cut(min_words), "doc_id long, pos int, start int, length int, h long"), "runs")
    first = runs.groupBy("h").agg(F.min("doc_id").alias("of"), F.min_by("pos", "doc_id").alias("there"), F.max("doc_id").alias("last")).filter("of < last")
    first = keep(first.select("h", "of", "there"), "first")
    # Both sides are shuffled at any size, and as tables, so that a run in a third of the documents can be split between tasks.
    shared = runs.join(first.hint("merge"), "h").filter("doc_id > of")
    each = shared.groupBy("doc_id").agg(F.collect_list(F.struct("of", "there", "pos", "start", "length")).alias("runs"))
    cuts = keep(each.mapInArrow(_align, "doc_id long, blocks array<struct<of:long,start:int,length:int>>, cuts array<struct<start:int,length:int>>"), "cuts")
    drop(runs, first)
    return cuts


def dedup_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """The rows of docs, their texts without what repeats() found; all rows and columns stay, and a text may end up empty."""
    cuts = repeats(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("cuts").alias("__cuts"))
    both = docs.join(cuts.hint("merge"), F.col("doc_id") == F.col("__id"), "left")  # cuts grow with docs: one plan at any size
    last = F.size("__cuts")
    at = lambda i: F.get("__cuts", i)
    begin = lambda i: F.when(i == 0, 0).otherwise(at(i - 1)["start"] + at(i - 1)["length"])
    until = lambda i: F.when(i < last, at(i)["start"]).otherwise(F.length("text"))
    left = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("text"), begin(i) + 1, until(i) - begin(i))), "")
    return both.withColumn("text", F.when(F.col("__cuts").isNotNull(), left).otherwise(F.col("text"))).select(*docs.columns)
