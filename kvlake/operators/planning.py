"""Which files a compaction takes: what is due, the files of two levels that go in, and those two levels down that it must mind.

Only sums, counts and ends of ranges reach the driver; files stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators import meta


@dataclass(frozen=True)
class Span:
    low: object
    high: object
    n: int
    bytes: int


def span(*tables: DataFrame) -> Span:
    """Ends of the range that files cover together, their number and bytes."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return Span(*both.agg(F.min("smallest"), F.max("largest"), F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first())


def overlapping_inputs(files: DataFrame, level: int, low, high) -> DataFrame:
    """A level's files that meet the range; at level 0 also those that meet one of these, and so on."""
    own = files.filter(F.col("level") == level)
    return meta.overlapping_closed(own, low, high) if level == 0 else meta.overlapping(own, low, high)


def pick(files: DataFrame, pointers: dict[int, object] | None = None, charges: DataFrame | None = None, **how) -> tuple[int, DataFrame] | None:
    """The level that is due and the file to begin with, or None.

    A level whose score is 1 or more comes first, with the file after its pointer; else a file that lookups have charged as often
    as it allows (charges as meta.seek_charges gives them). At level 0 all that overlaps the file comes along.
    """
    level, _, due = meta.pick_level(files, **how).first()
    if due:
        own = meta.pick_file(files, level, (pointers or {}).get(level))
    else:
        hit = charges.filter("due").orderBy("level", "num").first() if charges is not None else None
        if hit is None:
            return None
        level = hit["level"]
        own = files.filter((F.col("level") == level) & (F.col("num") == hit["num"]))
    if level == 0:
        s = span(own)
        own = overlapping_inputs(files, 0, s.low, s.high)
    return level, own


def compaction_inputs(files: DataFrame, level: int, picked: DataFrame, file_bytes: int = meta.FILE_BYTES) -> DataFrame:
    """The files of a compaction of picked, of `level`: level, num, size, smallest, largest, role.

    role: 0 for files of the level, 1 for those of the next that they meet, 2 for those of the one after that all of these
    meet. The level's files are more than picked, where more fit into the range of the next level's without drawing
    further files of that, and both together stay under 25 files' bytes.
    """
    columns = ["level", "num", "size", "smallest", "largest"]
    files, own = files.select(*columns), picked.select(*columns)
    s = span(own)
    below = overlapping_inputs(files, level + 1, s.low, s.high)
    b = span(below)
    every = span(own, below)
    if b.n:
        more = overlapping_inputs(files, level, every.low, every.high)
        m = span(more)
        if m.n > s.n and b.bytes + m.bytes < 25 * file_bytes:
            wider = overlapping_inputs(files, level + 1, m.low, m.high)
            if span(wider).n == b.n:
                own, below = more, wider
                every = span(own, below)
    out = own.withColumn("role", F.lit(0)).unionByName(below.withColumn("role", F.lit(1)))
    if level + 2 < meta.LEVELS:
        out = out.unionByName(overlapping_inputs(files, level + 2, every.low, every.high).withColumn("role", F.lit(2)))
    return out


def is_trivial(inputs: DataFrame, file_bytes: int = meta.FILE_BYTES) -> bool:
    """Whether compaction_inputs() are one file that may go down a level as it is."""
    n = {r["role"]: (r["n"], r["bytes"]) for r in inputs.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}
    return n.get(0, (0, 0))[0] == 1 and 1 not in n and n.get(2, (0, 0))[1] < 10 * file_bytes


def input_rows(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """Of rows (file, k, seq, ...) those of a compaction's own and next level's files, in internal key order."""
    taken = inputs.filter("role < 2").select(F.col("num").alias("file"))
    return rows.join(taken, "file", "left_semi").orderBy("k", F.desc("seq"))
