"""Queries over tables of files (level, num, size, smallest, largest): sums, scores, overlaps, and version history.

smallest and largest are user keys here; internal keys order as struct(k, -seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.errors import Corruption
from kvlake.operators.ordered import at_or_below, islands, nearest, ranges, running, running_sum

LEVELS = 7
BASE_BYTES = 10 << 20
FILE_BYTES = 2 << 20


def level_sums(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("bytes"))


def level_summary(files: DataFrame) -> DataFrame:
    """One line of text per level: its files' number, bytes, and (number, size) each."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("num", "size"))), lambda f: F.format_string("(%d, %d)", f["num"], f["size"])), ", ")
    each = files.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("b"), listed.alias("l"))
    return each.select("level", F.format_string("level %d: %d files, %d bytes: %s", "level", "n", "b", "l").alias("summary"))


def key_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("size").cast("long").alias("bytes"))


def internal_range(log: DataFrame) -> DataFrame:
    """Smallest and largest internal key: by key, and of one key the newest version first."""
    order = F.struct("k", (-F.col("seq")).alias("s"))
    each = log.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return each.select(F.col("lo.k").alias("min_k"), (-F.col("lo.s")).alias("min_seq"), F.col("hi.k").alias("max_k"), (-F.col("hi.s")).alias("max_seq"))


def scores(files: DataFrame, per_l0: int = 4, base: int = BASE_BYTES) -> DataFrame:
    """level and score: files over 4 at level 0, bytes over 10 MiB times ten for each further level; the last level has none."""
    full = F.when(F.col("level") == 0, F.col("n_files") / per_l0).otherwise(F.col("bytes") / (F.lit(float(base)) * F.pow(F.lit(10.0), F.col("level") - 1)))
    return level_sums(files).filter(F.col("level") < LEVELS - 1).select("level", full.alias("score"))


def pick_level(files: DataFrame, **how) -> DataFrame:
    """The level to compact: of the highest score, ties to the lowest level; due from a score of 1."""
    best = scores(files, **how).agg(F.max(F.struct("score", (-F.col("level")).alias("l"))).alias("b"))
    return best.select((-F.col("b.l")).alias("level"), F.col("b.score").alias("score"), (F.col("b.score") >= 1).alias("due"))


def pick_file(files: DataFrame, level: int, pointer=None) -> DataFrame:
    """Round robin: the first file of the level that ends after the pointer, else its first file."""
    own = files.filter(F.col("level") == level)
    after = F.lit(True) if pointer is None else F.col("largest") > F.lit(pointer)
    return own.orderBy(F.desc(after), "smallest", "num").limit(1)


#: Rows of a cell, and bits of how many nodes make one of the next of LEVELS_UP levels.
CELL, BITS, LEVELS_UP = 16, 5, 2
#: Rows that a task puts in order: fewer than elsewhere, as it has them twice, and their nodes, where there is but one range.
HELD = 1 << 18


def _nodes(first: Column, last: Column) -> Column:
    """The fewest nodes that cover the cells from first to last, as numbers of node and level; past the top level there are many."""
    run = lambda low, end, level: F.when(low < end, F.transform(F.sequence(low, end - 1), lambda n: n * (LEVELS_UP + 1) + level)).otherwise(F.array().cast("array<bigint>"))
    low, end, out = first, last + 1, F.array().cast("array<bigint>")
    for level in range(LEVELS_UP):
        up_low, up_end = F.shiftright(low + ((1 << BITS) - 1), BITS), F.shiftright(end, BITS)
        met = up_low < up_end
        left = run(low, F.when(met, F.shiftleft(up_low, BITS)).otherwise(end), level)
        out = F.concat(out, left, run(F.when(met, F.shiftleft(up_end, BITS)).otherwise(end), end, level))
        low, end = up_low, F.when(met, up_end).otherwise(up_low)
    return F.concat(out, run(low, end, LEVELS_UP))


def stabbed(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (k, ...) with each file (smallest, largest, ...) whose closed range holds it: probe and file, as structs.

    Ends of files and probes are numbered in key order, of one key smallest keys first and largest last, and each CELL numbers make a
    cell, however often a key comes. A file goes to the nodes of a tree over the cells that cover it, a probe to those that it is
    under, and what meets in a node is a pair but for a file's first and last cell: the work grows with the rows and the pairs.
    Neither side is sent to all tasks, as a plan knows neither how many nodes its rows go to nor, of compressed columns, its bytes.
    """
    ends = F.array(*[F.struct(F.col(c).alias("k"), F.lit(side).alias("side")) for c, side in (("smallest", 0), ("largest", 2))])
    bounds = files.filter("smallest <= largest").select(F.struct(*files.columns).alias("file"), F.explode(ends).alias("e")).select("e.k", "e.side", "file")
    asked = probes.filter("k IS NOT NULL").select("k", F.lit(1).alias("side"), F.struct(*probes.columns).alias("probe"))
    both, order = bounds.unionByName(asked, allowMissingColumns=True), ["k", "side"]
    placed = running(both, order, F.lit(1), "at", cut=ranges(both, order, rows=HELD)).withColumn("cell", F.floor(F.col("at") / CELL))
    held = placed.filter("side <> 1").groupBy("file").agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.count(F.when(F.col("side") == 0, 1)).alias("copies"))
    held = held.select("file", "copies", F.explode(_nodes(F.col("first"), F.col("last"))).alias("node"))
    under = F.array(*[F.shiftright("cell", BITS * n) * (LEVELS_UP + 1) + n for n in range(LEVELS_UP + 1)])
    met = placed.filter("side = 1").select("k", "probe", F.explode(under).alias("node")).join(held.hint("merge"), "node")
    met = met.filter((F.col("k") >= F.col("file.smallest")) & (F.col("k") <= F.col("file.largest")))
    return met.select("probe", "file", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("probe", "file")


def holding(files: DataFrame, probes: DataFrame) -> DataFrame:
    """probe k joined to the files whose range holds it: k, level, num."""
    return stabbed(files.select("level", "num", "smallest", "largest"), probes.select("k")).select("probe.k", "file.level", "file.num")


def _overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of files, columns a_* and b_*, that overlap: the later of the two begins inside the other."""
    columns = ["level", "num", "size", "smallest", "largest"]
    own, other = (x.select(F.col("smallest").alias("k"), *columns) for x in (upper, lower))
    begun = stabbed(lower.select(*columns), own).select(F.col("probe").alias("a"), F.col("file").alias("b"))
    after = stabbed(upper.select(*columns), other).select(F.col("file").alias("a"), F.col("probe").alias("b")).filter("b.smallest > a.smallest")
    pairs = [x.select(*[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in columns]) for x in (begun, after)]
    return pairs[0].unionByName(pairs[1])


def pruned(files: DataFrame, probes: DataFrame) -> DataFrame:
    """How many files a lookup of each probe may touch: k, n_files."""
    return probes.select("k").distinct().join(holding(files, probes.distinct()).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n_files"))


def first_reaching(files: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the first file, in key order, that ends at or after it: k, num (null if none)."""
    ends = files.groupBy(F.col("largest").alias("k")).agg(F.min("num").alias("num"))
    return nearest(ends, probes).select("k", F.col("ceil.num").alias("num"))


def overlapping(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files that meet the closed range; None is unbounded."""
    if low is not None:
        files = files.filter(F.col("largest") >= F.lit(low))
    if high is not None:
        files = files.filter(F.col("smallest") <= F.lit(high))
    return files


def overlapping_closed(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files of level 0 that meet the range, or meet one that does, and so on: every island of files that touches it.

    An island ends where no earlier file reaches the next one's smallest key, so no iteration is needed.
    """
    tagged = islands(files, "smallest", "largest", ["num"])
    return tagged.join(overlapping(tagged, low, high).select("island").distinct(), "island", "left_semi").select(*files.columns)


def next_level_overlap(files: DataFrame) -> DataFrame:
    """For each file of levels 1 to 5 the bytes of the next level's files that it overlaps: level, num, bytes."""
    own = files.filter("level BETWEEN 1 AND 5")
    found = _overlaps(own, files).filter("b_level = a_level + 1").groupBy(F.col("a_level").alias("level"), F.col("a_num").alias("num")).agg(F.sum("b_size").alias("b"))
    return own.select("level", "num").join(found, ["level", "num"], "left").select("level", "num", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def max_next_level_overlap(files: DataFrame) -> DataFrame:
    """The most bytes of the next level that a file overlaps: bytes, 0 without files."""
    return next_level_overlap(files).agg(F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("bytes"))


def approximate_offset(files: DataFrame, probes: DataFrame, inside: Column | None = None) -> DataFrame:
    """Bytes of files that end at or before each probe, and `inside`, an expression over k and a file, of those that hold it: k, offset."""
    ends = files.groupBy(F.col("largest").alias("k")).agg(F.sum("size").alias("size"))
    ends = running_sum(ends, ["k"], F.col("size"), "before").select("k", (F.col("before") + F.col("size")).alias("upto"))
    past = at_or_below(ends, probes).select("k", F.coalesce(F.col("hit.upto"), F.lit(0)).cast("long").alias("offset"))
    if inside is None:
        return past
    held = holding(files.filter("smallest < largest"), past.select("k")).join(files, ["level", "num"]).filter("k < largest")
    part = held.groupBy("k").agg(F.sum(inside).alias("__part"))
    return past.join(part, "k", "left").select("k", (F.col("offset") + F.coalesce("__part", F.lit(0))).cast("long").alias("offset"))


def output_level(files: DataFrame, low, high, most: int = 20 << 20, deepest: int = 2) -> DataFrame:
    """Where a flushed run may go: past each level that it doesn't overlap, while the level two down is not too full: level."""
    hit = overlapping(files, low, high).groupBy("level").agg(F.sum("size").alias("bytes"))
    wide = hit.groupBy().pivot("level", list(range(LEVELS))).agg(F.first("bytes"))
    has = lambda n: F.col(str(n)).isNotNull()
    full = lambda n: F.coalesce(F.col(str(n)), F.lit(0)) > most
    out = F.when(has(0) | has(1) | full(2), 0)
    for level in range(1, deepest):
        out = out.when(has(level + 1) | full(level + 2), level)
    return wide.select(out.otherwise(deepest).alias("level"))


def trivial_moves(files: DataFrame, most: int = 10 * FILE_BYTES) -> DataFrame:
    """Files that may go down as they are: nothing overlaps in the next level, little in the one after: level, num."""
    own = files.filter(F.col("level") < LEVELS - 1)
    near = _overlaps(own, files).filter("b_level BETWEEN a_level + 1 AND a_level + 2")
    found = near.groupBy(F.col("a_level").alias("level"), F.col("a_num").alias("num")).agg(
        F.count(F.when(F.col("b_level") == F.col("a_level") + 1, 1)).alias("n"), F.sum(F.when(F.col("b_level") == F.col("a_level") + 2, F.col("b_size"))).alias("bytes")
    )
    told = own.select("level", "num").join(found, ["level", "num"], "left")
    return told.filter((F.coalesce("n", F.lit(0)) == 0) & (F.coalesce("bytes", F.lit(0)) < most)).select("level", "num")


def truncated_inputs(files: DataFrame, level: int, most: int) -> DataFrame:
    """A level's files in key order until their sizes pass `most`, the one that passes included."""
    own = files.filter(F.col("level") == level)
    return running(own, ["smallest", "num"], F.col("size"), "__b").filter(F.col("__b") <= most).drop("__b")


def seek_charges(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Lookups that touch more than one file charge the first: level, num, charges, allowed, due."""
    hits = holding(files, probes)
    first = hits.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("level", (-F.col("num")).alias("m"))).alias("f")).filter("n > 1")
    charged = first.groupBy(F.col("f.level").alias("level"), (-F.col("f.m")).alias("num")).agg(F.count(F.lit(1)).alias("charges"))
    allowed = F.greatest(F.lit(100), F.floor(F.col("size") / 16384)).cast("long")
    return files.select("level", "num", allowed.alias("allowed")).join(charged, ["level", "num"]).withColumn("due", F.col("charges") >= F.col("allowed"))


def replay(edits: DataFrame) -> DataFrame:
    """Scalars of a version history edits(edit_no, kind, value): the last value of each kind wins."""
    return edits.filter("value IS NOT NULL").groupBy("kind").agg(F.max_by("value", "edit_no").alias("value"))


def recovered(edits: DataFrame, needed: tuple[str, ...] = ("log_number", "next_file_number", "last_seq")) -> dict:
    """The scalars of a history; one that is needed and that no edit sets is Corruption."""
    told = {r["kind"]: r["value"] for r in replay(edits).collect()}  # a row for each kind of scalar
    lost = [k for k in needed if k not in told]
    if lost:
        raise Corruption(f"no edit sets {', '.join(lost)}")
    return told


def replay_files(edits: DataFrame) -> DataFrame:
    """Files after edits(edit_no, kind add or delete, level, num, size, smallest, largest): those last added and not deleted since.

    In one edit an addition comes after a deletion.
    """
    order = F.struct("edit_no", F.when(F.col("kind") == "add", 1).otherwise(0).alias("o"))
    last = edits.filter("kind IN ('add', 'delete')").groupBy("level", "num").agg(F.max_by(F.struct("kind", "size", "smallest", "largest"), order).alias("f"))
    return last.filter("f.kind = 'add'").select("level", "num", "f.size", "f.smallest", "f.largest")


def next_number(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.max("num"), F.lit(0)) + 1).alias("next_num"))


def compaction_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("level").agg(*[F.sum(c).cast("long").alias(c) for c in ("micros", "read", "written")])
