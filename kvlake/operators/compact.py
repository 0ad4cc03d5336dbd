"""Compaction: which versions no reader at a snapshot from S on can see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.operators.ordered import at_or_below, islands, nearest, running_sum
from kvlake.operators.read import FIXED


def bound(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The oldest snapshot's sequence, or the last sequence without snapshots: seq."""
    oldest = snapshots.agg(F.min("seq").alias("s"))
    return log.agg(F.max("seq").alias("m")).join(oldest).select(F.coalesce("s", "m", F.lit(0)).alias("seq"))


def compact(log: DataFrame, snapshot: Column | int, base_level: Column | None = None) -> DataFrame:
    """Versions that survive, visible(T) being the same for every T >= snapshot.

    A version goes if the next newer one of its key is not after the snapshot; a deletion goes too if it is
    not after the snapshot itself and no older level may hold its key (base_level). Rows of sequence 0 are
    unreadable and go. What stays is all that is after the snapshot and of each key the newest version that isn't: an
    aggregation that is combined before its shuffle, so a hot key costs a row per task.
    """
    s = F.lit(snapshot) if isinstance(snapshot, int) else snapshot
    others = [c for c in log.columns if c not in ("k", "seq")]
    old = log.filter((F.col("seq") > 0) & (F.col("seq") <= s)).groupBy("k")
    if all(isinstance(log.schema[c].dataType, FIXED) for c in others):
        newest = old.agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in others])
    else:
        newest = old.agg(F.max_by(F.struct("seq", *others), "seq").alias("m")).select("k", "m.*")
    if base_level is not None:
        newest = newest.filter(~((F.col("typ") == 0) & base_level))
    return log.filter((F.col("seq") > 0) & (F.col("seq") > s)).unionByName(newest.select(*log.columns))


def with_base_level(log: DataFrame, deeper: DataFrame) -> DataFrame:
    """log with base: no file of deeper(smallest, largest) covers the key.

    The files' key ranges are merged into disjoint islands, and each key is matched to the last island that begins
    at or before it, in key order: neither side is broadcast nor joined by inequality.
    """
    found = at_or_below(merged_ranges(deeper.select("smallest", "largest")).select(F.col("smallest").alias("k"), "largest"), log)
    return log.join(found.select("k", F.coalesce(F.col("hit.largest") < F.col("k"), F.lit(True)).alias("base")), "k")


def merged_ranges(closed: DataFrame) -> DataFrame:
    """Closed ranges merged where they touch or overlap: smallest, largest."""
    told = islands(closed, "smallest", "largest", [])
    return told.groupBy("island").agg(F.max("largest").alias("largest")).select(F.col("island").alias("smallest"), "largest")


def compact_range(log: DataFrame, low, high, snapshot: int) -> DataFrame:
    """compact() of the keys in [low, high], None being unbounded, and all other rows as they are."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("k") >= F.lit(low))
    if high is not None:
        inside = inside & (F.col("k") <= F.lit(high))
    return compact(log.filter(inside), snapshot, F.lit(True)).unionByName(log.filter(~inside))


def split_by_size(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """rows (k, seq, ...) with output: the number of the file each goes to, cut where the running size reaches a multiple of `most`."""
    told = running_sum(rows, ["k", -F.col("seq")], size, "__upto")
    return told.withColumn("output", F.floor(F.col("__upto") / most).cast("long")).drop("__upto")


def split_by_overlap(rows: DataFrame, grandparents: DataFrame, most: int) -> DataFrame:
    """rows (k, seq, ...) with output: a file ends before the key at which the files of grandparents(largest, size), two levels
    down, that it has left behind since it began come to more than `most` bytes.

    What has been left behind at a key is the size of all files that end before it, found by one lookup of all keys.
    Where files are cut depends on the cuts before, so it is worked out on the distinct sums, one number for each
    grandparent at most, which are those of one compaction.
    """
    ends = grandparents.groupBy(F.col("largest").alias("k")).agg(F.sum("size").alias("size"))
    ends = running_sum(ends, ["k"], F.col("size"), "before").select("k", (F.col("before") + F.col("size")).alias("upto"))
    passed = nearest(ends, rows.select("k")).select("k", F.coalesce(F.col("floor.upto"), F.lit(0)).alias("__passed"))
    steps = passed.agg(F.sort_array(F.collect_set("__passed")).alias("s"))
    begun = F.struct(F.get("s", F.lit(0)).alias("base"), F.array().cast("array<bigint>").alias("cuts"))
    cut = F.aggregate("s", begun, lambda a, x: F.when(x - a["base"] > most, F.struct(x.alias("base"), F.concat(a["cuts"], F.array(x)).alias("cuts"))).otherwise(a))
    cuts = (steps.select(cut["cuts"].alias("c")).first() or [None])[0] or []
    output = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__passed"))) if cuts else F.lit(0)
    return rows.join(passed, "k").withColumn("output", output.cast("long")).drop("__passed")


def runs(rows: DataFrame, per_run: int) -> DataFrame:
    """Memtable flushes: rows by thousands of their sequences, each run with its key range and number of entries."""
    run = F.floor((F.col("seq") - 1) / per_run).cast("long")
    return rows.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("entries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def runs_by_size(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """rows (k, seq, ...) with run: the memtable that each goes to, a new one begun once the entries before it have filled the last with `most` bytes."""
    told = running_sum(rows, ["seq"], size, "__upto")
    return told.withColumn("run", F.floor(F.col("__upto") / most).cast("long")).drop("__upto")


def install(files: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The files after a compaction: inputs out, outputs in."""
    return files.join(inputs.select("level", "num"), ["level", "num"], "left_anti").unionByName(outputs)


def move(files: DataFrame, num: int, to_level: int) -> DataFrame:
    """A file goes down a level as it is."""
    return files.withColumn("level", F.when(F.col("num") == num, F.lit(to_level)).otherwise(F.col("level")))
