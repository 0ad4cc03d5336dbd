"""Merges of sorted runs, and set operations over tables of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(*runs: DataFrame) -> DataFrame:
    """All versions of all runs, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), runs)


def merge(*runs: DataFrame, reverse: bool = False) -> DataFrame:
    """The union in internal key order: key ascending, newest version first; or the exact reverse."""
    both = union(*runs)
    return both.orderBy(F.desc("k"), F.asc("seq")) if reverse else both.orderBy("k", F.desc("seq"))


def concatenate(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Disjoint runs as one ordered scan: ranges of keys, each sorted, so reading partitions in order is the merge."""
    ranged = runs.repartitionByRange(parts, "k") if parts else runs.repartitionByRange("k")
    return ranged.sortWithinPartitions("k", F.desc("seq"))


def merge_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two lists of files by smallest key; on ties those of b first."""
    return a.withColumn("__of", F.lit(1)).unionByName(b.withColumn("__of", F.lit(0))).orderBy("smallest", "__of").drop("__of")


def apply_edits(base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files (level, num, ...) after an edit: base without the deleted, and the added; adding again cancels a deletion."""
    dead = deleted.select("level", "num").join(added.select("level", "num"), ["level", "num"], "left_anti")
    return base.join(dead, ["level", "num"], "left_anti").join(added.select("level", "num"), ["level", "num"], "left_anti").unionByName(added)


def overlapping_neighbours(files: DataFrame) -> DataFrame:
    """Files of levels from 1 on that begin before an earlier one of their level ends; a sound version has none."""
    order = Window.partitionBy("level").orderBy("smallest", "num").rowsBetween(Window.unboundedPreceding, -1)
    return files.filter("level >= 1").withColumn("reach", F.max("largest").over(order)).filter(F.col("reach") >= F.col("smallest"))


def live(files: DataFrame) -> DataFrame:
    return files.select("num").distinct()


def obsolete(listed: DataFrame, live_nums: DataFrame, log_num: Column, manifest_num: Column) -> DataFrame:
    """Of listed(name, kind, num) the files that may go.

    Logs before log_num, manifests before manifest_num, tables and temporary files that are not live.
    CURRENT, LOCK and info logs stay, as do names that are not understood.
    """
    told = listed.join(live_nums.select(F.col("num"), F.lit(True).alias("live")), "num", "left")
    gone = F.when(F.col("kind") == "log", F.col("num") < log_num).when(F.col("kind") == "descriptor", F.col("num") < manifest_num)
    gone = gone.when(F.col("kind").isin("table", "temp"), F.col("live").isNull()).otherwise(F.lit(False))
    return told.filter(gone).select("name", "kind", "num")


def lost(listed: DataFrame, live_nums: DataFrame) -> DataFrame:
    """Live files that are not listed; any means that the store is corrupt."""
    return live_nums.join(listed.filter("kind = 'table'").select("num"), "num", "left_anti")
