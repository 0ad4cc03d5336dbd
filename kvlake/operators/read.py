"""Reads: the newest version of each key at a snapshot, without deleted keys, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.errors import InvalidArgument
from kvlake.operators.ordered import nearest

#: Types that an aggregation buffer can update in place, so that hash aggregation is chosen.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def at(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.filter(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, deletions included: k, seq, typ, v."""
    log = at(log, snapshot)
    if isinstance(log.schema["v"].dataType, FIXED):
        return log.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("typ", "seq").alias("typ"), F.max_by("v", "seq").alias("v"))
    top = log.groupBy("k").agg(F.max(F.struct("seq", "typ", "v")).alias("m")) if not _unordered(log) else log.groupBy("k").agg(F.max_by(F.struct("seq", "typ", "v"), "seq").alias("m"))
    return top.select("k", "m.seq", "m.typ", "m.v")


def _unordered(log: DataFrame) -> bool:
    return isinstance(log.schema["v"].dataType, (T.MapType, T.VariantType))


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """k, v, seq of each key that exists at the snapshot; an empty or null value exists, a deletion doesn't."""
    return newest(log, snapshot).filter("typ = 1").select("k", "v", "seq")


def scan(log: DataFrame, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    seen = visible(log, snapshot)
    return seen.orderBy(F.desc("k") if reverse else "k")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """One row, or none; the key filter goes below the aggregation, into the scan."""
    return visible(log.filter(F.col("k") == F.lit(key)), snapshot)


def state(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """k, state (present, deleted or absent), v for each probe."""
    told = probes.select("k").join(newest(log.join(probes.select("k").dropDuplicates(), "k", "left_semi"), snapshot), "k", "left")
    return told.select("k", F.when(F.col("typ") == 1, "present").when(F.col("typ") == 0, "deleted").otherwise("absent").alias("state"), "v")


def multi_get(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each probe with its v and seq, null where the key doesn't exist."""
    return probes.join(visible(log, snapshot), "k", "left")


def existing(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    return probes.join(visible(log, snapshot), "k", "left_semi")


def missing(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    return probes.join(visible(log, snapshot), "k", "left_anti")


def scan_range(log: DataFrame, low=None, high=None, snapshot: int | None = None) -> DataFrame:
    """Keys in [low, high); None is unbounded, and an empty key is a bound like any other."""
    if low is not None:
        log = log.filter(F.col("k") >= F.lit(low))
    if high is not None:
        log = log.filter(F.col("k") < F.lit(high))
    return visible(log, snapshot)


def scan_prefix(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return visible(log.filter(F.col("k").startswith(prefix)), snapshot)


def has_prefix(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    """Whether the first key that is not below prefix starts with it: found."""
    return scan_prefix(log, prefix, snapshot).agg((F.count(F.lit(1)) > 0).alias("found"))


def count(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return visible(log, snapshot).agg(F.count(F.lit(1)).alias("n"))


def ends(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """First and last key with their values."""
    return visible(log, snapshot).agg(F.min("k").alias("first_k"), F.min_by("v", "k").alias("first_v"), F.max("k").alias("last_k"), F.max_by("v", "k").alias("last_v"))


def limit(log: DataFrame, n: int, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    return scan(log, snapshot, reverse).limit(n)


def seek(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """For each distinct probe the first visible key not below it and the last one below it: probe, ceil_k, ceil_v, floor_k."""
    told = nearest(visible(log, snapshot).select("k", "v"), probes)
    return told.select(F.col("k").alias("probe"), F.col("ceil.k").alias("ceil_k"), F.col("ceil.v").alias("ceil_v"), F.col("floor.k").alias("floor_k"))


def unique(rows: DataFrame, key: Column | str = "k") -> DataFrame:
    """Keys that occur more than once, which an ordered map does not allow."""
    return rows.groupBy(key).count().filter("count > 1")


def checked(rows: DataFrame, key: Column | str = "k") -> DataFrame:
    """rows, or InvalidArgument if a key occurs more than once."""
    twice = unique(rows, key).first()
    if twice is not None:
        raise InvalidArgument(f"key {twice[0]!r} occurs {twice[1]} times")
    return rows
