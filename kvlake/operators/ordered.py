"""Order-dependent operators without a single task: rows are cut into key ranges, each is ordered by its own task, and one
row per range carries what crosses from one range to the next. How many ranges there are follows from the number of rows.

Where ranges begin is sampled once, a bounded number of keys, and stands in the plan as a constant: every branch that
reads the cut, and every task that is run again, sees the same ranges, so nothing need be written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_P = "__range"
#: Keys sampled for each range; up to so many ranges are found by one expression, a tree of comparisons, which the JVM leaves uncompiled if it is longer.
SAMPLED, FEW = 32, 8
#: Rows of a range, and the most ranges, as each is a constant in the plan: past ROWS * MOST rows ranges are longer and their sorts spill.
ROWS, MOST = 1 << 20, 8192
#: What Catalyst takes for no larger than ONE_RANGE bytes is one range without a sample. Its bytes are those of compressed files.
FIRST, ONE_RANGE = 512 * SAMPLED, 1 << 20


def _key(order: list) -> Column:
    return F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])


def _from(key: list[Column], start: tuple, types: list) -> Column:
    """Whether a key is at or after the start, column by column, nulls first; null counts as no."""
    out = F.lit(True)
    for k, v, t in reversed(list(zip(key, start, types, strict=True))):
        past, same = (k.isNotNull(), k.isNull()) if v is None else (k > F.lit(v).cast(t), k == F.lit(v).cast(t))
        out = past | (same & out)
    return out


@dataclass(frozen=True)
class Ranges:
    """Keys at which the second and later ranges begin, constants of a plan, and the types of their columns."""

    starts: list[tuple] | None = None
    types: list | None = None

    @property
    def many(self) -> int:
        return len(self.starts or ()) + 1

    def of(self, order: list) -> Column:
        """The number of the range that a row is in, from 0."""
        if self.starts is None:
            return F.lit(0)
        if self.many <= FEW:
            key = [F.col(o) if isinstance(o, str) else o for o in order]

            def between(low: int, high: int) -> Column:
                mid = (low + high) // 2
                return F.lit(low) if low == high else F.when(_from(key, self.starts[mid], self.types), between(mid + 1, high)).otherwise(between(low, mid))

            return between(0, len(self.starts))
        steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(self.starts).bit_length()))])
        key, starts = _key(order), self._whole(self.starts)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step - 1) <= key, at + step).otherwise(at))

    def _whole(self, starts: list[tuple]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(row, self.types, strict=True))]) for row in starts])

    def _reached(self, starts: list[tuple], at: Column, key: list[Column]) -> Column:
        """Whether a key is at or after starts[at]; not true past the last."""
        if any(v is None for row in self.starts for v in row):
            return F.get(self._whole(starts), at) <= _key(key)
        out = None
        for k, values, t in reversed(list(zip(key, zip(*starts, strict=True), self.types, strict=True))):
            start = F.get(F.array(*[F.lit(v).cast(t) for v in values]), at)
            out = k >= start if out is None else (k > start) | ((k == start) & out)
        return out

    def place(self, df: DataFrame, order: list, name: str = _P) -> DataFrame:
        """df with the range of each row, as of() has it. Of many ranges each level of the tree is a projection of its own with that
        level's starts, so the code of each is short and compiled.
        """
        if self.many <= FEW:
            return df.withColumn(name, self.of(order))
        keys = {f"__key{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
        rows = df.withColumns(keys).withColumn(name, F.lit(0))
        for width in (1 << n for n in range(len(self.starts).bit_length(), 0, -1)):
            right = self._reached(self.starts[width // 2 - 1 :: width], F.col(name), [F.col(k) for k in keys])
            rows = rows.withColumn(name, F.col(name) * 2 + F.when(right, 1).otherwise(0))
        return rows.drop(*keys)


def cut_rows(df: DataFrame, order: list, cut: Ranges) -> DataFrame:
    """df with the range of each row, each range in a task of its own, whatever the session's number of tasks."""
    rows = cut.place(df, order)
    return rows if cut.starts is None else rows.repartitionById(cut.many, F.col(_P))


def ranges(df: DataFrame, order: list, parts: int | None = None, rows: int | None = None) -> Ranges:
    """Ranges with about as many rows each, `parts` if given, else of about `rows`, or ROWS; order: ascending columns. Small tables are one range."""
    if parts == 1 or parts is None and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_RANGE:
        return Ranges()
    drawn = df.select(_key(order).alias("o"), F.rand(7).alias("r"))
    many = parts * SAMPLED if parts else FIRST
    some = drawn.orderBy("r").limit(many).orderBy("o").collect()
    if len(some) < many:
        return Ranges()
    if parts is None:  # of n uniform numbers the m-th smallest is about m / n
        parts = min(math.ceil(many / max(x["r"] for x in some) / (rows or ROWS)), MOST)
        if parts * SAMPLED > many:
            return ranges(df, order, parts)
    types = [f.dataType for f in drawn.schema["o"].dataType.fields]
    picked = list(dict.fromkeys(tuple(some[i * many // parts]["o"]) for i in range(1, parts)))
    return Ranges(picked, types) if picked else Ranges()


def running(df: DataFrame, order: list, value: Column, name: str, how: str = "sum", cut: Ranges | None = None, parts: int | None = None) -> DataFrame:
    """df with the sum (0 if none) or max (null if none) of value over the rows before each; order must tell all rows apart for a defined result."""
    f = {"sum": F.sum, "max": F.max}[how]
    cut = cut or ranges(df, order, parts)
    valued = df.withColumn("__value", value)
    rows = cut.place(valued, order)
    if cut.starts is None:
        told = f("__value").over(Window.partitionBy(_P).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return rows.select(*df.columns, (F.coalesce(told, F.lit(0)) if how == "sum" else told).alias(name))
    inside = f("__value").over(Window.partitionBy(_P).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    each = rows.groupBy(_P).agg(f("__value").alias("__e"))
    before = each.select(F.col(_P).alias("__r"), f("__e").over(Window.orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    told = cut_rows(valued, order, cut).withColumn("__inside", inside).join(F.broadcast(before), F.col(_P) == F.col("__r"))  # a row per range
    both = F.coalesce("__inside", F.lit(0)) + F.coalesce("__before", F.lit(0)) if how == "sum" else F.greatest("__inside", "__before")
    return told.select(*df.columns, both.alias(name))


def running_sum(df: DataFrame, order: list, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over the rows before each."""
    return running(df, order, value, name, parts=parts)


def neighbours(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df(k, ...) with prev_k and next_k in key order."""
    found = ranges(df, ["k"], parts)
    cut = found.place(df, ["k"])
    inner, order = Window.partitionBy(_P).orderBy("k"), Window.orderBy(_P)
    if found.starts is None:
        return cut.withColumns({"prev_k": F.lag("k").over(inner), "next_k": F.lead("k").over(inner)}).drop(_P)
    edge = cut.groupBy(_P).agg(F.min("k").alias("__lo"), F.max("k").alias("__hi"))
    edge = edge.select(_P, F.lag("__hi").over(order).alias("__before"), F.lead("__lo").over(order).alias("__after"))
    near = cut_rows(df, ["k"], found).withColumns({"prev_k": F.lag("k").over(inner), "next_k": F.lead("k").over(inner)})
    return near.join(F.broadcast(edge), _P).withColumns({"prev_k": F.coalesce("prev_k", "__before"), "next_k": F.coalesce("next_k", "__after")}).drop(_P, "__before", "__after")


def nearest(hits: DataFrame, probes: DataFrame, parts: int | None = None) -> DataFrame:
    """For each distinct probe k: ceil, the first hit (struct with k) not below it, and floor, the last one below it.

    hits has unique k; both sides are merged in key order and a running window finds the neighbour, so there is no join by
    inequality.
    """
    columns = [F.col(c) for c in hits.columns]
    both = hits.select("k", F.struct(*columns).alias("hit"), F.lit(1).alias("side")).unionByName(probes.select("k").dropDuplicates().withColumn("side", F.lit(0)), allowMissingColumns=True)
    found = ranges(both, ["k"], parts)
    cut = found.place(both, ["k"])
    rows = (Window.unboundedPreceding, 0)
    up = F.last("hit", ignorenulls=True).over(Window.partitionBy(_P).orderBy(F.desc("k"), F.desc("side")).rowsBetween(*rows))
    down = F.last("hit", ignorenulls=True).over(Window.partitionBy(_P).orderBy("k", "side").rowsBetween(*rows))
    if found.starts is None:
        return cut.withColumns({"ceil": up, "floor": down}).filter("side = 0").select("k", "ceil", "floor")
    at = F.when(F.col("side") == 1, F.col("k"))
    edge = cut.groupBy(_P).agg(F.min_by("hit", at).alias("__lo"), F.max_by("hit", at).alias("__hi"))
    order = Window.orderBy(_P)
    edge = edge.select(
        _P,
        F.first("__lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
        F.last("__hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
    )
    told = cut_rows(both, ["k"], found).withColumns({"__ceil": up, "__floor": down}).filter("side = 0").join(F.broadcast(edge), _P)
    return told.select("k", F.coalesce("__ceil", "__after").alias("ceil"), F.coalesce("__floor", "__before").alias("floor"))


def at_or_below(hits: DataFrame, probes: DataFrame, parts: int | None = None) -> DataFrame:
    """For each distinct probe k: hit, the last hit (struct with k) at or below it, null if none."""
    near = nearest(hits, probes, parts)
    return near.select("k", F.when(F.col("ceil.k") == F.col("k"), F.col("ceil")).otherwise(F.col("floor")).alias("hit"))


def islands(rows: DataFrame, low: str, high: str, tie: list[str]) -> DataFrame:
    """rows with island, the `low` at which the closed ranges [low, high] that touch or overlap, one leading to the next, begin."""
    order = [low, high, *tie]
    cut = ranges(rows, order)
    reach = running(rows, order, F.col(high), "__reach", "max", cut)
    starts = reach.withColumn("__new", F.when(F.coalesce(F.col("__reach") < F.col(low), F.lit(True)), F.col(low)))
    told = running(starts, order, F.col("__new"), "__last", "max", cut)
    return told.withColumn("island", F.coalesce("__new", "__last")).drop("__reach", "__new", "__last")
