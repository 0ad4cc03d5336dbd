"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule takes the point frac((i + 1) * golden ratio) and maps it through the cumulative
target shares to a source; its rank among that source's slots names the block it takes. A source's
blocks are cut from its documents in a seeded order, once per epoch, three epochs at most, up to its target: the last
block is a part of one. What the points leave of a target, a few blocks at most, comes in slots after the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.shared import WORD_GAP, keep, running

#: Words in a block; and documents or slots that one task ranks together.
BLOCK_WORDS = 64
RANKED_TOGETHER = 20_000
#: Golden ratio less one in 31-bit fixed point, so that products stay within a long.
GOLDEN, MODULUS = 1327217885, 1 << 31


def word_count(text="text"):
    """Words of a text; null: 0."""
    gaps = F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP)
    ends = F.when(F.get(gaps, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(gaps) > 1) & (F.element_at(gaps, -1) == ""), 1).otherwise(0)
    return (F.size(gaps) - ends).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=(1.0, 2.0, 3.0), most: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size) -> (source, size, target): shares of the whole by weight, none above `most` times its size.

    Sources come by code point, null last, and take the weights in turn. What a capped source leaves
    is shared by weight among the others until none is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {i: weights[i % len(weights)] for i in range(len(order))}
    left, free, out = float(sum(n for _, n in order)), set(weight), {}
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if unit * weight[i] > most * order[i][1]}
        if not over:
            out |= {i: unit * weight[i] for i in free}
            break
        out |= {i: most * order[i][1] for i in over}
        left -= sum(most * order[i][1] for i in over)
        free -= over
    return [(*order[i], out[i]) for i in range(len(order))]


def _running(df: DataFrame, group: str, part: str, order: list, value: str, name: str, parts: int) -> DataFrame:
    """Running sum of `value` before each row of a group, in (part, order), parts being below `parts`: they are summed first, so no task holds a group."""
    before = running(df.groupBy(group, part).agg(F.sum(value).alias("__s")), part, "__s", "__before", parts, (group,))
    before = before.select(F.col(group).alias("__g"), F.col(part).alias("__p"), "__before")
    inside = F.sum(value).over(Window.partitionBy(group, part).orderBy(*order)) - F.col(value)
    return df.withColumn("__inside", inside).join(before, (F.col(group) == F.col("__g")) & (F.col(part) == F.col("__p"))).withColumn(name, F.col("__before") + F.col("__inside")).drop("__g", "__p", "__before", "__inside")


def schedule(docs: DataFrame, weights=(1.0, 2.0, 3.0), most: int = 3, block: int = BLOCK_WORDS, seed: int = 29) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, sized, sources) of the mix.

    pieces: slot, source_no, doc_id, row_no, epoch, first, words - in slot order this is the mix, each row a run of a
    document's words. sized: every row of docs as row_no, doc_id, source_no, size. sources: source_no, source,
    source_size, target. Only one row per source reaches the driver; a source needs a weight, so they are few.

    Each source's pieces add up to its target, rounded. Null and empty texts have size 0 and give no piece. Rows that
    repeat a doc_id are separate documents; rows with a null doc_id are ordered by text. Equal texts differ in order by
    doc_id. Rows equal in both are ordered together, in any order. An empty table, or texts without words, give no pieces.
    """
    spark = docs.sparkSession
    sized = keep(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "text").alias("__own")).withColumn("row_no", F.monotonically_increasing_id()), "sizes")
    told = targets([(s, int(n)) for s, n in sized.groupBy("source").agg(F.sum("size")).collect()], weights, most)
    total = sum(n for _, n, _ in told)
    sources = spark.createDataFrame([(i, s, n, float(t)) for i, (s, n, t) in enumerate(told)], "source_no int, source string, source_size long, target double")
    sized = sized.join(F.broadcast(sources.select("source_no", F.col("source").alias("__s"))), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "source")

    n_slots, ends, reached = total // block, [], 0.0
    for _, _, t in told:
        reached += t
        ends.append(reached / max(total, 1))
    point = F.pmod(F.pmod(F.col("id") + 1, F.lit(MODULUS)) * GOLDEN, F.lit(MODULUS)) / float(MODULUS)
    pick = F.lit(max((i for i, (_, _, t) in enumerate(told) if t > 0), default=0))
    for i in range(len(ends) - 1, -1, -1):
        if told[i][2] > 0:
            pick = F.when(point < ends[i], F.lit(i)).otherwise(pick)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), pick.alias("source_no"), F.floor(F.col("id") / RANKED_TOGETHER).alias("part"), F.lit(1).cast("long").alias("one"))

    spread = [max(1, n // (RANKED_TOGETHER * 50)) for _, n, _ in told]
    limits = F.broadcast(spark.createDataFrame([(i, p, round(t)) for i, (p, (_, _, t)) in enumerate(zip(spread, told, strict=True))], "source_no int, parts long, most long"))  # a row per source
    due = limits.select("source_no", F.floor((F.col("most") + (block - 1)) / block).alias("due"))
    late = due.join(slots.groupBy("source_no").count(), "source_no", "left").select("source_no", "due", F.coalesce("count", F.lit(0)).alias("n")).filter("n < due")
    late = late.select("source_no", F.explode(F.sequence("n", F.col("due") - 1)).alias("rank"))
    late = late.select((F.lit(n_slots) + F.col("rank") * len(told) + F.col("source_no")).alias("slot"), "source_no", "rank")
    slots = _running(slots, "source_no", "part", ["slot"], "one", "rank", n_slots // RANKED_TOGETHER + 1).select("slot", "source_no", "rank").union(late)

    epochs = F.explode(F.array(*[F.lit(e) for e in range(most)]))
    stream = sized.filter("size > 0").join(limits, "source_no").withColumn("epoch", epochs)
    stream = stream.withColumn("key", F.xxhash64(F.lit(seed), "epoch", "__own"))
    stream = stream.withColumn("part", F.col("epoch") * F.col("parts") + F.pmod(F.shiftright("key", 20), F.col("parts")))
    stream = _running(stream, "source_no", "part", ["key", "doc_id", "row_no"], "size", "at", most * max(spread, default=1)).filter(F.col("at") < F.col("most"))
    stream = stream.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("most")))
    cut = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest(F.col("rank") * block, F.col("at"))
    last = F.least((F.col("rank") + 1) * block, F.col("end"))
    cut = cut.select("source_no", "rank", "doc_id", "row_no", "epoch", (first - F.col("at")).alias("first"), (last - first).alias("words"))
    pieces = slots.join(cut, ["source_no", "rank"]).select("slot", "source_no", "doc_id", "row_no", "epoch", "first", "words")
    return pieces, sized.drop("__own"), sources


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: row_no, doc_id, size, source_no, source, source_size, target, taken (its words in the mix)."""
    pieces, sized, sources = schedule(docs, **how)
    taken = pieces.groupBy("row_no").agg(F.sum("words").alias("taken"))
    return sized.join(taken, "row_no", "left").join(F.broadcast(sources), "source_no").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, in whole documents: words taken over size, rounded half up.

    Documents that the mix leaves out, and texts without words, are not in the result. Rows of one doc_id
    share what is taken of it.
    """
    each = mix(docs, **how).groupBy("doc_id").agg(F.sum("taken").alias("__t"), F.sum("size").alias("__n"))
    times = each.filter("__t > 0").select(F.col("doc_id").alias("__id"), F.round(F.col("__t") / F.col("__n")).cast("int").alias("__times")).filter("__times > 0")
    copies = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
