"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters rows over memory-sized buckets by a seeded hash; pass two gathers a run of buckets in each task, puts each
in the order of a second seeded hash, and shuffles it there by Fisher-Yates swaps, which is what the seeded function
`shuffle` does to an array. A row's place in the whole order alone decides its shard (law `rows`).

How many buckets and tasks there are depends on the bytes of the table alone, so settings of the cluster do not
change the result. A bucket is shuffled where it is written: a task that is run again after a lost executor writes the
whole of its buckets, so no row is lost or comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.shared import keep, running

#: Bytes of text in a bucket. A task gets TASK_BYTES of buckets, or of a very large table a TASKS-th, up to MOST_BYTES; the
#: aggregation that gathers them holds 128 buckets at most and sorts the rest on disk.
BUCKET_BYTES, TASK_BYTES, MOST_BYTES, TASKS = 4 << 20, 32 << 20, 2 << 30, 40_000


def size_of(text="text"):
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffle_to_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id") -> DataFrame:
    """Every row of docs, with shard_size, shard and slot; shards' row counts differ by one at most.

    Row i of the shuffled whole goes to shard i mod `shards`, slot i div `shards`, so slots are gapless from 0.
    Null texts count 16 bytes. Rows are scattered by key and text, so null or repeated keys, and equal texts, spread
    over the buckets; copies equal in both take their places in any order, which gives the same set of rows, and where
    they would fill a bucket they are dealt over several by their position in a table written once. An empty table gives
    no rows. Columns of docs named like a new one are replaced.
    """
    docs = docs.drop("shard_size", "shard", "slot")
    own = F.xxhash64(F.lit(seed), key, "text")
    same = keep(docs.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("n"), F.sum(size_of()).alias("bytes")), "same")
    total = same.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    each = max(1, min(MOST_BYTES, max(TASK_BYTES, total // TASKS)) // bucket_bytes)
    many = same.filter((F.col("n") > 1) & (F.col("bytes") * 4 > bucket_bytes))
    some = not many.isEmpty()
    if some:
        docs = keep(docs.withColumn("__at", F.monotonically_increasing_id()), "rows")
        parts = many.select(F.col("own").alias("__many"), F.least("n", F.ceil(F.col("bytes") * 4 / bucket_bytes)).alias("__parts"))
        docs = docs.join(parts, own == F.col("__many"), "left").withColumn("__piece", F.coalesce(F.pmod("__at", "__parts"), F.lit(0))).drop("__at", "__many", "__parts")
    piece = F.col("__piece") if some else F.lit(0).cast("long")
    bucket = F.pmod(F.xxhash64("__own", "__piece"), F.lit(buckets))
    scattered = docs.withColumns({"__own": own, "__piece": piece}).select(
        bucket.alias("__bucket"),
        F.xxhash64(F.lit(seed + 1), "__own", "__piece").alias("__order"),
        F.lit(None).cast("long").alias("__start"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "__piece"]).alias("__row"),
    )
    if some:
        counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    else:
        counts = same.select(F.pmod(F.xxhash64("own", F.lit(0).cast("long")), F.lit(buckets)).alias("__bucket"), "n").groupBy("__bucket").agg(F.sum("n").alias("__n"))
    starts = running(counts, "__bucket", "__n", "__start", buckets).select("__bucket", F.lit(None).cast("long").alias("__order"), "__start", F.lit(None).cast(scattered.schema["__row"].dataType).alias("__row"))
    both = scattered.union(starts).withColumn("__task", F.floor(F.col("__bucket") / each).cast("int"))
    dealt = both.repartitionById(-(-buckets // each), "__task").sortWithinPartitions("__task", "__bucket", "__order")
    held = dealt.groupBy("__task", "__bucket").agg(F.max("__start").alias("__start"), F.collect_list("__row").alias("__rows"))
    placed = held.select("__start", F.shuffle("__rows", seed).alias("__rows")).select("__start", F.posexplode("__rows").alias("__rank", "__row"))
    at = F.col("__start") + F.col("__rank")
    return placed.select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if c != "__piece"],
        size_of(F.col("__row")["text"]).alias("shard_size"),
        (at % shards).cast("int").alias("shard"),
        F.floor(at / shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, rows_per_file: int = 1 << 20, **how) -> None:
    """Write the shards as folders shard=N of Parquet files, each of some rows_per_file rows in slot order; a shard's files are written by as many tasks as it takes."""
    placed = shuffle_to_shards(docs, shards, **how)
    dealt = placed.withColumn("__file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "__file")
    dealt.sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
