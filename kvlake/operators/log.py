"""Writes: a store is an append-only log of (k, seq, typ, v); typ 0 deletes, typ 1 puts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.functions.columns import DELETE, PUT
from kvlake.operators.ordered import running_sum


def change_log(rows: DataFrame, key: Column, seq: Column, deletes: Column, value: Column) -> DataFrame:
    """Rows of any table as a log; a deletion carries no value, and a null value of a put stays a put."""
    gone = F.coalesce(deletes, F.lit(False))
    return rows.select(
        key.alias("k"),
        seq.cast("long").alias("seq"),
        F.when(gone, DELETE).otherwise(PUT).alias("typ"),
        F.when(~gone, value).alias("v"),
    )


def put(keys_values: DataFrame) -> DataFrame:
    """(k, v) as operations of a batch."""
    return keys_values.select("k", F.lit(PUT).alias("typ"), "v")


def delete(keys: DataFrame, value_type: str = "string") -> DataFrame:
    """(k) as deletions; deleting an absent key is no error."""
    return keys.select("k", F.lit(DELETE).alias("typ"), F.lit(None).cast(value_type).alias("v"))


def batch(ops: Column) -> Column:
    """An array of (typ, k, v) is a batch; its count is its size."""
    return F.size(ops)


def explode_batches(batches: DataFrame, last_seq: int = 0) -> DataFrame:
    """batches(batch_id, ops array<struct<typ,k,v>>) -> log rows, sequences in order of batch, then place in it.

    A batch's first sequence is one more than the operations before it, a running sum over ranges of batches.
    Of two operations on one key in a batch the later wins, as it has the higher sequence.
    """
    numbered = running_sum(batches, ["batch_id"], F.size("ops"), "base").withColumn("base", F.col("base") + F.lit(last_seq + 1))
    each = numbered.select("base", F.posexplode("ops").alias("pos", "op"))
    return each.select("op.k", (F.col("base") + F.col("pos")).cast("long").alias("seq"), "op.typ", "op.v")


def append(log: DataFrame, ops: DataFrame, order: list[str], last_seq: int) -> DataFrame:
    """The log with ops (k, typ, v and the order columns) after it, numbered on from last_seq.

    Ranks are made in two steps, inside ranges of the order and by a sum over range sizes, so no task holds all ops.
    """
    return log.unionByName(number(ops, order, last_seq).select("k", "seq", "typ", "v"))


def number(ops: DataFrame, order: list[str], last_seq: int = 0) -> DataFrame:
    return running_sum(ops, order, F.lit(1), "seq").withColumn("seq", (F.col("seq") + F.lit(last_seq + 1)).cast("long"))


def last_sequence(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("seq"))


def count_upsert(words: DataFrame) -> DataFrame:
    """Read-modify-write counters as one aggregation: (k, v) with v the number of rows of k."""
    return words.groupBy("k").agg(F.count(F.lit(1)).alias("v"))


def tokens(lines: DataFrame, text: str = "text") -> DataFrame:
    """Whitespace-separated words reduced to ASCII letters and digits in lower case; a word that leaves nothing counts as the empty word."""
    words = lines.select(F.explode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("w")).filter("w <> ''")
    return words.select(F.lower(F.regexp_replace("w", "[^A-Za-z0-9]", "")).alias("k"))
