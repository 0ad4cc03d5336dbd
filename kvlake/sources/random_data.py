"""Random keys and values, the same on each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def alphanumeric(length: int, *seeds: Column) -> Column:
    """`length` letters and digits drawn by hashes of the seeds."""
    hexes = F.concat(*[F.sha2(F.concat_ws("/", F.lit(i), *[s.cast("string") for s in seeds]), 256) for i in range(-(-length // 64))])
    return F.substring(F.translate(hexes, "abcdef", "kqtwxz"), 1, length)


def key_values(spark: SparkSession, n: int, key_bytes: int = 16, value_bytes: int = 100, seed: int = 1) -> DataFrame:
    return spark.range(n).select(alphanumeric(key_bytes, F.lit(seed), F.col("id")).alias("k"), alphanumeric(value_bytes, F.lit(seed + 1), F.col("id")).alias("v"))
