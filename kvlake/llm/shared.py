"""Tables that cut lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SCRATCH: list[list[DataFrame]] = []
#: Bytes of text that a worker turns into Python objects at a time.
STEP_BYTES = 2 << 20


def steps(batches: Iterator[pa.RecordBatch], column: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of some `most` bytes of text: what a whole batch becomes in Python is many times its text. At the end the worker's free memory is given back."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
    release()


def release() -> None:
    """Workers outlive their tasks: what they have freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset in local mode, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="kvlake-"))


@contextmanager
def scratch() -> Iterator[None]:
    """Tables kept inside go at the end, those with hold aside: for steps whose result is written meanwhile."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        drop(*_SCRATCH.pop())


def keep(df: DataFrame, name: str, hold: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors without redoing it.

    The table stays until drop(), or until the scratch() around it ends, as plans made of it may run at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kvlake/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)  # a writer holds a row group in memory
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    if _SCRATCH and not hold:
        _SCRATCH[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by keep() that no later plan reads."""
    for table in tables:
        path = getattr(table, "kept_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def running(df: DataFrame, order: str, value: str, name: str, upto: int, group: tuple[str, ...] = (), together: int = 4096) -> DataFrame:
    """df with the sum of `value` over the rows of lower `order` in its group; orders are longs from 0 below `upto` that tell a group's rows apart.

    Sums go over runs of `together` orders, then over runs of those, and so on, so that no task holds more of a group than a run.
    """
    if upto <= together:
        own = Window.partitionBy(*group).orderBy(order) if group else Window.partitionBy(F.lit(0)).orderBy(order)
        return df.withColumn(name, F.sum(value).over(own) - F.col(value))
    run = f"__run{upto}"
    cut = df.withColumn(run, F.floor(F.col(order) / together).cast("long"))
    sums = running(cut.groupBy(*group, run).agg(F.sum(value).alias("__s")), run, "__s", "__before", -(-upto // together), group, together)
    before = sums.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col(run).alias("__r"), "__before")
    inside = F.sum(value).over(Window.partitionBy(*group, run).orderBy(order)) - F.col(value)
    on = [F.col(run) == F.col("__r"), *(F.col(g) == F.col(f"__g_{g}") for g in group)]
    return cut.withColumn("__inside", inside).join(before, on).select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words are runs of anything but these six; bytes.split() and the SQL pattern agree on them.
WORD_GAP = r"[\x20\x09-\x0D]+"
