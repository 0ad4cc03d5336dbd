"""A stream of operations into a store: each micro-batch is one write, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kvlake.sources.store import Store


def write_stream(ops: DataFrame, store: Store, checkpoint: str, once: bool = True, name: str | None = None) -> StreamingQuery:
    """ops(pos, typ, k, v) appended to store by foreachBatch; a batch that is tried again after a failure is not written twice.

    The edit of a batch names the stream (its checkpoint folder, or name) and the batch's number, and goes in with the batch's
    rows: a batch whose number the history holds is passed over, whatever other writers and compactions have added.
    """
    stream = name or checkpoint

    def upsert(batch: DataFrame, number: int) -> None:
        store.refresh()
        store.write(batch.select("pos", "typ", "k", "v"), (stream, number))

    out = ops.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
