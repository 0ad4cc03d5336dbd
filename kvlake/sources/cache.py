"""A least-recently-used cache simulated over an access trace, each shard by itself."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Lru:
    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def get(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        return None

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)


def lru(trace: DataFrame, capacity: int) -> DataFrame:
    """trace(shard, pos, key) -> shard, pos, key, hit.

    A shard's accesses are a sequence by nature: one task reads them in order, with no more in memory than the cache and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = None, Lru(capacity)
        for b in batches:
            hits = []
            for shard, key in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != now:
                    now, cache = shard, Lru(capacity)
                hits.append(cache.get(key) is not None)
                cache.put(key, True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.bool_())], ["shard", "pos", "key", "hit"])

    ordered = trace.select("shard", "pos", "key").repartition("shard").sortWithinPartitions("shard", "pos")
    return ordered.mapInArrow(run, f"shard {trace.schema['shard'].dataType.simpleString()}, pos long, key {trace.schema['key'].dataType.simpleString()}, hit boolean")
