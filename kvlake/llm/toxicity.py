"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Learning takes a bounded sample of the labelled rows (SAMPLE_ROWS, those of smallest hash), counts in how
many toxic and clean texts of it each hashed n-gram occurs, keeps the FEATURES n-grams whose counts tell
most, and fits a logistic regression to their presence times their log-count ratio. Scoring reads whole
texts where they lie, without a shuffle: the model is FEATURES numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.shared import drop, keep, release, steps

#: Labelled rows that the fit may use at most, hash buckets of n-grams, and n-grams that the model keeps.
SAMPLE_ROWS, BUCKETS, FEATURES = 12_000, 1 << 18, 2048
ORDERS = (3, 4, 5)
_PIECE = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """The hash bucket of each n-gram of the lower-cased text with a space at either end, in bounded pieces."""
    long = np.frombuffer(f" {text.lower()} ".replace("\n", " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(long), _PIECE):
        c = long[at : at + _PIECE + ORDERS[-1] - 1].astype(np.uint64) + np.uint64(1)
        h = c
        for n in range(2, ORDERS[-1] + 1):
            if len(c) < n:
                return
            h = h[:-1] * _PRIME + c[n - 1 :]
            if n in ORDERS:
                m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (m >> np.uint64(46)).astype(np.int32)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning; a null key is."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for b in steps(batches, 0):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen = np.zeros(BUCKETS, bool)
            for h in buckets_of(text or ""):
                seen[h] = True
            counts[toxic] += seen
    used = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "clean", "toxic"])


def _present(chosen: np.ndarray):
    many = len(chosen)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 0):
            bits = []
            for text in b.column(0).to_pylist():
                x = np.zeros(many, bool)
                for h in buckets_of(text or ""):
                    at = place[h]
                    x[at[at >= 0]] = True
                bits.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), b.column(1), b.column(2)], ["bits", "toxic", "k"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Nesterov steps on the mean log loss, the classes weighed by the root of their rarity, with an L2 penalty."""
    n = len(y)
    weigh = np.where(y == 1, (n / max(1.0, 2 * y.sum())) ** 0.5, 1.0)
    weigh /= weigh.sum()
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    step = 1.0 / (0.25 * float((np.einsum("ij,ij->i", x, x) + 1) @ weigh) + l2)
    weigh = weigh.astype(np.float32)  # x is a float32 matrix: a wider vector would copy it whole at each product
    y = y.astype(np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + np.float32(c), -30, 30)))
        d = weigh * (p - y)
        w2, b2 = v - np.float32(step) * (x.T @ d + np.float32(l2) * v), c - step * float(d.sum())
        m = k / (k + 3)
        v, c, w, b = w2 + np.float32(m) * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


class Model:
    """chosen buckets, their weights (regression times log-count ratio) and the bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(BUCKETS, np.float64)
        self.table[chosen] = weights
        self.bias = bias

    def score(self, text: str | None) -> float:
        seen = []
        for h in buckets_of(text or ""):
            w = self.table[h]
            seen.append(h[w != 0])
        hit = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int32)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.table[hit].sum(), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, l2: float = 1e-4, seed: int = 5) -> Model:
    """A model from labelled rows that are not held out.

    Labels without doc_id or toxic take no part; of repeated labels the higher counts. Documents that repeat a doc_id and
    text are read once; of those that repeat a doc_id each text is a row, within sample_rows. With one class only, or
    none, the model gives every text the share of toxic labels, and 0 without labels or documents.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    usable = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    sample = usable.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample_rows)
    chosen_rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))  # sample_rows rows of two numbers at most
    read = chosen_rows.select("text", F.col("__toxic").alias("toxic"), F.xxhash64("doc_id", "text").alias("k"))
    read = keep(read.dropDuplicates(["k"]).orderBy("k").limit(sample_rows), "sample")

    found = read.select("text", "toxic").mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = found.toPandas().sort_values("bucket")  # BUCKETS rows at most
    n = read.groupBy("toxic").count().collect()
    many = {r["toxic"]: r["count"] for r in n}
    n0, n1 = many.get(0, 0), many.get(1, 0)
    if not n0 or not n1:
        drop(read)
        share = n1 / max(1, n0 + n1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    clean, toxic = got["clean"].to_numpy(float), got["toxic"].to_numpy(float)
    p, q = (toxic + 1) / (n1 + 2), (clean + 1) / (n0 + 2)
    ratio = np.log(p / (1 - p) / (q / (1 - q)))
    mean = (toxic + clean) / (n0 + n1)
    tells = (p - q) ** 2 / (mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-4)
    best = np.argsort(-tells, kind="stable")[:features]
    chosen, ratio = got["bucket"].to_numpy()[best].astype(np.int64), ratio[best]

    rows = read.mapInArrow(_present(chosen), "bits binary, toxic int, k long").toPandas().sort_values(["k", "toxic"])  # sample_rows * features bits at most
    drop(read)
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(chosen)].astype(np.float32)
    x *= ratio.astype(np.float32)
    w, b = _logistic(x, rows["toxic"].to_numpy(np.float64), l2)
    return Model(chosen, w * ratio, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with toxic_score; null texts score as empty ones. A column of that name is replaced.

    Rows are scored each by itself: null and repeated ids make no difference, equal texts score alike, and an empty table
    gives no rows. The model goes to the tasks with the code.
    """
    docs = docs.drop("toxic_score")
    chosen = np.flatnonzero(model.table)
    weights, bias = model.table[chosen], model.bias

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(chosen, weights, bias)
        for texts in batches:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.float64())
        release()

    return docs.withColumn("toxic_score", scores(F.coalesce("text", F.lit(""))))
