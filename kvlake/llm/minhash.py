"""Near-duplicate documents by b-bit MinHash.

Bands of whole minima give candidate pairs; the two low bits of each minimum, packed into four longs,
give a similarity corrected for chance collisions by counting bits; pairs that could reach the
threshold are confirmed on their full shingle sets.

No group is expanded into all its pairs. Texts with one shingle set are one class. Each band bucket is
first a star: its members are compared with its smallest class, and links join classes into components.
Buckets that still hold more than one component are then compared in blocks of bounded size: first by
signatures, 32 bytes each, then, of members that these leave a partner in another component, by texts, where a
union-find stops at what is already joined and only joining links leave the task. So no link between
components is lost, and a bucket of n near copies costs n rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.components import components
from kvlake.llm.shared import drop, keep, steps

WORDS = 5
HASHES, BANDS, ROWS = 128, 20, 5  # a pair at 0.85 shares no band once in 100,000 times, at 0.8 once in 3,000
SLACK = 6  # standard deviations of the b-bit estimate that a pair may fall short by before it is confirmed
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), 4096)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), 4096)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; tables of them grow as texts need."""
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(int(_BASE), 2 * n), _powers(pow(int(_BASE), -1, 1 << 64), 2 * n)
    return _UP[:n], _DOWN[:n]


_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_BAND = _rng.integers(0, 1 << 64, (1, ROWS), np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of raw, a polynomial over its bytes by differences of one running sum; first bytes; ends."""
    n = len(raw)
    up, down = powers(n)
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return mix((upto[end] - upto[start]) * down[start]), start, end


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word; long texts go in pieces that end between words."""
    if len(raw) <= _PIECE:
        return _hash_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        h, start, stop = _hash_words(raw[at:end])
        out.append((h, start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_hashes(text: str | None) -> np.ndarray:
    return word_spans((text or "").encode("utf-8", "surrogatepass").lower())[0]  # bytes.lower() changes A-Z only


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words the whole sequence is one; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < words:
        return mix((w * _MULTIPLY[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - words + 1
    total = np.full(n, np.uint64(words))
    for k in range(words):
        total += w[k : k + n] * _MULTIPLY[k]
    return np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        v = (x[at : at + 1024, None] ^ _XOR) * _ODD
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in steps(batches, 1):
        n, digest, bits, bands = [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            if not len(s):
                digest.append(None), bits.append(None), bands.append(None)
                continue
            m = minima(s)
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bits.append(np.packbits([m & 1, (m >> 1) & 1]).view(np.int64))
            bands.append(mix((m[: BANDS * ROWS].reshape(BANDS, ROWS) * _BAND).sum(axis=1)).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bits", "bands"])


def features(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for the quarter of minima that agree by chance."""
    differ = sum(F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k)).bitwiseOR(F.get(a, k + 2).bitwiseXOR(F.get(b, k + 2)))) for k in range(2))
    return ((F.lit(HASHES) - differ) / HASHES - 0.25) / 0.75


def lowest(threshold: float) -> float:
    """The estimate below which a pair at the threshold falls with a chance of SLACK standard deviations."""
    p = 0.25 + 0.75 * threshold
    return threshold - SLACK * (p * (1 - p) / HASHES) ** 0.5 / 0.75


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for b in steps(batches, 3):
            u, v, x, y = (c.to_pylist() for c in b.columns)
            ok = []
            for i in range(len(u)):
                if u[i] != last or of is None:
                    last, of = u[i], shingle_set(x[i])
                if alike(of, shingle_set(y[i]), percent):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in ok], pa.int64()), pa.array([v[i] for i in ok], pa.int64())], ["u", "v"])

    return run


def _likely(members: list[dict], apart: bool, percent: int) -> list[tuple[float, int, int]]:
    """(estimate, place, place) of the members of different components that may be alike, of different sides where `apart`."""
    bits = np.array([m["bits"] for m in members], np.int64).view(np.uint64)
    side, comp = (np.array([m[c] for m in members]) for c in ("side", "comp"))
    out = []
    for i in range(len(members) - 1):
        differ = np.bitwise_count((bits[i + 1 :, :2] ^ bits[i, :2]) | (bits[i + 1 :, 2:] ^ bits[i, 2:])).sum(axis=1)
        near = ((HASHES - differ.astype(float)) / HASHES - 0.25) / 0.75
        ok = (near >= lowest(percent / 100)) & (comp[i + 1 :] != comp[i])
        if apart:
            ok &= side[i + 1 :] != side[i]
        out += [(near[k], i, i + 1 + k) for k in np.flatnonzero(ok).tolist()]
    return out


_MEMBER = "band long, value long, i int, j int, rep long, comp long, bits array<long>, side int"


def _promising(percent: int):
    """The members of each block, or pair of blocks, that signatures leave a partner in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for band, value, i, j, members in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stay = {k for _, x, y in _likely(members, i != j, percent) for k in (x, y)}
                out += [(band, value, i, j, *(members[k][c] for c in ("rep", "comp", "bits", "side"))) for k in sorted(stay)]
            cells = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], [f.split()[0] for f in _MEMBER.split(", ")])

    return run


def _join_blocks(percent: int):
    """Links that join components within a block, or between the two blocks of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for pair, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets = [shingle_set(m["text"]) for m in members]
                up: dict[int, int] = {}

                def root(c: int) -> int:
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for _, i, j in sorted(_likely(members, pair["i"] != pair["j"], percent), key=lambda t: (-t[0], t[1], t[2])):  # the likeliest first: most of the rest is then joined
                    r, s = root(members[i]["comp"]), root(members[j]["comp"])
                    if r != s and alike(sets[i], sets[j], percent):
                        up[max(r, s)] = min(r, s)
                        us.append(members[i]["rep"])
                        vs.append(members[j]["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Linked are texts whose sets of 5-word shingles have 100 * intersection >= percent * union. Case of A-Z
    does not count. component_id is the smallest doc_id that links reach, its own included; kept marks that
    document. Texts that are null or without words have an empty set and are linked with nothing. A row
    without doc_id can't be linked: its component_id is null and it is kept. Rows that repeat a doc_id
    and text are one document, each with the same result. Ties don't arise; other columns are not read.
    Shingles are compared as 64-bit hashes.
    """
    feats = keep(features(docs), "features")
    named = feats.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bits", "bands")])
    classes = keep(reps, "classes")

    member = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    buckets = member.groupBy("band", "value").agg(
        F.min("rep").alias("centre"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("who"),
    ).filter("n > 1")
    # Bands that bring the same classes together count once.
    distinct = buckets.groupBy("centre", "far", "n", "who").agg(F.min(F.struct("band", "value")).alias("b"), F.min("size").alias("size"))
    buckets = keep(distinct.select("b.band", "b.value", "centre", "n", "size"), "buckets")
    # A bucket of very many classes can be split between tasks in these joins of tables, at any size of either.
    inside = keep(member.join(buckets.hint("merge"), ["band", "value"]).select("band", "value", "rep", "centre", "n", "size"), "members")

    of = classes.select(F.col("rep"), "bits")
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    pairs = inside.filter("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).dropDuplicates()
    pairs = pairs.join(of.select(F.col("rep").alias("u"), F.col("bits").alias("a")), "u").join(of.select(F.col("rep").alias("v"), F.col("bits").alias("b")), "v")
    pairs = pairs.filter(estimate(F.col("a"), F.col("b")) >= lowest(percent / 100)).select("u", "v")
    # Pairs grow with docs: texts come to them by the same plan at any size.
    near = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("x")).hint("merge"), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("y")).hint("merge"), "v")
    links = keep(near.select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long"), "links")
    comps = components(links)

    tagged = inside.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    parted = keep(tagged.filter("n > 2").groupBy("band", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "value"), "parted")
    rest = keep(tagged.join(parted.hint("merge"), ["band", "value"]).select("band", "value", "rep", "comp", "n", "size"), "rest")
    if not rest.isEmpty():
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
        own = rest.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        keys = ["band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
        signed = dealt.join(of, "rep").groupBy(*keys).agg(F.collect_list(F.struct("rep", "comp", "bits", F.col("own").alias("side"))).alias("members"))
        likely = keep(signed.mapInArrow(_promising(percent), _MEMBER), "likely")  # texts go only where signatures leave a pair
        groups = likely.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").groupBy("band", "value", "i", "j").agg(
            F.sort_array(F.collect_list(F.struct("rep", "comp", "bits", "side", "text"))).alias("members"),
        )
        more = groups.select(F.struct("i", "j").alias("pair"), "members").mapInArrow(_join_blocks(percent), "u long, v long")
        all_links = keep(links.union(more), "links")
        drop(comps)
        comps = components(all_links)
        drop(all_links, likely)
    drop(buckets, inside, parted, rest, links)
    whole = classes.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("d"), F.coalesce("comp", "rep").alias("component"))
    out = feats.select("doc_id", "n_shingles", "digest").join(whole, F.col("digest") == F.col("d"), "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(own_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose document stands for its component."""
    gone = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone")).dropDuplicates()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
