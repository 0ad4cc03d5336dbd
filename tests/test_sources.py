"""The store, log records, blocks, cache, async calls and streams."""

import pytest
from pyspark.sql import functions as F

from kvlake.errors import AlreadyExists, AsyncError, CompressionError, Corruption, InvalidArgument, LockError, NotFound, NotSupported
from kvlake.functions import bytestrings as B
from kvlake.functions import columns as C
from kvlake.sources import block, codecs, tables, wal
from kvlake.sources.async_store import AsyncStore
from kvlake.sources.cache import Lru
from kvlake.sources.store import Options, Store
from kvlake.streaming.changes import write_stream


def test_store_history(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path)
    s.write(spark.createDataFrame([(i, 1, f"xx{i}", str(110 + i)) for i in range(1, 6)], "pos long, typ int, k string, v string"))
    s.delete("xx2")
    s = Store(spark, path)
    s.delete("xx5")
    s = Store(spark, path)
    ss = s.snapshot()
    s.put("xx4", "222")
    ss2 = s.snapshot()
    assert [s.get(k, ss) for k in ("xx3", "xx2", "xx5", "xx4")] == ["113", None, None, "114"]
    assert s.get("xx4", ss2) == "222"
    assert [r.k for r in s.scan().collect()] == ["xx1", "xx3", "xx4"]
    s.compact()
    assert s.get("xx4", ss) == "114" and s.get("xx4") == "222" and s.get("xx2") is None
    assert len(s.delete_obsolete()) == 4 and len(s.runs()) == 1
    again = Store(spark, path)
    assert [again.get(k) for k in ("xx3", "xx4", "xx2")] == ["113", "222", None]
    assert again.last_sequence() == 8


def test_open_modes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(NotFound):
        Store(spark, path, Options(create_if_missing=False))
    Store(spark, path)
    with pytest.raises(AlreadyExists):
        Store(spark, path, Options(error_if_exists=True))
    with pytest.raises(InvalidArgument):
        Store(spark, path, Options(comparator="reversed"))
    assert Store(spark, path).scan().collect() == []


def test_async(spark, tmp_path):
    a = AsyncStore(Store(spark, f"file://{tmp_path}/a"))
    a.put("k", "1").result()
    ref = a.get_snapshot().result()
    a.put("k", "2").result()
    assert (a.get_at(ref, "k").result(), a.get("k").result()) == ("1", "2")
    a.drop_snapshot(ref).result()
    with pytest.raises(AsyncError):
        a.get_at(ref, "k").result()
    a.close().result()
    with pytest.raises(AsyncError):
        a.get("k")


def test_log_records():
    records = [b"", b"x" * 10, b"y" * 100_000, bytes(wal.BLOCK - 7 - 5), b"z"]
    data = wal.encode(records)
    assert list(wal.decode(data)) == records
    broken = bytearray(data)
    broken[30] ^= 1
    with pytest.raises(Corruption):
        list(wal.decode(bytes(broken)))
    assert list(wal.decode(data[:-1])) == records[:-1]


def test_log_files(spark, tmp_path):
    ops = [(1, b"abc", b"def"), (1, b"123", b"456"), (1, b"xxx", b"yyy"), (0, b"zzz", None), (0, b"010", None)]
    assert len(wal.encode_batch(1, ops)) == 49 and wal.decode_batch(wal.encode_batch(7, ops)) == (7, ops)
    (tmp_path / "000003.log").write_bytes(wal.encode([wal.encode_batch(7, ops), b"short"]))
    cut = bytearray(wal.encode([wal.encode_batch(20, ops[:1]), wal.encode_batch(21, ops)]))
    cut[-1] ^= 1
    (tmp_path / "000004.log").write_bytes(cut)
    rows = wal.read_logs(spark, f"file://{tmp_path}/*.log").orderBy("file", "seq").collect()
    assert [(r.seq, r.typ, bytes(r.k)) for r in rows if not r.bad and r.file.endswith("3.log")] == [(7 + i, t, k) for i, (t, k, _) in enumerate(ops)]
    assert [(r.seq, r.bad) for r in rows if r.file.endswith("4.log")] == [(None, True), (20, False)]


def test_blocks():
    keys = ["key1", "loooooooooooooooooooooooooooooooooongerkey1", "medium length key 1", "prefix_key1", "prefix_key2", "prefix_key3"]
    rows = [(k.encode(), b"value") for k in keys]
    for restart in (1, 3, 16):
        made = block.build(rows, restart)
        assert list(block.entries(made)) == rows
        for k, v in rows:
            assert block.seek(made, k) == (k, v)
        assert block.seek(made, b"m") == rows[2] and block.seek(made, b"z") is None and block.seek(made, b"") == rows[0]
    assert list(block.entries(block.build([]))) == [] and block.seek(block.build([]), b"a") is None
    with pytest.raises(InvalidArgument):
        block.build([(b"b", b""), (b"a", b"")])
    assert block.unseal(block.seal(made)) == made
    with pytest.raises(Corruption):
        block.unseal(b"x" + block.seal(made)[1:])


def test_cache():
    c = Lru(3)
    for k in (123, 332, 521, 372, 899):
        c.put(k, str(k))
    assert [c.get(k) for k in (123, 332, 521, 372, 899)] == [None, None, "521", "372", "899"]


def test_column_functions(spark):
    names = ["CURRENT", "LOCK", "LOG", "LOG.old", "MANIFEST-01234", "001122.sst", "001122.ldb", "001122.dbtmp", "xyz.LOCK", "01a.sst", "0011.abc", "MANIFEST-trolol"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(C.file_type(F.col("n")).alias("t"), C.file_number(F.col("n")).alias("i"))
    assert [(r.t, r.i) for r in df.collect()] == [("current", 0), ("lock", 0), ("infolog", 0), ("infolog", 0), ("descriptor", 1234), ("table", 1122), ("table", 1122), ("temp", 1122)] + [(None, None)] * 4
    raw = [b"", b"abc", bytes(32), b"\xff" * 32, None, b"x" * 1000, b"y" * 300_000, b"\xff\x00", b"a\xffb", b"\xfe"]
    got = spark.createDataFrame([(r,) for r in raw], "r binary").coalesce(1).select(B.crc32c_col("r").alias("c"), B.bloom_hash_col("r").alias("h"), B.short_successor_col("r").alias("s")).collect()
    assert [(r.c, r.h, r.s) for r in got] == [(None, None, None) if r is None else (B.crc32c(r), B.bloom_hash(r), B.short_successor(r)) for r in raw]


OPS = "pos long, typ int, k string, v string"


def test_stream_is_written_once(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(store):
        stream = spark.readStream.schema(OPS).parquet(f"{tmp_path}/in")
        write_stream(stream, store, f"file://{tmp_path}/c").awaitTermination()

    path = f"file://{tmp_path}/s"
    s = Store(spark, path)
    arrive(0, [(0, 1, "a", "1"), (1, 1, "b", "2"), (2, 0, "a", None)])
    run(s)
    assert [(r.k, r.v) for r in s.scan().collect()] == [("b", "2")]
    s.put("other", "x")  # edits between batches, and another opening of the store
    s.compact()
    arrive(1, [(0, 1, "c", "3")])
    run(Store(spark, path))
    assert [r.k for r in Store(spark, path).scan().collect()] == ["b", "c", "other"]
    last = Store(spark, path).last_sequence()
    for commit in [*(tmp_path / "c" / "commits").glob("*1"), *(tmp_path / "c" / "commits").glob(".1*")]:  # a failure after the write and before the stream's own commit
        commit.unlink()
    run(Store(spark, path))
    assert Store(spark, path).last_sequence() == last
    Store(spark, path).checkpoint()
    assert Store(spark, path).streams() == {f"file://{tmp_path}/c": 1}


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    a, b = Store(spark, path), Store(spark, path)
    a.put("k", "a")
    b.put("k", "b")  # sees that edit 1 is taken, and comes second
    assert b.last_sequence() == 2 and b.get("k") == "b" and Store(spark, path).get("k") == "b"
    stubborn = Store(spark, path, Options(retries=0))
    a.refresh()
    a.put("k", "c")
    with pytest.raises(LockError):
        stubborn.put("k", "d")
    stubborn.put("k", "d")
    assert Store(spark, path).get("k") == "d" and Store(spark, path).last_sequence() == 4


def test_checkpoints_of_the_history(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    s = Store(spark, path, Options(checkpoint_edits=3))
    for i in range(7):
        s.put(f"k{i}", str(i))
    assert len(s.edits) <= 4
    again = Store(spark, path)
    assert len(again.edits) <= 4 and again.last_sequence() == 7 and [r.k for r in again.scan().collect()] == [f"k{i}" for i in range(7)]
    s.compact()
    s.delete_obsolete()
    assert len(list((tmp_path / "h" / "edits").glob("*.json"))) <= 4
    assert Store(spark, path).get("k3") == "3" and sum(Store(spark, path).rows().values()) == 7


def test_maintenance_by_tiers(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/m", Options(level0_runs=3, auto_compact=True))
    s.write(spark.range(50).selectExpr("id AS pos", "1 AS typ", "concat('b', id) AS k", "'x' AS v"))
    big = s.runs()[0]
    s.put("a", "1")
    s.delete("b7")
    assert len(s.runs()) <= 3
    s.put("a", "2")
    s.put("a", "3")
    assert big in s.runs() and len(s.runs()) <= 3  # the large run is left alone, and so deletions stay
    assert s.get("b7") is None and s.get("a") == "3" and s.scan().count() == 50
    s.compact()
    assert s.runs() != [big] and len(s.runs()) == 1 and s.log().count() == 50


def test_recovery_from_logs(spark, tmp_path):
    batch = wal.WriteBatch()
    batch.put(b"abc", b"old")
    batch.put(b"abc", b"def")
    batch.delete(b"xyz")
    other = wal.WriteBatch()
    assert other.set_contents(batch.encode(7)) == 7 and list(other) == list(batch) and batch.byte_size() == len(batch.encode(0)) and len(batch) == 3
    (tmp_path / "000001.log").write_bytes(wal.encode([batch.encode(1)]))
    s = Store(spark, f"file://{tmp_path}/r")
    assert s.recover(f"file://{tmp_path}/*.log") == 3 and s.get("abc") == "def" and s.get("xyz") is None
    assert s.recover(f"file://{tmp_path}/*.log") == 0 and s.last_sequence() == 3
    batch.clear()
    batch.put(b"n", b"1")
    cut = bytearray(wal.encode([batch.encode(4), batch.encode(5)]))
    cut[-1] ^= 1
    (tmp_path / "000002.log").write_bytes(cut)
    with pytest.raises(Corruption):
        s.recover(f"file://{tmp_path}/*.log")
    assert s.recover(f"file://{tmp_path}/*.log", paranoid=False) == 1 and s.get("n") == "1" and s.last_sequence() == 4


def test_cursor(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/c")
    s.write(spark.range(7).selectExpr("id AS pos", "1 AS typ", "concat('k', id) AS k", "string(id) AS v"))
    c = s.cursor(page=3)
    s.delete("k3")
    assert not c.valid() and c.current() is None and not c.prev()
    assert [k for k, _ in c] == [f"k{i}" for i in range(7)] and not c.valid()  # as of when it was made
    c.seek("k4")
    assert c.current() == ("k4", "4") and c.prev() and c.current() == ("k3", "3") and c.advance() and c.advance() and c.current()[0] == "k5"
    c.seek_to_last()
    assert c.current()[0] == "k6" and not c.advance()
    c.seek_to_first()
    assert c.current()[0] == "k0" and not c.prev() and not c.valid()
    c.seek("z")
    assert not c.valid()
    c.reset()
    assert c.advance() and c.current()[0] == "k0"


def test_table_files(spark, tmp_path):
    rows = [(f"k{i % 90:03d}", i + 1, int(i % 7 > 0), f"v{i}" if i % 7 else None) for i in range(900)]
    log = spark.createDataFrame(rows, "k string, seq long, typ int, v string").repartition(3)
    made = tables.write_tables(log, rows_per_table=200).cache()
    parts = sorted(made.collect())
    assert len(parts) > 2 and all(a.largest < b.smallest for a, b in zip(parts, parts[1:])) and sum(p.entries for p in parts) == 900
    names = tables.save_tables(made, f"file://{tmp_path}/t")
    back = tables.load_tables(spark, f"file://{tmp_path}/t/*.ldb").selectExpr("string(k) AS k", "seq", "typ", "string(v) AS v")
    assert len(names) == len(parts) and sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    assert tables.write_tables(log.limit(0)).collect() == []


def test_codecs():
    for n in codecs.CODECS:
        assert codecs.unpack(n, codecs.pack(n, b"abc" * 100)) == b"abc" * 100 and codecs.unpack(n, codecs.pack(n, b"")) == b""
    with pytest.raises(NotSupported):
        codecs.pack(99, b"")
    with pytest.raises(NotSupported):
        codecs.register(1, codecs.CODECS[0])
    for n in (1, 2, 4):
        with pytest.raises(CompressionError):
            codecs.unpack(n, b"\xff\xff\xff")


def test_blocks_backwards():
    rows = [(f"k{i:03d}".encode(), b"v") for i in range(20)]
    for restart in (1, 3, 16, 50):
        made = block.build(rows, restart)
        assert list(block.backwards(made)) == rows[::-1]
        assert block.before(made, b"k007") == rows[6] and block.before(made, b"k") is None and block.before(made, b"z") == rows[-1]
    assert list(block.backwards(block.build([]))) == []


def test_ranges_of_many_parts(spark):
    from kvlake.operators import ordered

    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "id AS n")
    for parts in (1, 5, 40):
        cut = ordered.ranges(df, ["k"], parts)
        got = sorted((r.k, r.r) for r in df.select("k", cut.of(["k"]).alias("r")).collect())
        assert [r for _, r in got] == sorted(r for _, r in got) and len({r for _, r in got}) == parts
        told = ordered.running_sum(df, ["k"], F.col("k"), "s", parts).collect()
        assert all(r.s == r.k * (r.k - 1) // 2 for r in told)
    near = ordered.nearest(df.filter("k % 10 = 0").select("k", "n"), df.select("k"), 40).collect()
    assert all((r.ceil.k if r.ceil else None) == (-(-r.k // 10) * 10 if r.k <= 4990 else None) and (r.floor.k if r.floor else None) == ((r.k - 1) // 10 * 10 if r.k else None) for r in near)


def test_islands_of_ranges(spark):
    import random

    from kvlake.operators import compact, meta, ordered

    r = random.Random(4)
    rows = [(a := r.randrange(2000), a + r.choice([0, 1, 3, 9]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "smallest long, largest long, num long")
    want, reach = [], None
    for lo, hi, _ in sorted(rows):
        if reach is None or lo > reach:
            want.append([lo, hi])
        want[-1][1] = reach = max(want[-1][1], hi)
    assert sorted(map(list, compact.merged_ranges(df).collect())) == want
    probes = spark.range(2100).withColumnRenamed("id", "k")
    held = {(x.k, x.num) for x in meta.holding(df.withColumn("level", F.lit(0)), probes).collect()}
    assert held == {(k, n) for lo, hi, n in rows for k in range(lo, min(hi, 2099) + 1)}
    plan = meta.holding(df.withColumn("level", F.lit(0)), probes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ordered.at_or_below(df.groupBy("smallest").agg(F.max("largest").alias("largest")).withColumnRenamed("smallest", "k"), probes).count() == 2100


def test_hot_key_is_compacted_before_the_shuffle(spark):
    from kvlake.operators import compact

    log = spark.range(3000).selectExpr("'hot' AS k", "id + 1 AS seq", "1 AS typ", "id AS v")
    out = compact.compact(log, 2000)
    assert out.count() == 1001 and out.agg(F.min("seq")).first()[0] == 2000
    assert "Window" not in out._jdf.queryExecution().toString()


def test_command_line(spark, tmp_path, capsys):
    from kvlake.__main__ import main

    path = f"file://{tmp_path}/cli"
    with pytest.raises(NotFound):
        main([path, "get", "a"], spark)
    for argv in (["put", "a", "1"], ["put", "b", "2"], ["put", "c", "3"], ["delete", "b"], ["compact"]):
        assert main([path, "--create", *argv], spark) == 0
    assert main([path, "get", "a"], spark) == 0 and capsys.readouterr().out == "1\n"
    assert main([path, "get", "b"], spark) == 1
    assert main([path, "iter", "--reverse"], spark) == 0 and capsys.readouterr().out == "c => 3\na => 1\n"
    assert main([path, "iter", "--low", "b"], spark) == 0 and capsys.readouterr().out == "c => 3\n"
