"""What shows only on keys or tables larger than those of the test data."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kvlake.functions import columns as C
from kvlake.operators import meta, ordered
from kvlake.plans import catalog
from tests.conftest import same_rows


def test_lengths_of_large_numbers(spark, tmp_path):
    keys = "0, 11, 12, 127, 128, 16384, 185363, 185364, 900000, 2100000, NULL"
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE orders AS SELECT unnest([{keys}])::BIGINT AS o_orderkey")
    duck.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    same_rows(catalog.fn_varint_len(spark, str(tmp_path)), duck, catalog.SQL["fn_varint_len"])
    lengths = spark.range(63).select(C.varint_length(F.expr("shiftleft(1L, int(id))")).alias("n")).collect()
    assert [r.n for r in lengths] == [i // 7 + 1 for i in range(63)]  # the function's own lengths go on


def test_ranges_follow_rows_and_not_compressed_bytes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 10_000, raising=False)
    df = spark.range(200_000).selectExpr("nullif(id * 7919 % 200000, 5) AS k", "-id AS n")  # 3.2 MB for Catalyst
    for order in (["k"], ["k", -F.col("n")], [-F.col("n")]):
        cut = ordered.ranges(df, order)
        many = [r["count"] for r in df.groupBy(cut.of(order).alias("r")).count().collect()]
        assert 15 <= len(many) <= 25 and max(many) < 20_000
        found = ordered.cut_rows(df, order, cut).groupBy("__range", F.spark_partition_id().alias("task")).count().collect()
        assert len({r.task for r in found}) == len(found) == len(many)  # no task has two
    told = ordered.running_sum(df.filter("k IS NOT NULL"), ["k"], F.lit(1), "before")
    assert told.filter("before <> k - int(k > 5)").count() == 0
    near = ordered.neighbours(df.filter("k IS NOT NULL"))
    assert near.filter("NOT (prev_k <=> nullif(k - 1 - int(k = 6), -1) AND next_k <=> nullif(k + 1 + int(k = 4), 200000))").count() == 0
    monkeypatch.setattr(ordered, "FEW", 1)  # by bisection
    assert df.select(ordered.ranges(df, ["k"]).of(["k"]).alias("r"), "k").groupBy("r").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("hi - lo > 20000").count() == 0


def test_probes_meet_the_files_that_hold_them_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 10_000, raising=False)
    files = spark.range(3000).selectExpr("3 AS level", "id AS num", "20 * id AS smallest", "20 * id + 12 AS largest", "1L AS size").unionByName(
        spark.createDataFrame([(0, 9000, 5, 59_000, 1), (0, 9001, 300, 300, 1), (1, 9002, 7, 2, 1), (1, 9003, 100, 31_000, 1), (1, 9003, 100, 31_000, 1)], "level int, num long, smallest long, largest long, size long")
    )
    probes = spark.range(60_000).selectExpr("CASE WHEN id < 59000 THEN id WHEN id < 59990 THEN 300 END AS k")
    hits = meta.holding(files, probes)
    assert hits.filter("level = 3").count() == 13 * 2950 + 990  # of each 20 keys 13 are in a file, and so is 300, again and again
    assert hits.filter("k NOT BETWEEN 20 * num AND 20 * num + 12 AND level = 3").count() == 0
    assert [hits.filter(f"num = {n}").count() for n in (9000, 9001, 9002, 9003)] == [58_995 + 990, 991, 0, 2 * (30_901 + 990)]
    plan = hits._jdf.queryExecution()
    joins = re.findall(r"(?:Join|HashJoin) \[node#\d+L\]", plan.executedPlan().toString())
    assert joins, "probes and files meet by nodes"


def test_overlaps_are_found_once(spark):
    a = [(1, i, 1, 10 * i, 10 * i + 9) for i in range(40)] + [(1, 99, 1, 5, 300)]
    b = [(2, i, i, 7 * i, 7 * i + 6) for i in range(60)] + [(2, 99, 100, 100, 109), (2, 98, 1000, 0, 399)]
    files = spark.createDataFrame(a + b, "level int, num long, size long, smallest long, largest long")
    want = {x[1]: sum(y[2] for y in b if y[3] <= x[4] and y[4] >= x[3]) for x in a}
    got = meta.next_level_overlap(files).filter("level = 1").collect()
    assert {r.num: r.bytes for r in got} == want and len(got) == len(a)


@pytest.mark.parametrize("name", ["kv_append", "meta_output_split", "kv_flush_by_size"])
def test_no_task_orders_a_whole_table(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(ordered, "ROWS", 10_000, raising=False)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events AS SELECT i AS event_id, i * 7919 % 997 AS user_id, CASE WHEN i % 9 = 0 THEN 'error' ELSE 'view' END AS event_type, random() AS value FROM range(200000) r(i)")
    duck.execute("CREATE TABLE orders AS SELECT i * 7919 % 200000 AS o_orderkey, random() AS o_totalprice FROM range(200000) r(i)")
    for t in ("events", "orders"):
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    made = catalog.QUERIES[name](spark, str(tmp_path))
    same_rows(made, duck, catalog.SQL[name])
    dealt = re.findall(r"direct_shuffle_partition_id\(__range#\d+\), (\d+)", made._jdf.queryExecution().executedPlan().toString())
    assert dealt and min(map(int, dealt)) >= 15


def test_seek_charges_compare_within_nodes(spark):
    files = spark.createDataFrame([(0, 7, 1, 100, 200), (0, 8, 1, 150, 900), (2, 9, 1, 0, 149), (3, 10, 1 << 24, 0, 950)], "level int, num long, size long, smallest long, largest long")
    probes = spark.range(1000).withColumnRenamed("id", "k")
    made = meta.seek_charges(files, probes)
    assert {(r.level, r.num): (r.charges, r.allowed, r.due) for r in made.collect()} == {(0, 7): (50, 100, False), (0, 8): (751, 100, True), (2, 9): (100, 100, True)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "node#" in plan and "__cell" not in plan  # nothing is compared with a whole range


@pytest.mark.parametrize("nulls", [0, 10])
def test_no_code_that_places_rows_is_too_long_to_be_compiled(spark, monkeypatch, nulls):
    monkeypatch.setattr(ordered, "ROWS", 4000, raising=False)
    df = spark.range(200_000).selectExpr(f"CASE WHEN pmod(id, 97) >= {nulls} THEN id * 7919 % 1000 END AS k", "id AS seq", "1 AS v")
    order = ["k", -F.col("seq")]
    cut = ordered.ranges(df, order)
    assert 35 <= cut.many <= 64 and (cut.starts[0][0] is None) == (nulls > 0)
    placed = ordered.cut_rows(df, order, cut)
    many = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert placed.filter(F.col("__range") != cut.of(order)).count() == 0 and len(many) == cut.many and max(many) < 8000
    monkeypatch.setattr(ordered, "FEW", 64)  # all in one expression
    assert placed.filter(F.col("__range") != cut.of(order)).count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(ordered, "ROWS", 4000, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        codes = ordered.running_sum(df, order, F.lit(1), "before")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert max(sizes) < 8000, sizes  # bytes of a method; the JVM compiles none that are longer


def test_probes_of_seek_charges_are_not_sent_to_every_task(spark):
    files = spark.range(2000).selectExpr("3 AS level", "id AS num", "1L AS size", "20 * id AS smallest", "20 * id + 25 AS largest")
    probes = spark.range(40_010).withColumnRenamed("id", "k")
    made = meta.seek_charges(files, probes)
    assert made.agg(F.sum("charges")).first()[0] == 6 * 1999  # keys that two files hold
    plan = made._jdf.queryExecution().executedPlan()
    made.collect()
    ran = plan.toString().split("Initial Plan")[0]
    assert re.findall(r"(\w+Join) \[node#\d+L\]", ran) == ["SortMergeJoin"]
