import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in sorted(Path(SMALL).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same_rows(spark_df, duck, sql):
    """Both results as sorted tuples by column name."""
    got = spark_df.collect()
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]

    def told(rows):
        return sorted(repr([r[c] for c in order]) for r in rows)

    assert told([r.asDict() for r in got]) == told(want)
