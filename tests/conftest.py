import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows_of(df):
    """Rows as comparable tuples in order, columns by name."""
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in r) for r in df.values.tolist()) if len(df) else []


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    def check(query, sql):
        a, b = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        x, y = (sorted(map(repr, rows_of(d))) for d in (a, b))
        assert x == y

    return check
