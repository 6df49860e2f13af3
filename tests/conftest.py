from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"file://{shared}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(v):
    if str(v) in ("None", "nan", "NaT", "<NA>"):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def canonical():
    """Rows of a pandas table, whatever their order and that of the columns."""

    def of(frame):
        columns = sorted(frame.columns)
        return columns, sorted(tuple(map(_cell, row)) for row in frame[columns].itertuples(index=False, name=None))

    return of
