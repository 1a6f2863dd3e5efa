import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def canonical(rows, columns):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or str(x) in ("nan", "<NA>", "NaT"):
            return "null"
        return str(x) if isinstance(x, (str, bool)) else repr(float(x)) if isinstance(x, (int, float)) else str(x)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)
