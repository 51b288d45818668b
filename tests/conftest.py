import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    root = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA, "documents.parquet").exists():
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(frame):
    """The rows of a pandas frame as sorted tuples of texts, columns by name."""

    def text(x):
        if x is None or x != x:
            return "N"
        if isinstance(x, float):
            return repr(round(x, 9))
        return str(x)

    return sorted(tuple(text(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
