import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.autoBroadcastJoinThreshold", "256k").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


def rows(pdf):
    import pandas as pd

    return sorted(map(repr, (tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None))))


@pytest.fixture(scope="session")
def same():
    return lambda a, b: (sorted(a.columns) == sorted(b.columns)) and rows(a) == rows(b)
