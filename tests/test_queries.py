"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from viaduct.plans import catalog

DIR = "/root/testdata/sf0.001"
SLOW = ("g22", "g32", "g33")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith(SLOW)))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLE_SQL:
        wanted = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
