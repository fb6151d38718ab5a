"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from gaugeflow.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.execute(ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    order = [c for c in names if got[c].dtype.kind != "f"] or names
    a, b = (x[names].sort_values(order + [c for c in names if c not in order]).reset_index(drop=True) for x in (got, want))
    for c in names:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert a[c].astype(str).equals(b[c].astype(str)), c
