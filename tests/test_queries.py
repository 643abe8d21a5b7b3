"""Every query with an oracle, on the smallest tables, against DuckDB; the others must run."""

import math
import os

import duckdb
import numpy as np
import pytest

from corpusloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    rows = catalog.QUERIES[name](spark, FOLDER)
    got = sorted(tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect())
    if name not in catalog.ORACLES:
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(rows.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
