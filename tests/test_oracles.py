"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from framesift.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if value != value:
        return "None"
    return f"{float(value):.5f}"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y and not close(x, y)]
    assert not wrong, wrong[:3]


def close(x, y):
    def same(p, q):
        try:
            return p == q or abs(float(p) - float(q)) < 2e-5
        except ValueError:
            return False

    return all(same(p, q) for p, q in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count()
