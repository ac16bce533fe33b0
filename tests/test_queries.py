"""Every registered query against independent SQL in DuckDB."""

import duckdb
import pytest

from lociweave.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in cur.fetchall())
    assert got == want


def test_no_filter_pushed_without_need(spark):
    """A filter without modifiers stays a plain predicate on the record's columns."""
    plan = QUERIES["filter_mapq_reversed"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "& 16" in plan and "CASE WHEN (mapq" not in plan
