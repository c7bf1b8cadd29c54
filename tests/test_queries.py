"""Every registered query against its SQL twin on the given tables."""

import pytest

from quorate.plans.catalog import load_all
from tools.check_oracles import compare, duck

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(MEDIUM)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 85


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["row_idx", "indicator", "prediction", "agreement", "uncertainty", "n_votes"]
    assert df.count() > 0
    assert e.queries().keys() >= QUERIES.keys() and e.oracle_sql().keys() >= ORACLES.keys()
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, MEDIUM)
    cur = con.execute(ORACLES[name])
    rows = [tuple(r) for r in df.collect()]
    assert rows, "no rows to compare"
    result = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
