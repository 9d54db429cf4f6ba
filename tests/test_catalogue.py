"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidegauge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return round(value, 6)
    return [_norm(v) for v in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr([_norm(v) for v in r]) for r in df.select(*columns).collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted(repr([_norm(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
        assert rows == want
    else:
        assert rows


def test_no_row_udfs_or_products(spark, sf):
    for name in ("c4_current_readings", "a1_daily", "r1_index", "j1_resolve", "p1_profiles", "g2_refusals", "f2_f4_facts"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
