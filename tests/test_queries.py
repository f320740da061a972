"""Every query with SQL gives the SQL's rows, at the smallest scale."""

from __future__ import annotations

import decimal
import glob
import math
import os
from collections import Counter

import pytest

from thistle import graph_queries, more_queries, queries, service_queries

DATA = "/root/testdata/sf0.001"
ALL = {**graph_queries.QUERIES, **more_queries.QUERIES, **service_queries.QUERIES, **queries.QUERIES}
SQL = {**graph_queries.ORACLES, **more_queries.ORACLES, **service_queries.ORACLES, **queries.ORACLES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

#: The tables of the smallest scale have none of these.
MAY_BE_EMPTY = {"d2_tables", "d4_deep"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, duck, name):
    df = ALL[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert got == Counter(tuple(norm(row[at.index(c)]) for c in cols) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_the_others_run(spark, name):
    rows = ALL[name](spark, DATA).collect()
    assert rows or name in MAY_BE_EMPTY
    assert len(set(map(repr, rows))) == len(rows)


def test_merged_stars_give_the_same_rows(spark):
    from thistle.graph_queries import TABLE_QUERIES, tables_graph

    for name in ("j10_star", "a5_sum_avg_min_max", "f1_constant_subject", "j2_foreign_key", "j4_optional_filter"):
        tables, text, _ = TABLE_QUERIES[name]
        one, many = (Counter(tuple(norm(v) for v in r) for r in tables_graph(spark, DATA, *tables.split(), merge_stars=m).sparql(text).collect()) for m in (True, False))
        assert one == many


def test_plans(spark):
    """Filters and columns reach the scan, a star is one scan, a link one join."""
    from thistle.graph_queries import TABLE_QUERIES, tables_graph

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def plan(name):
        tables, text, _ = TABLE_QUERIES[name]
        return tables_graph(spark, DATA, *tables.split()).sparql(text)._jdf.queryExecution().executedPlan().toString()

    star = plan("j10_star")
    assert star.count("FileScan") == 1 and "Join" not in star and "GreaterThan(p_retailprice,950.0)" in star and "p_type" not in star.split("ReadSchema")[1]
    assert "EqualTo(o_orderkey,7)" in plan("f1_constant_subject")
    chain = plan("j2_foreign_key")
    assert chain.count("Join") == 1 and "CartesianProduct" not in chain and "NestedLoop" not in chain
