"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from claimboard import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(spark, con, run, sql):
    df = run(spark, SF)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(spark, duck, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_wl_refine_splits_in_late_rounds(spark, tmp_path):
    lines = [(1, i, i + j, "F") for i in range(7) for j in (0, 1)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_partkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for _, c, q, _ in lines:
        near.setdefault(f"c{c}", []).append(f"q{q}")
        near.setdefault(f"q{q}", []).append(f"c{c}")
    colour = {v: int(v[0] == "q") for v in near}
    for _ in range(6):
        sign = {v: (colour[v], sorted(colour[u] for u in near[v])) for v in near}
        ranks = sorted({repr(s): s for s in sign.values()}.values())
        colour = {v: ranks.index(s) for v, s in sign.items()}
    got = {r["colour"]: r["nodes"] for r in plans.QUERIES["e1_wl_refine"](spark, str(tmp_path)).collect()}
    assert got == {c: list(colour.values()).count(c) for c in colour.values()} and len(got) == 8
