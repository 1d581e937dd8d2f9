"""Every catalogue query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from skein.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, wanted = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["variant", "n_active", "comparability", "best_price"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_token_components_equal_union_find(spark, duck):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for part, supplier in duck.execute("select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem").fetchall():
        a, b = sorted((root(part), root(supplier)))
        parent[b] = a
    got = {r.node: r.component for r in catalogue.queries()["token_components"](spark, DATA).collect()}
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_commit_conformance(spark):
    assert [r for r in catalogue.queries()["commit_conformance"](spark, DATA).collect() if r.violations] == []
    made = catalogue.committed(spark, DATA)
    assert all(made[k].count() for k in ("listing", "decision", "product", "variant", "offer", "observation"))


def test_every_rule_of_the_resolution_is_met(spark):
    """The query's data reach the ladder's rules, so that its comparison with SQL covers them."""
    if os.path.isdir(DATA.replace("0.001", "0.01")):
        rules = {r.rule for r in catalogue.queries()["resolve_decisions"](spark, DATA.replace("0.001", "0.01")).select("rule").distinct().collect()}
        assert rules >= {"copied code", "products differ", "weak tie", "secondary", "pinned", "several", "fits"}, rules
