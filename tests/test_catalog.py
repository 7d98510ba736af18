import os

import duckdb
import pytest

from tidewheel.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(found):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in found)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    listed = ",".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(catalog.SQL[name]).columns) == columns
    assert rows(df.select(*columns).collect()) == rows(duck.sql(f"SELECT {listed} FROM ({catalog.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["port_connect_all", "port_connect_discriminated_all"])
def test_ports_of_all_suppliers(spark, duck, name):
    sellers = {r[0] for r in duck.sql("SELECT DISTINCT 'u' || l_suppkey FROM lineitem").fetchall()}
    assert {r.upstream for r in catalog.QUERIES[name](spark, SF).collect()} == sellers
    assert len(sellers) > 3


def test_whole_graph_and_whole_log(spark, duck):
    n = lambda q: duck.sql(q).fetchall()[0][0]
    sold = n("SELECT count(DISTINCT l_partkey) FROM lineitem")
    links = n("SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)") + n("SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey") + n("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey")
    assert catalog.QUERIES["dependencies_all"](spark, SF).count() == links
    assert catalog.QUERIES["upstream_closure_all"](spark, SF).select("root").distinct().count() == sold
    assert catalog.QUERIES["downstream_closure_all"](spark, SF).select("root").distinct().count() == n("SELECT count(DISTINCT s_nationkey) FROM supplier")
    assert catalog.QUERIES["scan_reconcile_all"](spark, SF).count() == n("SELECT count(DISTINCT user_id) FROM events")
