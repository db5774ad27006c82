import os

import duckdb
import pandas as pd
import pytest

from attestor.plans import catalogue, extraction_queries, run_queries, tree_queries  # noqa: F401  (registers their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: "null" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.SQL:
        assert rows(got.astype(object)) == rows(con.sql(catalogue.SQL[name]).df().astype(object))


def test_problem_fields_on_odd_lines(spark, con, tmp_path):
    lines = [(1, 1, 3 * 10**9, 5, "A"), (1, 2, 7, 5, "N"), (2, None, 1, 1, "R"), (2, 7, 1, 1, "A"), (3, 1, None, 1, "A"), (3, 2, 1, 1, None), (3, 3, 2, 1, "N"), (4, 1, 1, 1, None), (5, 1, 1, 1, "R"), (None, 1, 1, 1, "R"), (6, 2, 1, 9, "R"), (6, None, 1, 2, "R"), (6, 3, 1, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").selectExpr("*", "'O' as l_linestatus", "6.0D as l_quantity").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "1-URGENT", "F") for k in (1, 2, 3, 4, 6, 7)], "o_orderkey long, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["problem_fields"](spark, str(tmp_path)).toPandas()
    want = duckdb.connect().sql(catalogue.SQL["problem_fields"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).df()
    assert rows(got.astype(object)) == rows(want.astype(object))


def test_problem_fields_of_equal_place_come_as_in_the_table(spark, tmp_path):
    lines = [(1, 1, 3, 9, "R"), (1, 1, 3, 5, "A"), (2, 4, 8, 1, "N"), (2, 1, 3, 1, "A"), (2, 1, 3, 2, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["problem_fields"](spark, str(tmp_path)).collect()
    assert {r.run_id: r.fields for r in got} == {1: "R,A", 2: "N,A"}


@pytest.mark.parametrize("name", ("list_extraction", "salvaged_lists"))
def test_lists_are_extracted_once(spark, name):
    assert not any("lineitem" in f for f in catalogue.QUERIES[name](spark, SF).inputFiles())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
