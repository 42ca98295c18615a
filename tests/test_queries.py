"""Every registered query with SQL gives that SQL's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tarn import queries as library


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = library.queries()[name](spark, sf_dir)
    expected = duck.execute(library.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["key", "node_type", "depth"]


def test_approximate_search_recall(spark, sf_dir):
    from tarn.operators import vectors as V
    from tarn.sources import domain as D

    every = D.vectors(spark, sf_dir)
    asked = every.where("node_id % 50 = 0").selectExpr("node_id query", "vec")
    exact = {(r["query"], r["node_id"]) for r in V.nearest_many(every, asked, 10).collect()}
    many = {(r["query"], r["node_id"]) for r in library.queries()["vector_search_approximate"](spark, sf_dir).collect()}
    print(len(exact), len(many & exact))
    assert len(many & exact) / len(exact) >= 0.9
    index = V.approximate_index(every, 64)
    first = asked.orderBy("query").first()
    one = {(first["query"], r["node_id"]) for r in V.approximate_nearest(index, list(first["vec"]), 10).collect()}
    assert len(one & exact) >= 9
