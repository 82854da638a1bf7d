"""Every registered query against its own SQL in DuckDB, on the smallest data."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from retail_lake.plans.registry import all_queries
from tests.conftest import SMALL

QUERIES = {name: query for name, query in entry_point.queries().items() if name in all_queries()}
SQL = entry_point.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}
#: Queries of sketches and the table each reads.
SKETCHED = {
    "quartiles_financial_transactions": "financial_transactions",
    "quartiles_product_reviews": "product_reviews",
    "quartiles_inventory": "inventory",
    "quartiles_merged": "financial_transactions",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def test_every_query_has_sql():
    """All but those of sketches, whose error is checked instead."""
    assert set(all_queries()) == set(QUERIES)
    assert set(QUERIES) - set(SQL) == set(SKETCHED)


def test_entry(spark):
    assert {r["promo_status"] for r in entry_point.entry(spark).collect()} == {
        "Avec promotion",
        "Sans promotion",
    }


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SKETCHED])
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]).replace(" ", "") for c in result.description}
    expected = result.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert {c: TYPES.get(t, t.upper()) for c, t in spark_types.items()} == types
    order = [names.index(c) for c in columns]
    got = Counter(tuple(row[c] for c in columns) for row in df.collect())
    assert got == Counter(tuple(row[i] for i in order) for row in expected)


SORTED = [name for name in QUERIES if name not in SKETCHED and re.search(r"order by [^()]*$", SQL[name], re.I)]


@pytest.mark.parametrize("name", SORTED)
def test_same_order(name, spark, duck):
    """Queries whose definition ends with an order give their rows in it."""
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert [tuple(row[c] for c in names) for row in df.collect()] == result.fetchall()


@pytest.mark.parametrize("name", SKETCHED)
def test_sketches_are_near_exact(name, spark, lake):
    table = lake.bronze(SKETCHED[name]).cache()
    n = table.count()
    told = {r["column_name"]: r for r in QUERIES[name](spark, SMALL).collect()}
    assert set(told) == set(table.columns) - ({"transaction_date"} if name == "quartiles_merged" else set())
    for column, r in told.items():
        values = F.unix_date(column) if dict(table.dtypes)[column] == "date" else F.col(column)
        exact = table.agg(F.count_distinct(values).alias("d"), F.count_if(values.isNull()).alias("nulls")).first()
        assert (r["row_count"], r["null_count"]) == (n, exact["nulls"])
        assert abs(r["distinct_count"] - exact["d"]) <= max(1, 0.05 * exact["d"])
        for rank, quartile in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            if r[quartile] is not None:
                below, upto = table.agg(F.count_if(values < r[quartile]), F.count_if(values <= r[quartile])).first()
                assert below / (n - exact["nulls"]) - 0.02 <= rank <= upto / (n - exact["nulls"]) + 0.02
    table.unpersist()
