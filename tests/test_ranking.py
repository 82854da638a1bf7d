import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retail_lake.operators.ranking import exact_ntiles, global_row_number, keep_latest, ranks, top_k
from tests.helpers import bag, day, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one measure, some have none."""
    rng = random.Random(7)
    data = []
    for i in range(1003):
        value = 5 if i % 3 == 0 else (None if i % 50 == 1 else rng.randint(0, 40))
        data.append((i, "a" if i % 3 else "b", value))
    rng.shuffle(data)
    return spark.createDataFrame(data, "id long, grp string, v int").repartition(7)


@pytest.mark.parametrize("k", [1, 4, 5, 7])
def test_ntile_equals_the_window_function(skewed, k):
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    expected = skewed.withColumn("b", F.ntile(k).over(Window.orderBy(*order)))
    got = exact_ntiles(skewed, k, "id", {"b": ("v", True)})
    assert bag(got) == bag(expected)
    sizes = [r["count"] for r in got.groupBy("b").count().collect()]
    assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_ntile_with_fewer_rows_than_buckets(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, v int")
    assert {r["id"]: r["b"] for r in exact_ntiles(df, 5, "id", {"b": ("v", False)}).collect()} == {2: 1, 3: 2, 1: 3}


def test_ntile_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v int")
    assert exact_ntiles(df, 5, "id", {"b": ("v", False)}).count() == 0


def test_several_ntiles_of_mixed_types_with_nulls(spark):
    data = [(i if i else None, None if i % 9 == 0 else float(i % 4), day("2000-01-01") if i % 3 else None, f"t{i % 5}") for i in range(503)]
    df = spark.createDataFrame(data, "id long, x double, d date, t string").repartition(5)
    plan = {"a": ("x", False), "b": ("d", True), "c": ("t", True)}
    expected = df
    for name, (measure, descending) in plan.items():
        by = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
        expected = expected.withColumn(name, F.ntile(6).over(Window.orderBy(by, F.col("id").asc_nulls_last())))
    assert bag(exact_ntiles(df, 6, "id", plan)) == bag(expected)


def test_only_narrow_rows_are_sorted(skewed):
    wide = skewed.withColumn("payload", F.repeat(F.lit("x"), 100))
    text = exact_ntiles(wide, 5, "id", {"b": ("v", True)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in text and "Window" not in text.split("scalar-subquery")[0]


def test_row_numbers_are_dense_and_ordered(skewed):
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    got = global_row_number(skewed, order, "pos", "n").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1003))
    assert {r["n"] for r in got} == {1003}
    keys = [(r["v"] is None, r["v"] or 0, r["id"]) for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_equal_the_window_functions(skewed, descending):
    by_value = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    w = Window.partitionBy("grp").orderBy(by_value)
    expected = skewed.select(
        "*",
        F.row_number().over(w.orderBy(by_value, "id")).cast("long").alias("row_number"),
        F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense_rank"),
        F.percent_rank().over(w).alias("percent_rank"),
    )
    assert bag(ranks(skewed, "grp", "v", "id", descending)) == bag(expected)


def test_ranks_over_many_tasks_with_a_run_across_them(spark):
    """Half of all rows tie, so a run and its group pass through whole tasks; nulls and NaN tie as well."""
    data = [(i, ["a", "a", "a", None][i % 4], [5.0, 5.0, None, float("nan"), float(i % 11)][i % 5]) for i in range(900)]
    df = spark.createDataFrame(data, "id long, grp string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    w = Window.partitionBy("grp").orderBy(F.col("v").desc_nulls_last())
    expected = df.select(
        "*",
        F.row_number().over(w.orderBy(F.col("v").desc_nulls_last(), "id")).cast("long").alias("row_number"),
        F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense_rank"),
        F.percent_rank().over(w).alias("percent_rank"),
    )
    got = ranks(df, "grp", "v", "id")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_ranks_of_nothing(spark):
    assert ranks(spark.createDataFrame([], "id long, g string, v int"), "g", "v", "id").collect() == []


def test_ranks_do_not_join_on_the_measure(skewed):
    text = ranks(skewed, "grp", "v", "id", percent=False)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1 and "strategy=broadcast" in text


def test_keep_latest(spark):
    df = spark.createDataFrame(
        [
            (1, day("2000-01-01"), "old"),
            (1, day("2000-02-01"), "new"),
            (2, None, "undated"),
            (2, day("1999-01-01"), "dated"),
            (3, day("2000-01-01"), "a"),
            (3, day("2000-01-01"), "b"),
            (None, day("2000-01-01"), "x"),
            (None, day("2001-01-01"), "y"),
            (4, None, None),
        ],
        "id long, d date, t string",
    )
    got = {(r["id"], r["t"]) for r in keep_latest(df, ["id"], "d").collect()}
    assert got == {(1, "new"), (2, "dated"), (3, "b"), (None, "y"), (4, None)}
    assert keep_latest(df, ["id"], "d").columns == df.columns


def test_keep_latest_with_named_ties(spark):
    df = spark.createDataFrame(
        [(1, day("2000-01-01"), 1, "z"), (1, day("2000-01-01"), 2, "a")], "id long, d date, seq int, t string"
    )
    assert rows(keep_latest(df, ["id"], "d", ["seq"]))[0]["t"] == "a"


def test_keep_latest_reduces_before_the_shuffle(spark, skewed):
    plan = keep_latest(skewed, ["grp"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_top_k_is_one_pass(skewed):
    df = top_k(skewed, [F.col("v").desc_nulls_last(), F.col("id")], 3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
    assert len(df.collect()) == 3
