import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retail_lake.operators.intervals import (
    _blocks_of,
    active_days,
    daily_totals,
    distinct_in_intervals,
    interval_join,
    interval_joins,
    interval_sums,
)
from tests.helpers import bag

START = dt.date(2000, 1, 1)


def on(offset):
    return None if offset is None else START + dt.timedelta(days=offset)


@pytest.fixture(scope="module")
def data():
    """Facts with a hot day and gaps; intervals that overlap, reverse, miss and lack bounds."""
    rng = random.Random(11)
    facts = []
    for i in range(600):
        offset = 20 if i % 3 == 0 else rng.choice([None, *range(5, 60), 90])
        region = rng.choice(["n", "s", "e", None])
        facts.append((i, on(offset), region, rng.randint(1, 40), None if i % 17 == 0 else i % 23))
    dims = []
    for j in range(80):
        first = rng.randint(-20, 100)
        last = first + rng.choice([0, 3, 9, 30, -2])
        region = rng.choice(["n", "s", "w", None])
        dims.append(
            (
                j,
                region,
                None if j % 19 == 0 else on(first),
                None if j % 23 == 0 else on(last),
                rng.randint(1, 9),
            )
        )
    return facts, dims


@pytest.fixture(scope="module")
def facts(spark, data):
    return spark.createDataFrame(data[0], "id long, transaction_date date, region string, who int, amount long")


@pytest.fixture(scope="module")
def dims(spark, data):
    return spark.createDataFrame(data[1], "dim long, region string, start_date date, end_date date, w long")


def holds(fact, dim):
    _, d, region, _, _ = fact
    _, other, first, last, _ = dim
    return None not in (d, region, first, last) and region == other and first <= d <= last


def pairs(data, how):
    out = []
    for f in data[0]:
        hits = [d for d in data[1] if holds(f, d)]
        out += [(f[0], d[0]) for d in hits]
        if not hits and how == "left":
            out.append((f[0], None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize(
    "options",
    [
        {"strategy": "range"},
        {"strategy": "blocks"},
        {"strategy": "days"},
        {"strategy": "days", "salts": 5, "salt_on": "id"},
    ],
)
def test_join_equals_brute_force(data, facts, dims, how, options):
    joined = interval_join(facts, dims, ["region"], "transaction_date", "start_date", "end_date", how, **options)
    got = sorted([(r["id"], r["dim"]) for r in joined.select("id", "dim").collect()], key=str)
    assert got == pairs(data, how)
    assert set(joined.columns) == {*facts.columns, *dims.columns}


def test_anti_join(data, facts, dims):
    matched = {f for f, d in pairs(data, "inner")}
    for strategy in ("days", "blocks"):
        got = interval_join(facts, dims, ["region"], "transaction_date", "start_date", "end_date", "left_anti", strategy)
        assert {r["id"] for r in got.collect()} == {f[0] for f in data[0]} - matched
        assert got.columns == facts.columns


def test_blocks_are_a_tiling_of_the_days(spark):
    spans = [(a, a + n) for a in (0, 1, 7, 8, 63, 500) for n in (0, 1, 6, 7, 8, 55, 64, 448, 5_000)]
    df = spark.createDataFrame(spans, "a int, b int").select("a", "b", _blocks_of(F.col("a"), F.col("b")).alias("t"))
    for a, b, tiles in df.collect():
        parts = [divmod(t, 1 << 32) for t in tiles]
        days = sorted(d for level, block in parts for d in range(block << 3 * level, (block + 1) << 3 * level))
        assert days == list(range(a, b + 1))
        assert len(tiles) <= 14 * 5


def test_long_intervals_make_few_rows(spark):
    """4,000 days: one row per day by days, at most 14 a level by blocks, and no pair in the count of distinct buyers."""
    facts = spark.range(4_000).select(
        F.date_add(F.lit(START), F.col("id").cast("int")).alias("transaction_date"), F.lit("n").alias("region"),
        (F.col("id") % 7).alias("who"), "id",
    )
    dims = spark.createDataFrame([(j, "n", on(j), on(3_900 + j)) for j in range(50)], "k int, region string, start_date date, end_date date")
    args = (facts, dims, ["region"], "transaction_date", "start_date", "end_date", "inner")
    assert interval_join(*args, strategy="blocks").count() == interval_join(*args).count() == 50 * 3_901
    blocks = dims.select(F.explode(_blocks_of(F.datediff("start_date", F.lit(START)), F.datediff("end_date", F.lit(START)))))
    assert blocks.count() <= 50 * 14 * 4
    counted = distinct_in_intervals(facts, dims, "region", "transaction_date", "who", "start_date", "end_date", "n")
    assert {r["n"] for r in counted.collect()} == {7}
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1  # only the answers to the intervals


def test_active_days(data, dims):
    got = {
        (r["region"], r["day"]): (r["active"], r["weight"])
        for r in active_days(dims, measures={"weight": F.col("w")}).collect()
    }
    expected = {}
    for _, region, first, last, w in data[1]:
        if None in (region, first, last):
            continue
        for i in range((last - first).days + 1):
            key = (region, first + dt.timedelta(days=i))
            n, total = expected.get(key, (0, 0))
            expected[key] = (n + 1, total + w)
    assert got == expected


def test_interval_sums(data, facts, dims):
    got = {
        r["dim"]: (r["rows"], r["sum"])
        for r in interval_sums(
            dims, daily_totals(facts), "region", "start_date", "end_date", {"n": "rows", "total": "sum"}
        ).collect()
    }
    expected = {}
    for d in data[1]:
        hits = [f for f in data[0] if holds(f, d)]
        expected[d[0]] = (len(hits), sum(f[4] or 0 for f in hits))
    assert got == expected


def test_interval_sums_without_facts(facts, dims):
    none = daily_totals(facts.filter("id < 0"))
    got = interval_sums(dims, none, "region", "start_date", "end_date", {"n": "rows"})
    assert {r["rows"] for r in got.collect()} == {0} and got.count() == dims.count()


def test_distinct_in_intervals(data, facts, dims):
    got = {
        r["dim"]: r["people"]
        for r in distinct_in_intervals(
            facts, dims, "region", "transaction_date", "who", "start_date", "end_date", "people"
        ).collect()
    }
    expected = {d[0]: len({f[3] for f in data[0] if holds(f, d)}) for d in data[1]}
    assert got == expected


def test_daily_totals(data, facts):
    got = {(r["region"], r["day"]): (r["n"], r["n_value"], r["total"]) for r in daily_totals(facts).collect()}
    groups = {}
    for _, d, region, _, amount in data[0]:
        groups.setdefault((region, d), []).append(amount)
    assert got == {
        k: (len(v), len([x for x in v if x is not None]), sum(x for x in v if x is not None) if any(x is not None for x in v) else None)
        for k, v in groups.items()
    }


def test_strategies_give_the_same_multiset_on_the_test_tables(lake):
    tx = lake.transactions("transaction_id", "region", "transaction_date")
    promos = lake.promotions("promotion_id", "region", "start_date", "end_date")
    args = (["region"], "transaction_date", "start_date", "end_date", "left")
    assert bag(interval_join(tx, promos, *args, "range")) == bag(interval_join(tx, promos, *args, "days"))


def test_open_ended_periods_make_no_rows_beyond_the_facts(spark):
    facts = spark.createDataFrame([(1, on(5), "n", 1), (2, on(8), "n", 1)], "id long, transaction_date date, region string, who int")
    dims = spark.createDataFrame(
        [(1, "n", dt.date(1, 1, 1), dt.date(9999, 12, 31)), (2, "n", on(6), dt.date(9999, 12, 31)), (3, "n", on(9), on(20))],
        "k long, region string, start_date date, end_date date",
    )
    out = interval_join(facts, dims, ["region"], "transaction_date", "start_date", "end_date")
    assert bag(out.select("id", "k")) == bag(spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "id long, k long"))
    plan = out.select("id", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "least" in plan
    counted = distinct_in_intervals(facts, dims, "region", "transaction_date", "who", "start_date", "end_date", "n")
    assert {r["k"]: r["n"] for r in counted.collect()} == {1: 1, 2: 1, 3: 0}


def test_joins_with_several_dimensions_match_one_after_the_other(spark):
    """Hot days, days without any, unknown keys, days and ids, repeated sales, empty and open-ended periods."""
    fact = spark.sql(
        "select if(id % 7 = 0, null, id % 400) as transaction_id, if(id % 11 = 0, null, concat('r', id % 3)) as region,"
        " case when id % 13 = 0 then null when id % 3 = 0 then date '2000-02-01' else date_add(date '2000-01-01', cast(id % 90 as int)) end as transaction_date"
        " from range(900)"
    )
    periods = (
        "select id as {0}_id, if(id % 9 = 0, null, concat('r', id % 4)) as region, date_add(date '2000-01-10', cast(id * 7 % 50 as int)) as {0}_from,"
        " case when id % 6 = 0 then null when id % 8 = 0 then date '9999-12-31' else date_add(date '2000-01-09', cast(id * 7 % 50 + id % 5 as int)) end as {0}_to from range({1})"
    )
    dims = [(spark.sql(periods.format(name, n)), f"{name}_from", f"{name}_to") for name, n in (("a", 40), ("b", 25), ("c", 0))]
    expected = fact
    for dim, start, end in dims:
        expected = interval_join(expected, dim, ["region"], "transaction_date", start, end)
    got = interval_joins(fact, dims, ["region"], "transaction_date", "transaction_id")
    assert got.columns == expected.columns
    assert bag(got) == bag(expected)
    assert interval_joins(fact.limit(0), dims, ["region"], "transaction_date", "transaction_id").count() == 0
