import pytest
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import iso_weekday, lookup, mean, pct, ratio, rnd, season
from retail_lake.plans import profiling, silver
from retail_lake.plans.registry import all_queries
from tests.helpers import day, dec, rows

AS_OF = "2001-12-31"


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("age", "group", "band"),
    [
        (None, "65+", "65+"),
        (17, "Minor", "18-25"),
        (18, "18-25", "18-25"),
        (24, "18-25", "18-25"),
        (25, "18-25", "25-35"),
        (35, "26-35", "25-35"),
        (36, "36-50", "36-50"),
        (51, "51-65", "51-65"),
        (66, "65+", "65+"),
    ],
)
def test_age_bands(spark, age, group, band):
    assert one(spark, age, "int", labels.AGE_GROUP.of) == group
    assert one(spark, age, "int", labels.AGE_BAND.of) == band


@pytest.mark.parametrize(
    ("discount", "label"),
    [("9.9", "< 10%"), ("10", "10-20%"), ("20.5", "> 50%"), ("21", "21-30%"), ("31", "31-50%"), (None, "> 50%")],
)
def test_gaps_between_bands_fall_to_the_last_label(spark, discount, label):
    value = dec(discount)
    assert one(spark, value, "decimal(5,2)", labels.DISCOUNT_RANGE.of) == label


def test_income_gap_and_null(spark):
    assert one(spark, dec("40000.50"), "decimal(14,2)", labels.INCOME_BRACKET.of) == "> 100K"
    assert one(spark, None, "decimal(14,2)", labels.INCOME_BAND.of) == "Élevé"


def test_label_codes(spark):
    assert one(spark, "VIP", "string", lambda c: lookup(c, labels.VALUE_SEGMENT_CODE)) == 4
    assert one(spark, "autre", "string", lambda c: lookup(c, labels.VALUE_SEGMENT_CODE)) is None
    assert one(spark, None, "string", lambda c: lookup(c, labels.QUALITY_CODE, 2)) == 2


@pytest.mark.parametrize(
    ("text", "weekday", "name"),
    [("2000-01-01", 6, "Hiver"), ("2000-01-02", 7, "Hiver"), ("2000-03-06", 1, "Printemps"),
     ("2000-08-31", 4, "Été"), ("2000-11-30", 4, "Automne"), ("2000-12-01", 5, "Hiver")],
)
def test_calendar(spark, text, weekday, name):
    assert one(spark, day(text), "date", iso_weekday) == weekday
    assert one(spark, day(text), "date", season) == name


def test_division_never_fails(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (1.0, None), (1.0, 8.0)], "a double, b double")
    got = df.select(ratio(F.col("a"), F.col("b")).alias("r"), pct(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["r"] for r in got] == [None, None, None, 0.125]
    assert [r["p"] for r in got] == [None, None, None, 12.5]


@pytest.mark.parametrize(("value", "expected"), [(2.005, 2.01), (-2.005, -2.01), (1.005, 1.01), (2.675, 2.68)])
def test_rounding_is_half_up(spark, value, expected):
    assert one(spark, value, "double", rnd) == expected


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-5,), (0,), (100,), (130,), (None,)], "p int")
    assert [r[0] for r in df.select(silver.clamp("p", 0, 100)).collect()] == [0, 0, 100, 100, None]


def test_clean_transactions(spark):
    df = spark.createDataFrame(
        [
            (1, day("2000-01-01"), dec("-7.00"), 1, " x ", " n "),
            (1, day("1999-01-01"), dec("8.00"), 1, "old", "n"),
            (2, None, None, 2, None, None),
        ],
        "transaction_id long, transaction_date date, amount decimal(14,2), entity long, payment_method string, "
        "region string",
    )
    got = {r["transaction_id"]: r for r in rows(silver.clean_transactions(df, AS_OF))}
    assert got[1]["amount"] == dec("7.00") and got[1]["payment_method"] == "x" and got[1]["region"] == "n"
    assert got[2]["amount"] is None and len(got) == 2


def test_clean_promotions_drops_reversed_and_open_periods(spark):
    df = spark.createDataFrame(
        [
            (1, "a", "t", dec("-5"), day("2000-01-01"), day("2000-01-01"), "n"),
            (2, "a", "t", dec("130"), day("2000-01-01"), day("2000-01-31"), "n"),
            (3, "a", "t", None, day("2000-01-02"), day("2000-01-01"), "n"),
            (4, "a", "t", dec("5"), day("2000-01-02"), None, "n"),
        ],
        "promotion_id long, product_category string, promotion_type string, discount_percentage decimal(8,3), "
        "start_date date, end_date date, region string",
    )
    got = {r["promotion_id"]: (r["discount_percentage"], r["duration_days"]) for r in rows(silver.clean_promotions(df, AS_OF))}
    assert got == {1: (0, 0), 2: (1, 30)}
    got = {r["promotion_id"]: float(r["discount_percentage"]) for r in rows(silver.clean_promotions(df.withColumn("end_date", df.start_date), AS_OF, unit="percent")) if r["discount_percentage"] is not None}
    assert got == {1: 0.0, 2: 1.0, 4: 0.05}


def test_clean_employees(spark):
    base = (" Ann ", " A@B.C ", "d", " active ", dec("1"), "c", "r")
    data = [
        (1, day("1980-12-31"), day("2000-01-01")),
        (2, day("1980-01-01"), day("1980-01-01")),
        (3, day("1980-01-01"), day("2002-01-01")),
        (4, None, day("2000-01-01")),
        (5, day("1980-01-01"), None),
        (6, day("1980-01-01"), day(AS_OF)),
    ]
    df = spark.createDataFrame(
        [(i, base[0], base[1], b, h, *base[2:]) for i, b, h in data],
        "employee_id long, name string, email string, date_of_birth date, hire_date date, department string, "
        "status string, salary decimal(14,2), country string, region string",
    )
    got = {r["employee_id"]: r for r in rows(silver.clean_employees(df, AS_OF))}
    assert set(got) == {1, 6}
    assert (got[1]["name"], got[1]["email"], got[1]["status"], got[1]["age"]) == ("Ann", "a@b.c", "ACTIVE", 21)


def test_age_counts_year_boundaries(spark):
    df = spark.createDataFrame([(day("2000-12-31"),)], "date_of_birth date")
    assert silver.with_age(df, "2001-01-01").first()["age"] == 1


def test_clean_inventory(spark):
    schema = (
        "product_id long, product_category string, region string, country string, warehouse string, "
        "current_stock long, reorder_point int, lead_time long, last_restock_date date"
    )
    data = [(1, 5, 5), (2, 6, 5), (3, -1, 5), (4, None, 5), (5, 5, None)]
    df = spark.createDataFrame(
        [(i, "c", "r", "k", " w", s, p, 1, day("2000-01-01")) for i, s, p in data], schema
    )
    got = {r["product_id"]: r["needs_reorder"] for r in rows(silver.clean_inventory(df, AS_OF))}
    assert got == {1: True, 2: False, 4: False, 5: False}
    padded = spark.createDataFrame([(1, "c", "r", "k", w, 5, 5, 1, day(d)) for w, d in ((" W", "2000-01-01"), ("W", "2000-01-02"))], schema)
    assert [r["last_restock_date"] for r in silver.clean_inventory(padded, AS_OF).collect()] == [day("2000-01-02")]


def test_clean_interactions_bounds_satisfaction(spark):
    schema = (
        "interaction_id long, interaction_date date, interaction_type string, issue_category string, "
        "duration_minutes int, customer_satisfaction long, resolution_status string, follow_up_required string"
    )
    df = spark.createDataFrame(
        [(i, day("2000-01-01"), "t", "i", 1, s, " Resolved ", "Yes") for i, s in enumerate([-1, 0, 5, 9, None])], schema
    )
    got = [r["customer_satisfaction"] for r in silver.clean_interactions(df, AS_OF).orderBy("interaction_id").collect()]
    assert got == [0, 0, 5, 5, None]


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", day("2000-01-01")), (3, None, None), (None, "a", day("1999-01-01"))], "n int, t string, d date"
    )
    got = {r["column_name"]: r for r in rows(profiling.profile(df))}
    assert (got["n"]["null_count"], got["n"]["mean_value"], got["n"]["max_value"]) == (1, 2.0, "3")
    assert (got["t"]["min_value"], got["t"]["mean_value"]) == ("a", None)
    assert (got["d"]["min_value"], got["d"]["row_count"]) == ("1999-01-01", 3)


def test_distribution_violations_duplicates_percentiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    assert [(r["value"], r["percentage"]) for r in profiling.distribution(df, "k").collect()] == [
        ("a", 50.0), ("b", 25.0), (None, 25.0)
    ]
    bad = {r["rule"]: r["row_count"] for r in profiling.violations(df, {"big": F.col("v") > 2}).collect()}
    assert bad == {"big": 2}
    assert {r["copies"]: r["key_count"] for r in profiling.duplicates(df, ["k"]).collect()} == {1: 2, 2: 1}
    assert profiling.percentiles(df, "v", (0.5,)).first()["percentiles"] == [2]


@pytest.mark.parametrize(
    ("total", "n", "expected"),
    [("2791720861.35", 6, 465286810.23), ("-0.05", 10, -0.01), ("0.01", 3, 0.0), ("5", 0, None), (None, 2, None)],
)
def test_means_round_exactly(spark, total, n, expected):
    df = spark.createDataFrame([(dec(total), n)], "t decimal(24,2), n long")
    assert df.select(mean(F.col("t"), F.col("n"))).first()[0] == expected


def test_sketches_are_within_their_error_also_when_merged(spark, lake):
    from retail_lake.plans import profiling

    wide = spark.range(40_000).select(
        (F.col("id") * 7_919 % 40_000).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1_000).alias("k"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 9_000)).alias("name"),
        F.lit(None).cast("int").alias("nothing"),
    )
    whole = {r.column_name: r for r in profiling.quartiles(profiling.sketches(wide)).collect()}
    parts = {r.column_name: r for r in profiling.quartiles(profiling.merged(profiling.sketches(wide, "day"))).collect()}
    assert set(whole) == set(wide.columns) and set(parts) == set(wide.columns) - {"day"}
    exact = wide.agg(*[F.count_distinct(c).alias(c) for c in wide.columns]).first()
    for told in (whole, parts):
        for name, r in told.items():
            assert r.row_count == 40_000
            assert r.null_count == wide.filter(F.col(name).isNull()).count()
            assert abs(r.distinct_count - exact[name]) <= 0.05 * exact[name]
        for rank, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert abs(told["amount"][name] / 40_000 - rank) <= 0.02
            below = wide.filter(F.col("k") < told["k"][name]).count() / 40_000
            upto = wide.filter(F.col("k") <= told["k"][name]).count() / 40_000
            assert below - 0.02 <= rank <= upto + 0.02
        assert told["name"].q50 is None and told["nothing"].q50 is None
    assert profiling.quartiles(profiling.sketches(wide.limit(0))).count() == len(wide.columns)


def test_rows_are_dealt_before_they_are_sorted_for_the_latest(lake):
    """One file is one task; its rows must not all be sorted there."""
    for name in ("clean_inventory", "quarantine_inventory"):
        text = all_queries()[name](lake)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
        assert text.index("partial_max") < text.index("Exchange hashpartitioning")
