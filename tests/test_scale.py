"""Plans under skew: a third of all rows share a customer, a region and a day."""

import pytest
from pyspark.sql import functions as F

from retail_lake.operators.intervals import active_days, daily_totals, interval_join
from retail_lake.operators.ranking import keep_latest
from retail_lake.plans import gold
from retail_lake.plans.reports import logistics, promotions, sales


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which the small test data counts as skewed; no automatic broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_sales(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, 60000, 1, 32).select(
        F.col("id").alias("transaction_id"),
        F.when(hot, F.lit("2000-03-01").cast("date"))
        .otherwise(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 300).cast("int")))
        .alias("transaction_date"),
        (F.col("id") % 1000).cast("decimal(14,2)").alias("amount"),
        F.when(hot, 7).otherwise(F.col("id") % 5000).alias("entity"),
        F.when(hot, "r0").otherwise(F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))).alias("region"),
        F.lit("card").alias("payment_method"),
    )


@pytest.fixture(scope="module")
def periods(spark):
    start = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 7 % 300).cast("int"))
    return spark.range(200).select(
        F.col("id").alias("promotion_id"),
        F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("region"),
        F.lit("A").alias("product_category"),
        F.lit("0.100").cast("decimal(5,3)").alias("discount_percentage"),
        start.alias("start_date"),
        F.date_add(start, (F.col("id") % 9).cast("int")).alias("end_date"),
    )


def test_hot_day_is_split_in_the_row_level_join(hot_sales, periods, small_partitions):
    promos = periods.select("promotion_id", "region", "start_date", "end_date")
    args = (["region"], "transaction_date", "start_date", "end_date", "left", "days")
    # rows wide enough for the hot partition to pass the threshold
    facts = hot_sales.withColumn("payload", F.sha2(F.col("transaction_id").cast("string"), 512))
    joined = interval_join(facts, promos, *args)
    joined.write.format("noop").mode("overwrite").save()
    counted = joined.groupBy().count()
    expected = interval_join(hot_sales, promos, *args[:-1], "range").count()
    assert counted.first()[0] == expected
    salted = interval_join(facts, promos, *args, salts=8, salt_on="transaction_id")
    assert salted.count() == expected
    joined = joined.select("transaction_id", "promotion_id", "payload").orderBy("transaction_id")
    joined.collect()
    assert "skew=true" in plan(joined)


def test_salts_spread_the_hot_day(hot_sales):
    largest = {}
    for salts in (1, 16):
        spread = hot_sales.withColumn("_salt", F.pmod(F.xxhash64("transaction_id"), F.lit(salts)))
        sizes = spread.groupBy("region", "transaction_date", "_salt").count()
        largest[salts] = sizes.agg(F.max("count")).first()[0]
    assert largest[1] >= 20000 and largest[16] < largest[1] / 8


def test_aggregates_meet_the_promotions_as_days(hot_sales, periods):
    """The interval reports shuffle one row per region and day, not one per transaction."""
    report = promotions.vs_no_promotion(hot_sales, periods)
    text = plan(report)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "partial_count" in text
    assert daily_totals(hot_sales).count() <= 5 * 300
    assert active_days(periods).count() <= 5 * 310


def test_no_pairs_where_the_definition_fans_out(hot_sales, periods):
    budgets = periods.select(
        F.col("promotion_id").alias("campaign_id"), "region", F.lit("1.00").cast("decimal(14,2)").alias("budget")
    )
    report = sales.region_marketing(hot_sales, budgets)
    totals = {r["region"]: r["marketing_budget"] for r in report.collect()}
    assert totals["r0"] == 40.0 * (20000 + 8000)
    stock = hot_sales.select(
        F.col("transaction_id").alias("product_id"),
        F.lit("A").alias("product_category"),
        "region",
        F.lit(1).alias("current_stock"),
        F.lit(5).alias("reorder_point"),
    )
    suppliers = hot_sales.select(
        F.col("transaction_id").alias("supplier_id"),
        F.lit("A").alias("product_category"),
        "region",
        F.lit("0.50").cast("decimal(4,2)").alias("reliability_score"),
        F.lit(1).alias("lead_time"),
        F.lit("A").alias("quality_rating"),
    )
    hot = {r["region"]: r for r in logistics.supplier_vs_stockout(suppliers, stock).collect()}["r0"]
    assert hot["high_quality_suppliers"] == hot["products_low_stock"] == 28000 * 28000


def test_scores_with_a_hot_customer(hot_sales, periods):
    scored = gold.rfm(hot_sales, periods, periods, "2001-12-31")
    got = {r["customer_id"]: r for r in scored.collect()}
    plain = {r["entity"]: r["count"] for r in hot_sales.groupBy("entity").count().collect()}
    assert set(got) == set(plain)
    assert got[7]["frequency"] >= plain[7] and got[7]["frequency_score"] == 5


def test_copies_of_a_hot_key_are_reduced_before_the_shuffle(hot_sales):
    kept = keep_latest(hot_sales.drop("payment_method"), ["entity"], "transaction_date")
    assert kept.count() == hot_sales.select("entity").distinct().count()
    assert plan(kept).count("Exchange") == 1


def test_scans_read_only_what_a_report_needs(lake):
    text = plan(sales.by_period(lake.transactions("transaction_date", "amount"), "month"))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    filtered = plan(sales.kpis(lake.transactions("amount", "entity", "region"), "ASIA"))
    assert "EqualTo(r_name,ASIA)" in filtered


def test_wide_rows_take_over_what_is_worked_out_once(hot_sales, periods):
    """The result has a row per sale, promotion and campaign: above the last join there is only copying."""
    people = hot_sales.select(F.col("entity").alias("customer_id")).distinct().selectExpr(
        "customer_id", "'n' as name", "30 as age", "'26-35' as age_group", "'F' as gender", "'Single' as marital_status",
        "cast(1000 as decimal(14,2)) as annual_income", "'k' as country",
    )
    ads = periods.selectExpr(
        "promotion_id as campaign_id", "region", "'c' as campaign_name", "'t' as campaign_type", "'a' as target_audience",
        "cast(5 as decimal(14,2)) as budget", "7L as reach", "cast(0.1 as decimal(6,4)) as conversion_rate", "start_date", "end_date",
    )
    promos = periods.withColumn("promotion_type", F.lit("B"))
    for wide in (gold.sales_enriched(hot_sales, people, promos, ads), gold.enriched_rows(hot_sales, promos, ads)):
        above = wide._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert not [word for word in ("cast(", "round(", "trunc(", "year(", " * ", " / ") if word in above]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_rows_of_the_wide_table_are_dealt_evenly(spark, hot_sales, periods, threshold):
    """A task gets its part of the rows made, not of the sales; a hot day goes to several, and the sales move once."""
    ads = periods.withColumnRenamed("promotion_id", "campaign_id")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, threshold)
    try:
        wide = gold.enriched_rows(hot_sales, periods, ads)
        rows = [r["n"] for r in wide.groupBy(F.spark_partition_id()).agg(F.count("transaction_id").alias("n")).collect()]
        assert plan(wide).count("REPARTITION_BY_NUM") == 1
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sum(rows) == gold.enriched_rows(hot_sales, periods, ads, strategy="range").count()
    assert max(rows) < sum(rows) / 16
