"""Sales over time, by season and by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.bands import position
from retail_lake.functions.exprs import (
    apply_filters,
    avg,
    day_name,
    money,
    month_name,
    ratio,
    rnd,
    rows,
)
from retail_lake.operators.ranking import top_k
from retail_lake.operators.timeseries import period_growth, rolling, rolling_mean, truncated


def kpis(tx: DataFrame, region: str | None = None) -> DataFrame:
    return apply_filters(tx, {"region": region}).agg(
        rows().alias("total_transactions"),
        money("amount").alias("total_revenue"),
        avg("amount").alias("avg_transaction_value"),
        F.countDistinct("entity").alias("unique_customers"),
    )


def by_period(
    tx: DataFrame,
    period: str,
    name: str = "period",
    region: str | None = None,
    average: str | None = "avg_transaction_value",
    customers: bool = False,
) -> DataFrame:
    """Count, revenue and optionally mean and distinct customers per month, quarter or year."""
    aggregates = [rows().alias("nb_transactions"), money("amount").alias("total_revenue")]
    if average:
        aggregates.append(avg("amount").alias(average))
    if customers:
        aggregates.append(F.countDistinct("entity").alias("unique_customers"))
    tx = apply_filters(tx, {"region": region})
    return (
        tx.groupBy(truncated("transaction_date", period).alias(name))
        .agg(*aggregates)
        .orderBy(F.col(name).asc_nulls_last())
    )


def _revenue(tx: DataFrame, period: str, region: str | None) -> DataFrame:
    tx = apply_filters(tx, {"region": region})
    return tx.groupBy(truncated("transaction_date", period).alias(period)).agg(
        money("amount").alias("revenue")
    )


def growth(
    tx: DataFrame,
    period: str,
    region: str | None = None,
    change: bool = False,
    lag: int = 1,
    previous: str | None = None,
) -> DataFrame:
    """Revenue per period against the period ``lag`` before."""
    out = period_growth(
        _revenue(tx, period, region),
        period,
        "revenue",
        previous or f"previous_{period}_revenue",
        "growth_percentage",
        "revenue_change" if change else None,
        lag,
    )
    return out.orderBy(F.col(period).asc_nulls_last())


def next_month(tx: DataFrame) -> DataFrame:
    """Monthly revenue with the month that follows."""
    series = _revenue(tx, "month", None)
    after = F.lead("revenue").over(Window.orderBy(F.col("month").asc_nulls_last()))
    return series.withColumn("next_month_revenue", after).orderBy("month")


def moving_average(tx: DataFrame, months: int = 3) -> DataFrame:
    series = tx.groupBy(F.trunc("transaction_date", "month").alias("month")).agg(
        F.sum("amount").alias("revenue")
    )
    mean_col = rolling_mean("revenue", rolling("month", months))
    return series.select(
        "month",
        rnd(F.col("revenue")).alias("revenue"),
        mean_col.alias(f"moving_avg_{months}months"),
    ).orderBy(F.col("month").asc_nulls_last())


def by_weekday(tx: DataFrame, region: str | None = None, average: bool = False) -> DataFrame:
    tx = apply_filters(tx, {"region": region})
    aggregates = [rows().alias("nb_transactions"), money("amount").alias("total_revenue")]
    if average:
        aggregates.append(avg("amount").alias("avg_transaction_value"))
    return (
        tx.groupBy(day_name("transaction_date").alias("day_of_week"))
        .agg(*aggregates)
        .orderBy(position("day_of_week", labels.WEEKDAYS))
    )


def by_month_name(tx: DataFrame, region: str | None = None) -> DataFrame:
    tx = apply_filters(tx, {"region": region})
    return (
        tx.groupBy(
            month_name("transaction_date").alias("month_name"),
            F.month("transaction_date").alias("month_num"),
        )
        .agg(money("amount").alias("total_revenue"))
        .orderBy("month_num")
    )


def month_name_average(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy(
            month_name("transaction_date").alias("month_name"),
            F.month("transaction_date").alias("month_num"),
        )
        .agg(
            rows().alias("nb_transactions"),
            avg("amount").alias("avg_transaction_value"),
            money("amount").alias("total_revenue"),
        )
        .orderBy("month_num")
        .drop("month_num")
    )


def peak_days(tx: DataFrame, k: int = 20) -> DataFrame:
    days = tx.groupBy("transaction_date").agg(
        rows().alias("nb_transactions"), money("amount").alias("daily_revenue")
    )
    return top_k(days, [F.col("daily_revenue").desc_nulls_last(), F.col("transaction_date")], k)


def by_region(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("region")
        .agg(
            rows().alias("transaction_count"),
            money("amount").alias("total_amount"),
            avg("amount").alias("avg_amount"),
        )
        .orderBy(F.col("total_amount").desc_nulls_last(), "region")
    )


def region_customers(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("region")
        .agg(
            rows().alias("nb_transactions"),
            money("amount").alias("total_revenue"),
            avg("amount").alias("avg_transaction_value"),
            F.countDistinct("entity").alias("unique_customers"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "region")
    )


def region_marketing(tx: DataFrame, campaigns: DataFrame, fanout_safe: bool = False) -> DataFrame:
    """Revenue of a region against its campaign budget.

    As defined, every transaction meets every campaign of its region, so revenue counts once
    per campaign and budget once per transaction. Both factors are applied to regional totals;
    the pairs are never built. ``fanout_safe`` counts each amount and budget once.
    """
    sold = tx.groupBy("region").agg(rows().alias("n"), F.sum("amount").alias("amount"))
    ran = campaigns.groupBy(F.col("region").alias("_r")).agg(
        rows().alias("campaigns"),
        F.countDistinct("campaign_id").alias("campaign_count"),
        F.sum("budget").alias("budget"),
    )
    both = sold.join(ran, F.col("region") == F.col("_r"), "left")
    if fanout_safe:
        revenue, budget = F.col("amount"), F.col("budget")
    else:
        revenue = F.col("amount") * F.coalesce("campaigns", F.lit(1))
        budget = F.col("budget") * F.col("n")
    return both.select(
        "region",
        rnd(revenue).alias("total_revenue"),
        F.coalesce("campaign_count", F.lit(0)).alias("campaign_count"),
        rnd(budget).alias("marketing_budget"),
        rnd(ratio(revenue, budget)).alias("revenue_per_marketing_euro"),
    ).orderBy(F.col("total_revenue").desc_nulls_last(), "region")


def cohorts(tx: DataFrame) -> DataFrame:
    """Customers by month of first purchase who buy again n months later.

    Sales shrink to one row per customer and month before they are shuffled by customer.
    """
    months = tx.select("entity", F.trunc("transaction_date", "month").alias("_m")).distinct()
    own = Window.partitionBy("entity")
    return (
        months.filter(F.col("_m").isNotNull())
        .select(F.min("_m").over(own).alias("cohort_month"), "_m")
        .withColumn(
            "months_since",
            (F.year("_m") - F.year("cohort_month")) * 12 + F.month("_m") - F.month("cohort_month"),
        )
        .groupBy("cohort_month", "months_since")
        .agg(rows().alias("customers"))
        .orderBy("cohort_month", "months_since")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted list of the values of a column, for a filter."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())
