"""Campaign return.

Filters apply to campaigns before any join. Sales during a campaign come from daily totals
of its region, see ``operators.intervals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.exprs import apply_filters, avg, dbl, money, ratio, rnd, rows
from retail_lake.operators.intervals import active_days, daily_totals, interval_sums
from retail_lake.operators.ranking import top_k
from retail_lake.session import freeze


def filtered(
    campaigns: DataFrame,
    campaign_type: str | None = None,
    target_audience: str | None = None,
    region: str | None = None,
) -> DataFrame:
    return apply_filters(
        campaigns,
        {"campaign_type": campaign_type, "target_audience": target_audience, "region": region},
    )


def _conversion(digits: int = 2):
    return rnd(avg("conversion_rate", None) * 100.0, digits)


def kpis(campaigns: DataFrame, **filters) -> DataFrame:
    return filtered(campaigns, **filters).agg(
        F.countDistinct("campaign_id").alias("total_campaigns"),
        money("budget").alias("total_budget"),
        F.sum("reach").alias("total_reach"),
        _conversion().alias("avg_conversion_rate"),
    )


def campaign_sales(daily: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every campaign with its transactions and revenue; revenue is NULL without sales."""
    summed = interval_sums(
        campaigns, daily, "region", "start_date", "end_date",
        {"n": "n", "n_value": "n_value", "total": "total"},
    )
    return summed.withColumn("revenue", F.when(F.col("n_value") > 0, F.col("total")))


def all_campaign_roi(tx: DataFrame, campaigns: DataFrame, **filters) -> DataFrame:
    revenue = F.col("revenue")
    return campaign_sales(freeze(daily_totals(tx)), filtered(campaigns, **filters)).select(
        "campaign_id",
        "campaign_name",
        "campaign_type",
        "region",
        dbl(F.col("budget")).alias("budget"),
        "reach",
        rnd(dbl(F.col("conversion_rate")) * 100.0).alias("conversion_rate_pct"),
        F.col("n").alias("transactions_during_campaign"),
        dbl(revenue).alias("revenue_during_campaign"),
        rnd(ratio(revenue, F.col("budget"))).alias("roi"),
        rnd(ratio(revenue, F.col("reach")), 4).alias("revenue_per_reach"),
    )




def campaign_roi(tx: DataFrame, campaigns: DataFrame, k: int = 20, **filters) -> DataFrame:
    out = all_campaign_roi(tx, campaigns, **filters)
    return top_k(out, [F.col("roi").desc_nulls_last(), F.col("campaign_id")], k)


def top_rows(roi: DataFrame, k: int = 15) -> DataFrame:
    return top_k(roi, [F.col("roi").desc_nulls_last(), F.col("campaign_id")], k)


def low_roi(roi: DataFrame, k: int = 3) -> DataFrame:
    return top_k(roi, [F.col("roi").asc_nulls_last(), F.col("campaign_id")], k)


def by_type(campaigns: DataFrame, **filters) -> DataFrame:
    return (
        filtered(campaigns, **filters)
        .groupBy("campaign_type")
        .agg(
            rows().alias("campaign_count"),
            money("budget").alias("total_budget"),
            _conversion().alias("avg_conversion_rate"),
            avg("reach", 0).alias("avg_reach"),
            avg("budget").alias("avg_budget"),
        )
        .orderBy(F.col("total_budget").desc_nulls_last(), "campaign_type")
    )


def reach_vs_conversion(campaigns: DataFrame, k: int = 50, **filters) -> DataFrame:
    out = filtered(campaigns, **filters).select(
        "campaign_name",
        "campaign_type",
        "reach",
        rnd(dbl(F.col("conversion_rate")) * 100.0).alias("conversion_rate_pct"),
        dbl(F.col("budget")).alias("budget"),
        "region",
        "campaign_id",
    )
    return top_k(out, [F.col("reach").desc_nulls_last(), F.col("campaign_id")], k).drop("campaign_id")


def by_audience(campaigns: DataFrame, **filters) -> DataFrame:
    return (
        filtered(campaigns, **filters)
        .groupBy("target_audience")
        .agg(
            rows().alias("campaign_count"),
            _conversion().alias("avg_conversion_rate"),
            money("budget").alias("total_budget"),
            F.sum("reach").alias("total_reach"),
        )
        .orderBy(F.col("avg_conversion_rate").desc_nulls_last(), "target_audience")
    )


def by_region(tx: DataFrame, campaigns: DataFrame, fanout_safe: bool = False, **filters) -> DataFrame:
    """Campaigns of a region and the sales during them.

    As defined, a campaign's budget, reach and conversion count once per transaction in its
    period. ``fanout_safe`` counts each campaign once.
    """
    campaigns = filtered(campaigns, **filters)
    daily = freeze(daily_totals(tx))
    per_campaign = campaign_sales(daily, campaigns)
    copies = F.lit(1) if fanout_safe else F.greatest(F.col("n"), F.lit(1))
    rate = F.col("conversion_rate")
    sums = per_campaign.groupBy("region").agg(
        F.countDistinct("campaign_id").alias("campaign_count"),
        rnd(F.sum(F.col("budget") * copies)).alias("total_budget"),
        rnd(ratio(F.sum(rate * copies), F.sum(F.when(rate.isNotNull(), copies))) * 100.0).alias(
            "avg_conversion_rate"
        ),
        F.sum(F.col("reach") * copies).alias("total_reach"),
        rnd(F.sum("revenue")).alias("total_revenue"),
    )
    open_days = active_days(campaigns, ("region",)).withColumnsRenamed({"region": "_r", "day": "_d"})
    distinct = (
        daily.join(open_days, (F.col("region") == F.col("_r")) & (F.col("day") == F.col("_d")))
        .groupBy(F.col("region").alias("_region"))
        .agg(F.sum("n").alias("_n"))
    )
    return (
        sums.join(distinct, F.col("region") == F.col("_region"), "left")
        .select(
            "region",
            "campaign_count",
            "total_budget",
            "avg_conversion_rate",
            "total_reach",
            F.coalesce("_n", F.lit(0)).alias("total_transactions"),
            "total_revenue",
            ratio(F.col("total_revenue"), F.col("total_budget")).alias("roi"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "region")
    )


def top_campaigns(tx: DataFrame, campaigns: DataFrame, k: int = 10, **filters) -> DataFrame:
    best = campaign_roi(tx, campaigns, k, **filters)
    return best.select(
        "campaign_name",
        "campaign_type",
        "budget",
        "reach",
        "conversion_rate_pct",
        F.col("transactions_during_campaign").alias("transactions"),
        F.col("revenue_during_campaign").alias("revenue"),
        "roi",
    )


def by_month(campaigns: DataFrame, **filters) -> DataFrame:
    return (
        filtered(campaigns, **filters)
        .groupBy(F.trunc("start_date", "month").alias("month"))
        .agg(
            rows().alias("campaign_count"),
            money("budget").alias("monthly_budget"),
            _conversion().alias("avg_conversion_rate"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def best_conversion(report: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The rows of a per-type or per-audience report that convert best."""
    return top_k(report, [F.col("avg_conversion_rate").desc_nulls_last(), F.col(key)], k)


def acquisition_cost(tx: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Budget per customer whose first purchase anywhere falls in the campaign's period and region.

    A customer has one first day, so first purchases add up over days like sales do. Of several
    regions on that day the first in the alphabet counts, an unknown one only if there is no other.
    """
    known = tx.filter(F.col("entity").isNotNull() & F.col("transaction_date").isNotNull())
    earliest = F.min(F.struct(F.col("transaction_date").alias("day"), F.col("region").isNull().alias("no"), "region"))
    first = known.groupBy("entity").agg(earliest.alias("f")).select("f.day", "f.region")
    daily = freeze(first.groupBy("region", "day").agg(rows().alias("n")))
    out = interval_sums(campaigns, daily, "region", "start_date", "end_date", {"n": "new_customers"})
    return out.select(
        "campaign_id",
        "campaign_name",
        dbl(F.col("budget")).alias("budget"),
        "new_customers",
        rnd(ratio(F.col("budget"), F.col("new_customers"))).alias("acquisition_cost"),
    ).orderBy(F.col("acquisition_cost").asc_nulls_last(), "campaign_id")


def budget_revenue_correlation(tx: DataFrame, campaigns: DataFrame) -> DataFrame:
    roi = all_campaign_roi(tx, campaigns)
    return roi.agg(
        rows().alias("campaign_count"),
        rnd(F.corr("budget", "revenue_during_campaign"), 6).alias("budget_revenue_correlation"),
    )
