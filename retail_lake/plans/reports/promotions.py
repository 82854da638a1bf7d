"""Effect of promotions on sales.

A transaction belongs to one region and one day, so everything a promotion period says
about transactions can be said about daily totals. The fact table is read once and reduced
to (region, day) before it meets the promotions. Counts of distinct transactions rely on
transaction_id being unique, which cleaning ensures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import (
    apply_filters,
    avg,
    days_between,
    dbl,
    mean,
    pct,
    ratio,
    rnd,
    rows,
)
from retail_lake.operators.baseline import category_baseline, sales_on_promoted_days
from retail_lake.operators.intervals import active_days, daily_totals, interval_sums
from retail_lake.operators.ranking import top_k
from retail_lake.session import freeze


def kpis(promotions: DataFrame, category: str | None = None, region: str | None = None) -> DataFrame:
    promotions = apply_filters(promotions, {"product_category": category, "region": region})
    return promotions.agg(
        F.countDistinct("promotion_id").alias("total_promos"),
        _percent("discount_percentage", 1).alias("avg_discount"),
        F.countDistinct("product_category").alias("categories_with_promos"),
        F.countDistinct("region").alias("regions_with_promos"),
    )


def _percent(fraction: str, digits: int = 2):
    return rnd(avg(fraction, None) * 100.0, digits)


def vs_no_promotion(tx: DataFrame, promotions: DataFrame, category: str | None = None) -> DataFrame:
    """Sales with and without a promotion in the region at the time.

    A transaction counts once per open promotion. With a category, it counts only for
    promotions of that category or of none; one that only other categories cover is in
    neither group.
    """
    return _vs_no_promotion(daily_totals(tx), promotions, category)


def _vs_no_promotion(daily: DataFrame, promotions: DataFrame, category: str | None = None) -> DataFrame:
    kept = F.lit(1)
    if category is not None:
        of_interest = (F.col("product_category") == category) | F.col("product_category").isNull()
        kept = F.when(of_interest, 1).otherwise(0)
    days = active_days(promotions, ("region",), measures={"kept": kept.cast("long")})
    days = days.withColumnsRenamed({"region": "_r", "day": "_d"})
    weight = F.coalesce("kept", F.lit(1))
    status = F.when(F.col("_r").isNotNull(), labels.WITH_PROMO).otherwise(labels.WITHOUT_PROMO)
    grouped = (
        daily.join(days, (F.col("region") == F.col("_r")) & (F.col("day") == F.col("_d")), "left")
        .withColumn("weight", weight)
        .filter(F.col("weight") > 0)
        .groupBy(status.alias("promo_status"))
        .agg(
            F.sum(F.col("n") * F.col("weight")).alias("nb_transactions"),
            F.sum(F.col("n_value") * F.col("weight")).alias("valued"),
            F.sum(F.col("total") * F.col("weight")).alias("revenue"),
        )
    )
    everything = Window.partitionBy()  # two rows
    return grouped.select(
        "promo_status",
        "nb_transactions",
        rnd(F.col("revenue")).alias("total_revenue"),
        mean(F.col("revenue"), F.col("valued")).alias("avg_transaction_value"),
        pct(F.col("nb_transactions"), F.sum("nb_transactions").over(everything)).alias(
            "percentage_of_transactions"
        ),
        pct(F.col("revenue"), F.sum("revenue").over(everything)).alias("percentage_of_revenue"),
    ).orderBy(F.col("total_revenue").desc_nulls_last(), "promo_status")


def by_discount(tx: DataFrame, promotions: DataFrame, category: str | None = None) -> DataFrame:
    """Sales under promotion by size of the discount."""
    return _by_discount(daily_totals(tx), promotions, category)


def _by_discount(daily: DataFrame, promotions: DataFrame, category: str | None = None) -> DataFrame:
    promotions = apply_filters(promotions, {"product_category": category})
    percent = F.col("discount_percentage") * 100
    ranged = promotions.withColumn("discount_range", labels.DISCOUNT_RANGE.of(percent))
    days = active_days(
        ranged,
        groups=("discount_range",),
        measures={
            "discounts": F.coalesce(percent, F.lit(0)),
            "discounted": F.when(percent.isNull(), 0).otherwise(1).cast("long"),
        },
    ).withColumnsRenamed({"region": "_r", "day": "_d"})
    n, active = F.col("n"), F.col("active")
    return (
        daily.join(days, (F.col("region") == F.col("_r")) & (F.col("day") == F.col("_d")))
        .groupBy("discount_range")
        .agg(
            F.sum(n * active).alias("nb_transactions"),
            rnd(F.sum(F.col("total") * active)).alias("total_revenue"),
            mean(F.sum(F.col("total") * active), F.sum(F.col("n_value") * active)).alias(
                "avg_transaction_value"
            ),
            mean(F.sum(n * F.col("discounts")), F.sum(n * F.col("discounted"))).alias("avg_discount_pct"),
        )
        .orderBy(labels.DISCOUNT_RANGE.order("discount_range"))
    )


def sensitivity(tx: DataFrame, promotions: DataFrame, inventory: DataFrame, k: int = 15) -> DataFrame:
    """Mean basket with a promotion of the category against the mean without, in percent."""
    sides = category_baseline(freeze(daily_totals(tx)), promotions, inventory)

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0.0))

    lift = (
        ratio(zero("avg_value_with_promo") - zero("avg_value_no_promo"), F.col("avg_value_no_promo")) * 100.0
    )
    level = (
        F.when(F.col("lift") > 20, labels.SENSITIVITY[0])
        .when(F.col("lift").between(5, 20), labels.SENSITIVITY[1])
        .when(F.col("lift").between(-5, 5), labels.SENSITIVITY[2])
        .otherwise(labels.SENSITIVITY[3])
    )
    out = (
        sides.filter(F.col("category").isNotNull())
        .withColumn("lift", lift)
        .select(
            "category",
            F.coalesce("transactions_no_promo", F.lit(0)).alias("transactions_no_promo"),
            zero("avg_value_no_promo").alias("avg_value_no_promo"),
            F.coalesce("transactions_with_promo", F.lit(0)).alias("transactions_with_promo"),
            zero("avg_value_with_promo").alias("avg_value_with_promo"),
            zero("avg_discount").alias("avg_discount"),
            rnd(F.col("lift")).alias("lift_percentage"),
            level.alias("sensitivity_level"),
        )
    )
    return top_k(out, [F.col("lift_percentage").desc_nulls_last(), F.col("category")], k)


def roi_by_category(
    tx: DataFrame, promotions: DataFrame, region: str | None = None, k: int = 10
) -> DataFrame:
    """Promotions of a category and the sales during them.

    Sums follow the pairs (promotion, transaction): a promotion without sales still
    contributes its discount once.
    """
    promotions = apply_filters(promotions, {"region": region})
    daily = freeze(daily_totals(tx))
    per_promo = interval_sums(
        promotions, daily, "region", "start_date", "end_date",
        {"n": "n", "n_value": "n_value", "total": "total"},
    )
    copies = F.greatest(F.col("n"), F.lit(1))
    discount = F.col("discount_percentage")
    sold = per_promo.groupBy("product_category").agg(
        F.countDistinct("promotion_id").alias("promo_count"),
        rnd(
            ratio(F.sum(discount * copies), F.sum(F.when(discount.isNotNull(), copies))) * 100.0
        ).alias("avg_discount"),
        rnd(F.sum(F.when(F.col("n_value") > 0, F.col("total")))).alias("revenue_during_promo"),
        mean(F.sum("total"), F.sum("n_value")).alias("avg_transaction_value"),
    )
    distinct = (
        sales_on_promoted_days(daily, promotions)
        .groupBy(F.col("product_category").alias("_c"))
        .agg(F.sum("n").alias("_n"))
    )
    out = sold.join(distinct, F.col("product_category").eqNullSafe(F.col("_c")), "left").select(
        "product_category",
        "promo_count",
        "avg_discount",
        F.coalesce("_n", F.lit(0)).alias("transactions_during_promo"),
        "revenue_during_promo",
        "avg_transaction_value",
    )
    order = [F.col("revenue_during_promo").desc_nulls_last(), F.col("product_category").asc_nulls_last()]
    return top_k(out, order, k)


def durations(promotions: DataFrame, min_promos: int = 5) -> DataFrame:
    return (
        promotions.groupBy(days_between("start_date", "end_date").alias("promo_duration_days"))
        .agg(
            rows().alias("promo_count"),
            _percent("discount_percentage").alias("avg_discount"),
            F.countDistinct("product_category").alias("categories_count"),
        )
        .filter(F.col("promo_count") >= min_promos)
        .orderBy(F.col("promo_duration_days").asc_nulls_last())
    )


def top_lift(lifts: DataFrame, k: int = 3) -> DataFrame:
    return top_k(lifts, [F.col("lift_percentage").desc_nulls_last(), F.col("category")], k)


def low_lift(lifts: DataFrame, k: int = 3) -> DataFrame:
    return top_k(lifts, [F.col("lift_percentage").asc_nulls_last(), F.col("category")], k)


def best_discount(tx: DataFrame, promotions: DataFrame) -> DataFrame:
    """The discount range whose mean basket rises most above the basket without promotion."""
    daily = freeze(daily_totals(tx))
    ranges = _by_discount(daily, promotions)
    plain = (
        _vs_no_promotion(daily, promotions)
        .filter(F.col("promo_status") == labels.WITHOUT_PROMO)
        .agg(F.max("avg_transaction_value"))
        .scalar()
    )
    uplift = rnd(ratio(F.col("avg_transaction_value") - plain, plain) * 100.0)
    out = ranges.select(
        "discount_range",
        "nb_transactions",
        "avg_transaction_value",
        dbl(plain).alias("avg_value_no_promo"),
        uplift.alias("uplift_percentage"),
    )
    return top_k(out, [F.col("uplift_percentage").desc_nulls_last(), F.col("discount_range")], 1)
