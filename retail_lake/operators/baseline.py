"""Sales of a category with and without its promotions, from daily totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.exprs import mean, ratio, rnd
from retail_lake.operators.intervals import active_days


def promoted_days(promotions: DataFrame) -> DataFrame:
    """Per category, region and day: open promotions, and their discounts."""
    discount = F.col("discount_percentage")
    return active_days(
        promotions,
        groups=("product_category",),
        measures={
            "discounts": F.coalesce(discount, F.lit(0)),
            "discounted": F.when(discount.isNull(), 0).otherwise(1).cast("long"),
        },
    )


def sales_on_promoted_days(daily: DataFrame, promotions: DataFrame) -> DataFrame:
    """Daily totals of a region repeated for each category that has a promotion that day."""
    days = promoted_days(promotions).withColumnsRenamed({"region": "_r", "day": "_d"})
    return daily.join(days, (F.col("region") == F.col("_r")) & (F.col("day") == F.col("_d"))).drop("_r", "_d")


def category_baseline(daily: DataFrame, promotions: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category: transactions and mean value without and with a promotion of it.

    Without are all transactions less those on the promoted days of the category, for the
    listed categories: one number for the whole table and one row per category, instead of
    transactions times stock rows. With follows the pairs (transaction, open promotion).
    A side that has no transactions is NULL.
    """
    n, active = F.col("n"), F.col("active")
    taken = (
        sales_on_promoted_days(daily, promotions)
        .groupBy(F.col("product_category").alias("_c"))
        .agg(
            F.sum("n").alias("_n"),
            F.sum("n_value").alias("_n_value"),
            F.sum("total").alias("_total"),
            mean(F.sum(F.col("total") * active), F.sum(F.col("n_value") * active)).alias("avg_value_with_promo"),
            rnd(ratio(F.sum(n * F.col("discounts")), F.sum(n * F.col("discounted"))) * 100.0).alias(
                "avg_discount"
            ),
        )
    )

    def left_of(name: str):
        everything = daily.agg(F.coalesce(F.sum(name), F.lit(0))).scalar()
        return everything - F.coalesce(f"_{name}", F.lit(0))

    listed = categories.select(F.col("product_category").alias("_listed")).distinct()
    has_base = F.col("_listed").isNotNull() & (F.col("_left") > 0)
    return (
        listed.join(taken, F.col("_listed") == F.col("_c"), "full")
        .withColumn("_left", left_of("n"))
        .select(
            F.coalesce("_listed", "_c").alias("category"),
            F.when(has_base, F.col("_left")).alias("transactions_no_promo"),
            F.when(has_base, mean(left_of("total"), left_of("n_value"))).alias("avg_value_no_promo"),
            F.col("_n").alias("transactions_with_promo"),
            "avg_value_with_promo",
            "avg_discount",
        )
        .filter(F.coalesce("transactions_no_promo", "transactions_with_promo").isNotNull())
    )
