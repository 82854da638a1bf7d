"""Stock, warehouses, suppliers and shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import avg, days_between, dbl, mean, pct, rate, rows
from retail_lake.operators.ranking import top_k
from retail_lake.plans.silver import Day, day


def _desc(name: str):
    return F.col(name).desc_nulls_last()


def _below_reorder():
    return F.col("current_stock") < F.col("reorder_point")


def stockouts(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy("product_category", "region")
        .agg(
            rows().alias("total_products"),
            F.count_if(_below_reorder()).alias("products_below_reorder"),
            F.count_if(F.col("current_stock") == 0).alias("products_out_of_stock"),
            rate(_below_reorder()).alias("stockout_rate"),
            avg("current_stock", 0).alias("avg_stock_level"),
            avg("reorder_point", 0).alias("avg_reorder_point"),
        )
        .orderBy(_desc("stockout_rate"), "product_category", "region")
    )


def critical_products(
    inventory: DataFrame, reviews: DataFrame, as_of: Day, k: int = 30, min_reviews: int = 5
) -> DataFrame:
    """Popular products below their reorder point, one row per stock row."""
    keys = [
        "product_id",
        "product_category",
        "region",
        "warehouse",
        "current_stock",
        "reorder_point",
        "lead_time",
        "last_restock_date",
    ]
    low = inventory.filter(_below_reorder()).groupBy(*keys).agg(rows().alias("copies"))
    per_product = reviews.groupBy(F.col("product_id").alias("_p")).agg(
        F.count("review_id").alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated")
    )
    out = (
        low.join(per_product, F.col("product_id") == F.col("_p"), "left")
        .withColumn("review_count", F.coalesce(F.col("n") * F.col("copies"), F.lit(0)))
        .filter(F.col("review_count") >= min_reviews)
        .select(
            *keys,
            "review_count",
            mean(F.col("stars"), F.col("rated")).alias("avg_rating"),
            days_between("last_restock_date", day(as_of)).alias("days_since_restock"),
        )
    )
    order = [_desc("review_count"), F.col("current_stock").asc_nulls_last()]
    return top_k(out, [*order, *[F.col(c).asc_nulls_last() for c in keys if c != "current_stock"]], k)


def warehouse_performance(inventory: DataFrame, as_of: Day) -> DataFrame:
    return (
        inventory.groupBy("warehouse", "region", "country")
        .agg(
            F.countDistinct("product_id").alias("product_count"),
            F.sum("current_stock").alias("total_stock"),
            avg("lead_time", 1).alias("avg_lead_time_days"),
            F.count_if(_below_reorder()).alias("products_below_reorder"),
            rate(_below_reorder()).alias("stockout_risk_rate"),
            avg(days_between("last_restock_date", day(as_of)), 0).alias("avg_days_since_restock"),
        )
        .orderBy(_desc("total_stock"), "warehouse", "region", "country")
    )


def supplier_vs_stockout(
    suppliers: DataFrame, inventory: DataFrame, fanout_safe: bool = False
) -> DataFrame:
    """Supplier quality of a category and region against its low stock.

    As defined, every supplier meets every stock row of its category and region, so the
    counts of one side are multiplied by the size of the other and the rate can pass 100.
    Both sides are reduced to one row per category and region first. ``fanout_safe`` leaves
    the factors out.
    """
    supply = suppliers.groupBy("product_category", "region").agg(
        rows().alias("n"),
        F.countDistinct("supplier_id").alias("supplier_count"),
        avg("reliability_score").alias("avg_supplier_reliability"),
        avg("lead_time", 1).alias("avg_supplier_lead_time"),
        F.count_if(F.col("quality_rating").isin("A", "B")).alias("good"),
    )
    stock = inventory.groupBy(F.col("product_category").alias("_c"), F.col("region").alias("_r")).agg(
        rows().alias("stock_rows"),
        F.countDistinct("product_id").alias("products"),
        F.count_if(_below_reorder()).alias("low"),
    )
    if fanout_safe:
        good, low = F.col("good"), F.coalesce("low", F.lit(0))
    else:
        good = F.col("good") * F.coalesce("stock_rows", F.lit(1))
        low = F.coalesce(F.col("low") * F.col("n"), F.lit(0))
    products = F.coalesce("products", F.lit(0))
    same = (F.col("product_category") == F.col("_c")) & (F.col("region") == F.col("_r"))
    return (
        supply.join(stock, same, "left")
        .select(
            "product_category",
            "region",
            "supplier_count",
            "avg_supplier_reliability",
            "avg_supplier_lead_time",
            good.alias("high_quality_suppliers"),
            products.alias("products_in_category"),
            low.alias("products_low_stock"),
            pct(low, products).alias("stockout_rate"),
        )
        .orderBy(_desc("stockout_rate"), "product_category", "region")
    )


def stock_vs_reviews(inventory: DataFrame, reviews: DataFrame, fanout_safe: bool = False) -> DataFrame:
    """Low stock of a category against its negative reviews.

    As defined, every stock row meets every review of its product. Reviews are reduced to
    products before the join, stock rows to (product, category). ``fanout_safe`` counts
    stock rows once and reviews once.
    """
    stock = inventory.groupBy("product_id", "product_category").agg(
        rows().alias("copies"), F.count_if(_below_reorder()).alias("low")
    )
    per_product = reviews.groupBy(F.col("product_id").alias("_p")).agg(
        rows().alias("n"),
        F.count_if(F.col("rating") <= 2).alias("bad"),
        F.sum("rating").alias("stars"),
        F.count("rating").alias("rated"),
    )
    low_factor = F.lit(1) if fanout_safe else F.coalesce("n", F.lit(1))
    copies = F.lit(1) if fanout_safe else F.col("copies")
    counts = (
        stock.join(per_product, F.col("product_id") == F.col("_p"), "left")
        .groupBy("product_category")
        .agg(
            F.countDistinct("product_id").alias("total_products"),
            F.sum(F.col("low") * low_factor).alias("products_low_stock"),
            F.coalesce(F.sum(F.col("bad") * copies), F.lit(0)).alias("negative_reviews"),
            F.sum(F.col("stars") * copies).alias("stars"),
            F.sum(F.col("rated") * copies).alias("rated"),
        )
    )
    # a review may be filed under several products, so ids are counted per category
    ids = reviews.select(F.col("product_id").alias("_p"), "review_id")
    reviewed = (
        stock.select("product_id", F.col("product_category").alias("_c"))
        .join(ids, F.col("product_id") == F.col("_p"))
        .groupBy("_c")
        .agg(F.countDistinct("review_id").alias("_reviews"))
    )
    total = F.coalesce("_reviews", F.lit(0))
    return (
        counts.join(reviewed, F.col("product_category").eqNullSafe(F.col("_c")), "left")
        .select(
            "product_category",
            "total_products",
            "products_low_stock",
            total.alias("total_reviews"),
            "negative_reviews",
            mean(F.col("stars"), F.col("rated")).alias("avg_rating"),
            pct(F.col("negative_reviews"), total).alias("negative_review_rate"),
        )
        .orderBy(_desc("products_low_stock"), "product_category")
    )


def _dated(shipping: DataFrame) -> DataFrame:
    return shipping.filter(F.col("ship_date").isNotNull() & F.col("estimated_delivery").isNotNull())


def _delivery_days():
    return days_between("ship_date", "estimated_delivery")


def carrier_delays(shipping: DataFrame) -> DataFrame:
    delivered = F.col("status") == "Delivered"
    return (
        _dated(shipping)
        .groupBy("carrier", "shipping_method")
        .agg(
            rows().alias("shipment_count"),
            avg(_delivery_days(), 1).alias("avg_delivery_days"),
            F.min(_delivery_days()).alias("min_delivery_days"),
            F.max(_delivery_days()).alias("max_delivery_days"),
            avg("shipping_cost").alias("avg_shipping_cost"),
            F.count_if(delivered).alias("delivered_count"),
            rate(delivered).alias("delivery_success_rate"),
        )
        .orderBy(F.col("avg_delivery_days").asc_nulls_last(), "carrier", "shipping_method")
    )


def region_delays(shipping: DataFrame, k: int = 20, min_shipments: int = 10) -> DataFrame:
    out = (
        _dated(shipping)
        .groupBy("destination_region", "destination_country")
        .agg(
            rows().alias("shipment_count"),
            avg(_delivery_days(), 1).alias("avg_delivery_days"),
            avg("shipping_cost").alias("avg_shipping_cost"),
            F.countDistinct("carrier").alias("carrier_diversity"),
            F.mode("status", True).alias("most_common_status"),
        )
        .filter(F.col("shipment_count") >= min_shipments)
    )
    order = [_desc("avg_delivery_days"), F.col("destination_region"), F.col("destination_country")]
    return top_k(out, order, k)


def speed_vs_cost(shipping: DataFrame) -> DataFrame:
    return (
        _dated(shipping)
        .withColumn("delivery_days", _delivery_days())
        .withColumn("delivery_speed_category", labels.DELIVERY_SPEED.of("delivery_days"))
        .groupBy("delivery_speed_category")
        .agg(
            rows().alias("shipment_count"),
            avg("delivery_days", 1).alias("avg_days"),
            avg("shipping_cost").alias("avg_cost"),
            dbl(F.min("shipping_cost")).alias("min_cost"),
            dbl(F.max("shipping_cost")).alias("max_cost"),
            F.countDistinct("carrier").alias("carrier_count"),
        )
        .orderBy(F.col("avg_days").asc_nulls_last(), "delivery_speed_category")
    )


def status_share(shipping: DataFrame) -> DataFrame:
    per_status = shipping.groupBy("status").agg(
        rows().alias("shipment_count"),
        avg(_delivery_days(), 1).alias("avg_delivery_days"),
        avg("shipping_cost").alias("avg_cost"),
        F.countDistinct("carrier").alias("carriers_involved"),
    )
    # one row per status, so the total over all of them is a one-task window
    total = F.sum("shipment_count").over(Window.partitionBy())
    return per_status.select(
        "status",
        "shipment_count",
        pct(F.col("shipment_count"), total).alias("percentage"),
        "avg_delivery_days",
        "avg_cost",
        "carriers_involved",
    ).orderBy(_desc("shipment_count"), "status")
