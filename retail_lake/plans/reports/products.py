"""Product and category performance.

Where the definition joins reviews to stock rows and then aggregates, the reviews are
reduced to one row per product before the join and the copies are put back as factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import avg, mean, money, rate, rows
from retail_lake.operators.ranking import ranks, top_k


def _desc(name: str):
    return F.col(name).desc_nulls_last()


def top_reviewed(
    reviews: DataFrame, inventory: DataFrame, k: int = 20, fanout_safe: bool = False
) -> DataFrame:
    """Most reviewed products.

    As defined, each review counts once per stock row of its product; with ``fanout_safe``
    it counts once.
    """
    per_product = reviews.groupBy("product_id").agg(
        rows().alias("n"),
        F.sum("rating").alias("stars"),
        F.count("rating").alias("rated"),
        F.sum("helpful_votes").alias("helpful"),
        F.sum("total_votes").alias("votes"),
    )
    stock_rows = inventory.groupBy(F.col("product_id").alias("_p")).agg(rows().alias("copies"))
    copies = F.lit(1) if fanout_safe else F.coalesce("copies", F.lit(1))
    out = per_product.join(stock_rows, F.col("product_id") == F.col("_p"), "left").select(
        "product_id",
        (F.col("n") * copies).alias("review_count"),
        mean(F.col("stars"), F.col("rated")).alias("avg_rating"),
        (F.col("helpful") * copies).alias("total_helpful_votes"),
        (F.col("votes") * copies).alias("total_votes"),
    )
    return top_k(out, [_desc("review_count"), F.col("product_id")], k)


def best_rated(reviews: DataFrame, k: int = 20, min_reviews: int = 10) -> DataFrame:
    out = (
        reviews.groupBy("product_id")
        .agg(rows().alias("review_count"), avg("rating").alias("avg_rating"))
        .filter(F.col("review_count") >= min_reviews)
    )
    return top_k(out, [_desc("avg_rating"), _desc("review_count"), F.col("product_id")], k)


def category_ratings(reviews: DataFrame, reviewers: DataFrame | None = None) -> DataFrame:
    """``reviewers``: category and reviewer of the same reviews, read without what the rest needs.

    Products and reviewers are counted apart, so no row is copied for each of the counts.
    """
    if reviewers is None:
        reviewers = reviews
    per_product = reviews.groupBy(F.col("product_category").alias("category"), "product_id").agg(
        rows().alias("n"), F.sum("rating").alias("total"), F.count("rating").alias("rated")
    )
    per_category = per_product.groupBy("category").agg(
        F.sum("n").alias("review_count"),
        mean(F.sum("total"), F.sum("rated")).alias("avg_rating"),
        F.count("product_id").alias("unique_products"),
    )
    # dealt first: a part of the reviews has nearly as many pairs as rows, and a task would hold them all
    people = (
        reviewers.select(F.col("product_category").alias("_category"), "reviewer_id")
        .repartition("_category", "reviewer_id")
        .distinct()
    )
    counted = people.groupBy("_category").agg(F.count("reviewer_id").alias("unique_reviewers"))
    return (
        per_category.join(counted, F.col("category").eqNullSafe(F.col("_category")))
        .drop("_category")
        .orderBy(_desc("avg_rating"), "category")
    )


def category_stock(inventory: DataFrame) -> DataFrame:
    return (
        inventory.groupBy("product_category")
        .agg(
            F.countDistinct("product_id").alias("product_count"),
            F.sum("current_stock").alias("total_stock"),
            avg("current_stock", 0).alias("avg_stock_per_product"),
            F.countDistinct("warehouse").alias("warehouse_count"),
        )
        .orderBy(_desc("total_stock"), "product_category")
    )


def category_promos(promotions: DataFrame) -> DataFrame:
    return (
        promotions.groupBy("product_category")
        .agg(
            rows().alias("promo_count"),
            avg("discount_percentage").alias("avg_discount"),
            F.min("start_date").alias("first_promo"),
            F.max("end_date").alias("last_promo"),
        )
        .orderBy(_desc("promo_count"), "product_category")
    )


def category_campaigns(campaigns: DataFrame) -> DataFrame:
    return (
        campaigns.groupBy("product_category")
        .agg(
            rows().alias("campaign_count"),
            money("budget").alias("total_budget"),
            avg("conversion_rate").alias("avg_conversion_rate"),
            avg("reach", 0).alias("avg_reach"),
        )
        .orderBy(_desc("total_budget"), "product_category")
    )


def rating_vs_stock(reviews: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products per rating bucket with their mean reviews and stock.

    One input row per product, category and distinct (stock, reorder point) pair. Review ids are
    unique, as cleaning leaves them.
    """
    per_product = reviews.groupBy("product_id", "product_category").agg(
        F.count("review_id").alias("review_count"), avg("rating").alias("avg_rating")
    )
    stock = inventory.select(
        F.col("product_id").alias("_p"), "current_stock", "reorder_point"
    ).distinct()
    stock_level = (
        F.when(F.col("current_stock") < F.col("reorder_point"), labels.LOW_STOCK)
        .when(
            F.col("current_stock").between(F.col("reorder_point"), F.col("reorder_point") * 3),
            labels.NORMAL_STOCK,
        )
        .otherwise(labels.HIGH_STOCK)
    )
    return (
        per_product.filter(F.col("avg_rating").isNotNull())
        .join(stock, F.col("product_id") == F.col("_p"), "left")
        .withColumn("rating_category", labels.RATING_BUCKET.of("avg_rating"))
        .groupBy("rating_category")
        .agg(
            rows().alias("product_count"),
            avg("review_count", 0).alias("avg_reviews_per_product"),
            avg("current_stock", 0).alias("avg_stock_level"),
            F.count_if(stock_level == labels.LOW_STOCK).alias("products_low_stock"),
        )
        .orderBy(F.col("rating_category").desc())
    )


def popular_vs_stock(
    reviews: DataFrame, inventory: DataFrame, k: int = 30, min_reviews: int = 10
) -> DataFrame:
    """Often reviewed products with the state of their stock, one row per stock row."""
    per_product = reviews.groupBy("product_id", "product_category").agg(
        rows().alias("n"), avg("rating").alias("avg_rating")
    )
    columns = ["current_stock", "reorder_point", "warehouse", "region"]
    stock = inventory.groupBy(F.col("product_id").alias("_p"), *columns).agg(rows().alias("copies"))
    low = F.col("current_stock")
    stock_status = (
        F.when(low < F.col("reorder_point"), labels.STOCK_RISK)
        .when(low < F.col("reorder_point") * 2, labels.STOCK_LOW)
        .otherwise(labels.STOCK_OK)
    )
    out = (
        per_product.join(stock, F.col("product_id") == F.col("_p"), "left")
        .withColumn("review_count", F.col("n") * F.coalesce("copies", F.lit(1)))
        .filter(F.col("review_count") >= min_reviews)
        .select(
            "product_id",
            "product_category",
            "review_count",
            "avg_rating",
            "current_stock",
            "reorder_point",
            stock_status.alias("stock_status"),
            "warehouse",
            "region",
        )
    )
    order = [_desc("review_count"), _desc("avg_rating"), F.col("product_id"), F.col("product_category")]
    return top_k(out, [*order, *[F.col(c).asc_nulls_last() for c in columns]], k)


def negative_reviews(reviews: DataFrame) -> DataFrame:
    bad, good = F.col("rating") <= 2, F.col("rating") >= 4
    return (
        reviews.groupBy("product_category")
        .agg(
            F.count_if(bad).alias("negative_reviews"),
            F.count_if(good).alias("positive_reviews"),
            rows().alias("total_reviews"),
            rate(bad).alias("negative_review_rate"),
            avg("rating").alias("avg_rating"),
        )
        .orderBy(_desc("negative_review_rate"), "product_category")
    )


def rank_in_category(reviews: DataFrame) -> DataFrame:
    """Every product ranked by its number of reviews within its category."""
    per_product = reviews.groupBy("product_category", "product_id").agg(rows().alias("review_count"))
    return ranks(per_product, "product_category", "review_count", "product_id", percent=False).select(
        "product_category",
        "product_id",
        "review_count",
        F.col("row_number").alias("row_num"),
        F.col("rank").alias("review_rank"),
        F.col("dense_rank").alias("review_dense_rank"),
    )
