"""Who the customers are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import avg, pct, rows


def _with_share(grouped: DataFrame, name: str = "percentage") -> DataFrame:
    """Share of all rows per group, over the already grouped frame."""
    total = F.sum("customer_count").over(Window.partitionBy())
    return grouped.withColumn(name, pct(F.col("customer_count"), total))


def _most_first(*then: str) -> list[Column]:
    return [F.col("customer_count").desc(), *[F.col(c).asc_nulls_last() for c in then]]


def _by(customers: DataFrame, column: str) -> DataFrame:
    grouped = customers.groupBy(column).agg(
        rows().alias("customer_count"), avg("annual_income").alias("avg_income")
    )
    return _with_share(grouped).select(column, "customer_count", "percentage", "avg_income")


def by_gender(customers: DataFrame) -> DataFrame:
    return _by(customers, "gender").orderBy(*_most_first("gender"))


def by_age_group(customers: DataFrame) -> DataFrame:
    known = customers.filter(F.col("date_of_birth").isNotNull())
    return _by(known, "age_group").orderBy("age_group")


def by_marital_status(customers: DataFrame) -> DataFrame:
    return _by(customers, "marital_status").orderBy(*_most_first("marital_status"))


def by_income(customers: DataFrame) -> DataFrame:
    grouped = (
        customers.filter(F.col("annual_income").isNotNull())
        .groupBy(labels.INCOME_BRACKET.of("annual_income").alias("income_bracket"))
        .agg(rows().alias("customer_count"))
    )
    return _with_share(grouped).orderBy("income_bracket")


def top_countries(customers: DataFrame, k: int = 20) -> DataFrame:
    return _by(customers, "country").orderBy(*_most_first("country")).limit(k)


def age_income_matrix(customers: DataFrame) -> DataFrame:
    grouped = (
        customers.filter(F.col("age").isNotNull() & F.col("annual_income").isNotNull())
        .groupBy(
            labels.AGE_SEGMENT.of("age").alias("age_segment"),
            labels.INCOME_SEGMENT.of("annual_income").alias("income_segment"),
        )
        .agg(rows().alias("customer_count"))
    )
    return _with_share(grouped, "percentage_of_total").orderBy(
        *_most_first("age_segment", "income_segment")
    )


def region_persona(customers: DataFrame) -> DataFrame:
    return (
        customers.filter(F.col("age").isNotNull())
        .groupBy("region")
        .agg(
            rows().alias("customer_count"),
            avg("age", 0).alias("avg_age"),
            avg("annual_income").alias("avg_income"),
            F.mode("gender", True).alias("dominant_gender"),
            F.mode("marital_status", True).alias("dominant_marital_status"),
            F.countDistinct("country").alias("country_diversity"),
        )
        .orderBy(*_most_first("region"))
    )
