"""Profiles, distributions and rule violations of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.functions.exprs import avg, pct, rows


def profile(df: DataFrame) -> DataFrame:
    """Rows, NULLs, smallest and largest value and mean of every column, in one pass."""
    def mean_of(field: T.StructField) -> Column:
        numeric = isinstance(field.dataType, (T.IntegralType, T.FractionalType))
        return avg(field.name, 4) if numeric else F.lit(None).cast("double")

    wide = df.agg(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                rows().alias("row_count"),
                F.count_if(F.col(f.name).isNull()).alias("null_count"),
                F.min(f.name).cast("string").alias("min_value"),
                F.max(f.name).cast("string").alias("max_value"),
                mean_of(f).alias("mean_value"),
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"`{f.name}`") for f in df.schema.fields])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value."""
    grouped = df.groupBy(F.col(column).cast("string").alias("value")).agg(rows().alias("row_count"))
    # over the values, not the rows: one row per value meets in the window
    total = F.sum("row_count").over(Window.partitionBy())
    return grouped.withColumn("percentage", pct(F.col("row_count"), total)).orderBy(
        F.col("row_count").desc(), F.col("value").asc_nulls_last()
    )


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Approximate percentiles of a numeric column."""
    return df.agg(F.percentile_approx(column, list(at)).alias("percentiles"))


def sketches(df: DataFrame, *by: str) -> DataFrame:
    """Per column, and per value of ``by``: rows, NULLs and sketches of quantiles and distinct values.

    One pass over the table, whatever the number of columns; days count as numbers, other types have
    no quantiles. A sketch is a few kilobytes at any number of rows. Those of parts of a table, such as
    the loads of each day, are stored and put together by ``merged``, without reading the rows again.
    """

    def number(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DateType):
            return F.unix_date(field.name).cast("double")
        numeric = isinstance(field.dataType, (T.IntegralType, T.FractionalType))
        return F.col(field.name).cast("double") if numeric else F.lit(None).cast("double")

    fields = [f for f in df.schema.fields if f.name not in by]
    wide = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                rows().alias("row_count"),
                F.count_if(F.col(f.name).isNull()).alias("null_count"),
                F.when(F.count(number(f)) > 0, F.kll_sketch_agg_double(number(f))).alias("quantiles"),
                F.hll_sketch_agg(F.col(f.name).cast("string")).alias("values"),
            ).alias(f.name)
            for f in fields
        ]
    )
    return wide.select(*by, F.inline(F.array(*[F.col(f"`{f.name}`") for f in fields])))


def merged(sketched: DataFrame) -> DataFrame:
    """One row per column from the sketches of parts."""
    return sketched.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
        F.hll_union_agg("values").alias("values"),
    )


def quartiles(sketched: DataFrame) -> DataFrame:
    """What sketches tell: quartiles, whose ranks are within 2 % of the rows, and distinct values, within 5 %."""
    at = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    read = [F.kll_sketch_get_quantile_double("quantiles", F.lit(rank)).alias(name) for name, rank in at.items()]
    return sketched.select(
        "column_name", "row_count", "null_count", *read, F.hll_sketch_estimate("values").alias("distinct_count")
    )


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Number of rows that break each rule; ``rules`` holds the conditions of a fault."""
    wide = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("row_count")) for n in rules]
    return wide.select(F.inline(F.array(*pairs)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur how often."""
    per_key = df.groupBy(*keys).agg(rows().alias("copies"))
    return per_key.groupBy("copies").agg(rows().alias("key_count")).orderBy("copies")


FAULTS = {
    "financial_transactions": lambda: {"negative_amount": F.col("amount") < 0},
    "promotions": lambda: {
        "discount_out_of_range": (F.col("discount_percentage") < 0) | (F.col("discount_percentage") > 1),
        "reversed_period": F.col("end_date") < F.col("start_date"),
        "open_period": F.col("end_date").isNull(),
    },
    "marketing_campaigns": lambda: {
        "conversion_out_of_range": (F.col("conversion_rate") < 0) | (F.col("conversion_rate") > 1),
        "reversed_period": F.col("end_date") < F.col("start_date"),
    },
    "inventory": lambda: {
        "negative_stock": F.col("current_stock") < 0,
        "unknown_stock": F.col("current_stock").isNull(),
    },
    "customer_service_interactions": lambda: {
        "satisfaction_out_of_range": (F.col("customer_satisfaction") < 0)
        | (F.col("customer_satisfaction") > 5),
    },
    "employee_records": lambda: {
        "hired_before_birth": F.col("date_of_birth") >= F.col("hire_date"),
        "unknown_birth": F.col("date_of_birth").isNull(),
    },
}
