"""Customer service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.exprs import avg, dbl, rate, rows


def _resolved():
    return F.col("resolution_status") == "Resolved"


def issue_satisfaction(interactions: DataFrame) -> DataFrame:
    return (
        interactions.groupBy("issue_category")
        .agg(
            rows().alias("interaction_count"),
            avg("customer_satisfaction").alias("avg_satisfaction"),
            avg("duration_minutes", 1).alias("avg_duration_minutes"),
            F.count_if(_resolved()).alias("resolved_count"),
            rate(_resolved()).alias("resolution_rate"),
            F.count_if(F.col("follow_up_required") == "Yes").alias("follow_ups_needed"),
        )
        .orderBy(F.col("avg_satisfaction").desc_nulls_last(), "issue_category")
    )


def channel_satisfaction(interactions: DataFrame) -> DataFrame:
    return (
        interactions.groupBy("interaction_type")
        .agg(
            rows().alias("interaction_count"),
            avg("customer_satisfaction").alias("avg_satisfaction"),
            avg("duration_minutes", 1).alias("avg_duration"),
            F.count_if(_resolved()).alias("resolved_count"),
            rate(_resolved()).alias("resolution_rate"),
        )
        .orderBy(F.col("avg_satisfaction").desc_nulls_last(), "interaction_type")
    )


def resolution_time(interactions: DataFrame) -> DataFrame:
    return (
        interactions.filter(_resolved())
        .groupBy("issue_category")
        .agg(
            rows().alias("interaction_count"),
            avg("duration_minutes", 1).alias("avg_resolution_time_minutes"),
            dbl(F.min("duration_minutes")).alias("min_time"),
            dbl(F.max("duration_minutes")).alias("max_time"),
            avg("customer_satisfaction").alias("avg_satisfaction"),
        )
        .orderBy(F.col("avg_resolution_time_minutes").asc_nulls_last(), "issue_category")
    )
