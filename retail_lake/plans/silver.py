"""Cleaning: bronze frames to validated silver frames, one function per table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.functions import labels
from retail_lake.functions.exprs import days_between, year_span
from retail_lake.operators.ranking import keep_latest

Day = str | dt.date


def day(as_of: Day) -> Column:
    return F.lit(str(as_of)).cast("date")


def clamp(col: str | Column, low: int, high: int) -> Column:
    """Bounded value; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    kept = F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)
    return kept


def fraction(df: DataFrame, column: str, unit: str) -> DataFrame:
    """A share as a fraction from 0 to 1; ``unit`` says what bronze holds, "fraction" or "percent"."""
    value = {"fraction": F.col(column), "percent": F.col(column) / 100}[unit]
    return df.withColumn(column, clamp(value, 0, 1).cast(df.schema[column].dataType))


def _trimmed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def with_age(df: DataFrame, as_of: Day) -> DataFrame:
    """Add age (year boundaries) and age group, if the birth date is there."""
    if "date_of_birth" not in df.columns:
        return df
    df = df.withColumn("age", year_span("date_of_birth", day(as_of)))
    return df.withColumn("age_group", labels.AGE_GROUP.of("age"))


def _period(as_of: Day) -> dict[str, Column]:
    return {"reversed_or_open_period": F.col("end_date") >= F.col("start_date")}


#: What a row must fulfil to be kept, per table; unknown does not.
RULES = {
    "promotions": _period,
    "marketing_campaigns": _period,
    "inventory": lambda as_of: {"negative_stock": F.col("current_stock").isNull() | (F.col("current_stock") >= 0)},
    "employee_records": lambda as_of: {
        "hired_before_birth": F.col("date_of_birth") < F.col("hire_date"),
        "hired_in_the_future": F.col("hire_date") <= day(as_of),
    },
}


def _broken(table: str, as_of: Day) -> Column:
    """The names of the rules that a row breaks, comma-joined; empty if none."""
    fulfilled = {name: F.coalesce(rule, F.lit(False)) for name, rule in RULES[table](as_of).items()}
    return F.concat_ws(",", *[F.when(~rule, name) for name, rule in fulfilled.items()])


def _kept(df: DataFrame, table: str, as_of: Day) -> DataFrame:
    return df.filter(_broken(table, as_of) == "")


def refused(table: str, df: DataFrame, as_of: Day) -> DataFrame:
    """The rows that the cleaner of the table drops by its rules, as they are after keep-latest, and why."""
    keys, latest = LATEST[table]
    df = _trimmed(df, "warehouse") if table == "inventory" else df
    latest_rows = keep_latest(df, keys, latest)
    return latest_rows.withColumn("refused_by", _broken(table, as_of)).filter("refused_by <> ''")


#: Key and date of the tables that have rules.
LATEST = {
    "promotions": (["promotion_id"], "start_date"),
    "marketing_campaigns": (["campaign_id"], "start_date"),
    "inventory": (["product_id", "warehouse"], "last_restock_date"),
    "employee_records": (["employee_id"], "hire_date"),
}


def _with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_days", days_between("start_date", "end_date"))


def clean_transactions(df: DataFrame, as_of: Day) -> DataFrame:
    df = keep_latest(df, ["transaction_id"], "transaction_date")
    return _trimmed(df.withColumn("amount", F.abs("amount")), "region", "payment_method")


def clean_customers(df: DataFrame, as_of: Day) -> DataFrame:
    df = keep_latest(df, ["customer_id"])
    df = _trimmed(df, "name", "gender", "marital_status", "country", "region")
    return with_age(df.withColumn("email", F.lower(F.trim("email"))), as_of)


def clean_promotions(df: DataFrame, as_of: Day, unit: str = "fraction") -> DataFrame:
    df = _kept(keep_latest(df, *LATEST["promotions"]), "promotions", as_of)
    df = fraction(df, "discount_percentage", unit)
    return _with_length(_trimmed(df, "product_category", "promotion_type", "region"))


def clean_campaigns(df: DataFrame, as_of: Day, unit: str = "fraction") -> DataFrame:
    df = _kept(keep_latest(df, *LATEST["marketing_campaigns"]), "marketing_campaigns", as_of)
    df = fraction(df, "conversion_rate", unit)
    return _with_length(_trimmed(df, "campaign_name", "campaign_type", "target_audience", "region"))


def clean_reviews(df: DataFrame, as_of: Day) -> DataFrame:
    return _trimmed(keep_latest(df, ["review_id"], "review_date"), "product_category")


def clean_inventory(df: DataFrame, as_of: Day) -> DataFrame:
    """Copies are those of one product and warehouse, however padded; unknown stock stays."""
    df = _kept(keep_latest(_trimmed(df, "warehouse"), *LATEST["inventory"]), "inventory", as_of)
    df = _trimmed(df, "product_category", "region", "country")
    low = F.col("current_stock") <= F.col("reorder_point")
    return df.withColumn("needs_reorder", F.when(low, True).otherwise(False))


def clean_shipping(df: DataFrame, as_of: Day) -> DataFrame:
    df = keep_latest(df, ["shipment_id"], "ship_date")
    df = _trimmed(df, "status", "carrier", "shipping_method", "destination_region", "destination_country")
    return df.withColumn("delivery_days", days_between("ship_date", "estimated_delivery"))


def clean_suppliers(df: DataFrame, as_of: Day) -> DataFrame:
    return _trimmed(keep_latest(df, ["supplier_id"]), "product_category", "region", "quality_rating")


def clean_interactions(df: DataFrame, as_of: Day) -> DataFrame:
    df = keep_latest(df, ["interaction_id"], "interaction_date")
    df = df.withColumn("customer_satisfaction", clamp("customer_satisfaction", 0, 5))
    return _trimmed(df, "interaction_type", "issue_category", "resolution_status", "follow_up_required")


def clean_employees(df: DataFrame, as_of: Day) -> DataFrame:
    df = _kept(keep_latest(df, *LATEST["employee_records"]), "employee_records", as_of)
    df = _trimmed(df, "name", "department", "country", "region")
    df = df.withColumns({"email": F.lower(F.trim("email")), "status": F.upper(F.trim("status"))})
    return df.withColumn("age", year_span("date_of_birth", day(as_of)))


def clean_stores(df: DataFrame, as_of: Day) -> DataFrame:
    return _trimmed(keep_latest(df, ["store_id"]), "store_name", "store_type", "country", "region")


CLEANERS = {
    "financial_transactions": clean_transactions,
    "customer_demographics": clean_customers,
    "promotions": clean_promotions,
    "marketing_campaigns": clean_campaigns,
    "product_reviews": clean_reviews,
    "inventory": clean_inventory,
    "logistics_and_shipping": clean_shipping,
    "supplier_information": clean_suppliers,
    "customer_service_interactions": clean_interactions,
    "employee_records": clean_employees,
    "store_locations": clean_stores,
}
