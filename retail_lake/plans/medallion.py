"""The layers end to end: raw files, bronze, silver, gold and feature tables.

Each step reads the tables of the one before by name and writes its own, so that a step can
be repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.plans import features, gold
from retail_lake.plans.silver import CLEANERS, RULES, Day, refused
from retail_lake.session import configure
from retail_lake.sources.readers import read_raw, rejects, scan, typed
from retail_lake.sources.schemas import SCHEMAS
from retail_lake.sources.sinks import create_or_replace_table, load_counts

# Tables joined or grouped by the same key over and over are written in buckets of it.
BUCKET_KEYS = {
    "financial_transactions_clean": "entity",
    "customer_demographics_clean": "customer_id",
    "product_reviews_clean": "product_id",
    "inventory_clean": "product_id",
}


def _database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def ingest(spark: SparkSession, paths: dict[str, str], database: str = "bronze") -> DataFrame:
    """Raw files to typed bronze tables, and what does not fit to a table of rejects for each.

    Returns the row counts of both.
    """
    configure(spark)
    _database(spark, database)
    written = []
    for table, path in paths.items():
        raw = read_raw(spark, table, path)
        create_or_replace_table(typed(raw, SCHEMAS[table]), f"{database}.{table}")
        create_or_replace_table(rejects(raw, SCHEMAS[table]), f"{database}.{table}_rejects")
        written += [table, f"{table}_rejects"]
    return load_counts({t: scan(spark, f"{database}.{t}") for t in written})


def clean(
    spark: SparkSession, as_of: Day, source: str = "bronze", target: str = "silver", buckets: int = 0
) -> None:
    """Bronze to silver; with ``buckets`` the keyed tables are bucketed.

    Rows that a rule refuses go to ``<table>_refused``, with the rules they break.
    """
    configure(spark)
    _database(spark, target)
    for table, cleaner in CLEANERS.items():
        name = f"{table}_clean"
        key = BUCKET_KEYS.get(name)
        create_or_replace_table(
            cleaner(scan(spark, f"{source}.{table}"), as_of),
            f"{target}.{name}",
            bucket_by=(buckets, [key]) if buckets and key else None,
        )
        if table in RULES:
            create_or_replace_table(refused(table, scan(spark, f"{source}.{table}"), as_of), f"{target}.{table}_refused")


def build_gold(spark: SparkSession, as_of: Day, source: str = "silver", target: str = "gold") -> None:
    """Silver to the wide sales table, the customer scores and the inputs of the features."""
    configure(spark)
    _database(spark, target)

    def silver(table: str) -> DataFrame:
        return scan(spark, f"{source}.{table}_clean")

    def write(df: DataFrame, name: str, *partition_by: str) -> None:
        create_or_replace_table(df, f"{target}.{name}", partition_by)

    tx, people = silver("financial_transactions"), silver("customer_demographics")
    promos, ads = silver("promotions"), silver("marketing_campaigns")
    write(gold.sales_enriched(tx, people, promos, ads), "sales_full_enriched", "month")
    write(gold.rfm(tx, promos, ads, as_of), "customer_rfm")
    write(gold.lifetime_value(tx, promos, ads), "customer_lifetime_value")
    write(gold.churn(tx, as_of), "churn_indicators")
    write(gold.client_profile(tx, people, promos, as_of), "profil_clients")
    write(
        gold.enriched_rows(tx, promos, ads).withColumn("mois", F.trunc("transaction_date", "month")),
        "ventes_enrichies",
        "mois",
    )
    write(gold.daily_sales(tx, promos, ads), "ventes_par_jour")
    write(gold.product_performance(silver("product_reviews"), silver("inventory"), as_of), "perf_produits")
    write(gold.promotion_analysis(tx, promos), "analyse_promotions")
    write(gold.campaign_performance(tx, ads), "perf_campagnes")


FEATURES = {
    "features_clients": ("profil_clients", features.clients),
    "features_ventes": ("ventes_par_jour", features.sales),
    "features_produits": ("perf_produits", features.products),
    "features_promotions": ("analyse_promotions", features.promotions),
    "features_campagnes": ("perf_campagnes", features.campaigns),
}


def build_features(spark: SparkSession, database: str = "gold") -> DataFrame:
    """Gold inputs to the five feature tables; returns their row counts."""
    configure(spark)
    for name, (source, build) in FEATURES.items():
        create_or_replace_table(build(scan(spark, f"{database}.{source}")), f"{database}.{name}")
    return load_counts({n: scan(spark, f"{database}.{n}") for n in FEATURES})
