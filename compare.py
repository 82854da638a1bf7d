"""Row-by-row forms against the forms this library uses, on $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retail_lake.operators.intervals import interval_join
from retail_lake.operators.ranking import exact_ntiles
from retail_lake.plans.reports import logistics, marketing, promotions
from retail_lake.sources.lake import ParquetLake

PERIOD = (["region"], "transaction_date", "start_date", "end_date")


def pairs(k: ParquetLake, strategy: str) -> DataFrame:
    tx = k.transactions("transaction_id", "region", "transaction_date", "amount")
    promos = k.promotions("promotion_id", "region", "start_date", "end_date")
    return interval_join(tx, promos, *PERIOD, "left", strategy)


def promo_rows(k: ParquetLake) -> DataFrame:
    marked = pairs(k, "days").withColumn("promo_status", F.col("promotion_id").isNotNull())
    return marked.groupBy("promo_status").agg(F.count("*"), F.sum("amount"), F.avg("amount"))


def promo_days(k: ParquetLake) -> DataFrame:
    return promotions.vs_no_promotion(
        k.transactions("region", "transaction_date", "amount"), k.promotions("region", "start_date", "end_date")
    )


def region_rows(k: ParquetLake) -> DataFrame:
    ads = k.campaigns("campaign_id", "region", "budget", "start_date", "end_date")
    tx = k.transactions("transaction_id", "region", "transaction_date", "amount")
    met = interval_join(tx, ads, *PERIOD, "inner", "days")
    return met.groupBy("region").agg(
        F.countDistinct("transaction_id"), F.countDistinct("campaign_id"), F.sum("budget"), F.sum("amount")
    )


def region_days(k: ParquetLake) -> DataFrame:
    return marketing.by_region(k.transactions("region", "transaction_date", "amount"), k.campaigns())


def supplier_rows(k: ParquetLake) -> DataFrame:
    stock = k.inventory("product_id", "product_category", "region", "current_stock", "reorder_point")
    met = k.suppliers().join(stock, ["product_category", "region"], "left")
    return met.groupBy("product_category", "region").agg(
        F.countDistinct("supplier_id"), F.countDistinct("product_id"), F.avg("reliability_score"), F.count("*")
    )


def supplier_totals(k: ParquetLake) -> DataFrame:
    stock = k.inventory("product_id", "product_category", "region", "current_stock", "reorder_point")
    return logistics.supplier_vs_stockout(k.suppliers(), stock)


def spend(k: ParquetLake) -> DataFrame:
    return k.transactions("entity", "amount").groupBy("entity").agg(F.sum("amount").alias("v"))


def window_ntile(k: ParquetLake) -> DataFrame:
    return spend(k).withColumn("b", F.ntile(5).over(Window.orderBy("v", "entity")))


def ranged_ntile(k: ParquetLake) -> DataFrame:
    return exact_ntiles(spend(k), 5, "entity", {"b": ("v", False)})


CASES = {
    "interval_join range": lambda k: pairs(k, "range"),
    "interval_join days": lambda k: pairs(k, "days"),
    "promotion report by rows": promo_rows,
    "promotion report by days": promo_days,
    "campaign region report by rows": region_rows,
    "campaign region report by days": region_days,
    "supplier report by pairs": supplier_rows,
    "supplier report by totals": supplier_totals,
    "ntile in one window task": window_ntile,
    "ntile by range partitions": ranged_ntile,
}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lake = ParquetLake(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    seconds = {}
    for name, case in CASES.items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            case(lake).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"unit": "sec", "cases": seconds, "folder": lake.folder}))


if __name__ == "__main__":
    main()
