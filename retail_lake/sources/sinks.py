"""Tables, exports and load checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.functions.exprs import rows
from retail_lake.session import discard


def create_or_replace_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> None:
    """Write ``df`` as the table ``name``, replacing what was there once the new rows are written.

    The rows go to a table of another name first, which then takes the place of the old one. So a write
    that fails leaves the old rows as they were, and ``df`` may read the table that it replaces. Files
    lie below the folder of the database, in one of their own for each write.

    ``partition_by`` lets readers skip files; the rows are gathered per partition first, and
    Spark splits those that are too large, so that files have an even size. ``bucket_by``
    (number, keys) saves the shuffle of later joins and groupings on the keys; rows are dealt by
    the keys first, which gives one file per bucket. A key with a third of all rows makes one
    file of that size.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        number, keys = bucket_by
        writer = df.repartition(number, *keys).write.mode("overwrite").format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer = writer.bucketBy(number, *keys).sortBy(*keys)
    spark, token = df.sparkSession, uuid4().hex
    staged, old = f"{name}__new_{token}", f"{name}__old_{token}"
    folder = _folder_of(spark, name)
    try:
        writer.option("path", f"{folder}-{token}").saveAsTable(staged)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        discard(spark, f"{folder}-{token}")
        raise
    place = None
    if spark.catalog.tableExists(name):
        place = _location(spark, name)
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    if place:
        spark.sql(f"DROP TABLE {old}")
        if place.startswith(f"{folder}-"):  # written by this function, so the table's own
            discard(spark, place)


def _folder_of(spark: SparkSession, name: str) -> str:
    """Where tables of this name lie, each in a folder with a mark of its own behind the name."""
    *above, table = name.split(".")
    database = above[-1] if above else spark.catalog.currentDatabase()
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{table}"


def _location(spark: SparkSession, name: str) -> str:
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    return told["Location"]


def export_csv(report: DataFrame, path: str) -> None:
    """One CSV file with a header, for a report whose limit keeps it small."""
    report.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows per table."""
    counts = [
        df.agg(rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
