"""Silver and bronze frames over the Parquet test tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.plans import silver
from retail_lake.session import configure
from retail_lake.sources.fixture_spec import AS_OF, BRONZE, RAW_TEXT_COLUMNS, SILVER
from retail_lake.sources.schemas import TEST_TABLES


class ParquetLake:
    """Lazy access to the tables; name the columns a report reads to skip idle lookups."""

    def __init__(self, spark: SparkSession, folder: str, as_of: str = AS_OF):
        self.spark = configure(spark)
        self.folder = folder
        self.as_of = as_of

    def raw(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.parquet"
        return self.spark.read.schema(TEST_TABLES[table]).parquet(path)

    def silver(self, table: str, columns: Iterable[str] | None = None) -> DataFrame:
        spec = SILVER[table]
        wanted = list(columns) if columns else list(spec.columns)
        df = self.raw(spec.base)
        if spec.slots > 1:
            df = df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(spec.slots - 1))))
        text = " ".join(spec.columns[c] for c in wanted)
        needed = -1
        for i, (name, _, _) in enumerate(spec.lookups):
            if spec.prefix[name] in text:
                needed = i
        for name, left, key in spec.lookups[: needed + 1]:
            df = df.join(self.raw(name), F.expr(left) == F.col(key), "left")
        return df.selectExpr(*[f"{spec.columns[c]} as {c}" for c in wanted])

    def bronze(self, table: str, spread: bool = False) -> DataFrame:
        """Every row twice, with faults; ``spread`` deals the rows by their key first.

        A file may be a single task however many rows come of it. Those that are to be sorted or grouped by the
        key are then shared out before, and need no exchange for it afterwards.
        """
        rows = self.silver(table)
        if spread:
            rows = rows.repartition(next(iter(SILVER[table].columns)))
        df = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(1))))
        faults = BRONZE[table]
        names = [*SILVER[table].columns, *(c for c in faults if c not in SILVER[table].columns)]
        return df.selectExpr(*[f"{faults.get(c, c)} as {c}" for c in names])

    def raw_text_transactions(self) -> DataFrame:
        df = self.silver("financial_transactions", ["transaction_id", "transaction_date", "amount"])
        return df.selectExpr(*[f"{e} as {c}" for c, e in RAW_TEXT_COLUMNS.items()])

    def transactions(self, *columns: str) -> DataFrame:
        return self.silver("financial_transactions", columns)

    def customers(self, *columns: str) -> DataFrame:
        plain = [c for c in columns if c not in ("age", "age_group")]
        if len(plain) < len(columns) and "date_of_birth" not in plain:
            plain.append("date_of_birth")
        df = silver.with_age(self.silver("customer_demographics", plain), self.as_of)
        return df.select(*columns) if columns else df

    def promotions(self, *columns: str) -> DataFrame:
        return self.silver("promotions", columns)

    def campaigns(self, *columns: str) -> DataFrame:
        return self.silver("marketing_campaigns", columns)

    def reviews(self, *columns: str) -> DataFrame:
        return self.silver("product_reviews", columns)

    def inventory(self, *columns: str) -> DataFrame:
        return self.silver("inventory", columns)

    def shipping(self, *columns: str) -> DataFrame:
        return self.silver("logistics_and_shipping", columns)

    def suppliers(self, *columns: str) -> DataFrame:
        return self.silver("supplier_information", columns)

    def interactions(self, *columns: str) -> DataFrame:
        return self.silver("customer_service_interactions", columns)
