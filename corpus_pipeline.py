"""A training corpus from raw documents: each stage works on all that the one before has kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from retail_lake.llm import packing, positional, quality, secret_scan, token_groups
from retail_lake.llm.common import RANKS, VOCABULARY, read_table
from retail_lake.session import configure, discard, scope, scratch_dir

#: The stages have no SQL form: a network and a random field are trained on the way.
ORACLE_SQL = None


#: Rows that Spark hands a Python worker together, at most: both sides hold them, beside what is worked out.
BATCH = 2_000


def _set_up(spark: SparkSession) -> SparkSession:
    """The session's settings, and small batches: texts are long, and a batch is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return configure(spark)


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read_table(_set_up(spark), sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 80 % alike or more."""
    _set_up(spark)
    return token_groups.keep_one(docs, k=5, t=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no phrase of a benchmark item occurs."""
    return positional.clean(docs, read_table(_set_up(spark), sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    _set_up(spark)
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of nearly equal fill, with their ids."""
    _set_up(spark)
    return packing.pack(docs, "doc_id", "text", VOCABULARY, RANKS)


STAGES = [
    ("quality", good_texts),
    ("near_duplicates", distinct_texts),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    What a stage writes on its way is deleted once its result is written; of the results, the last stays.
    Null and empty texts, repeated rows, empty tables and columns with other names are handled by each
    stage as its operator says; all stages but the last keep the columns of ``documents``.
    """
    _set_up(spark)
    docs = read_table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        folder = f"{base}-{number}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
