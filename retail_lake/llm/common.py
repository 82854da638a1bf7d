"""Small helpers that several operators share."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.session import freeze

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key as a long and the text, under fixed names; other columns never get in the way."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def settled(df: DataFrame) -> DataFrame:
    """``freeze``, then have the shuffle files behind the frame removed.

    Spark's cleaner removes shuffles that nothing refers to any more, but learns of them only when
    the driver collects its garbage, which a small driver heap may not do for a long time.
    """
    out = freeze(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def likely(rows: DataFrame, wanted: DataFrame, key: str, flag: str = "likely", bits: int = 24) -> DataFrame:
    """Add ``flag``: whether the key may be among the wanted ones; never false for one that is.

    A bitmap of fixed size (2 MB) tells, so that rows surely not wanted need no shuffle.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")
    block, word, bit = F.shiftright(place, 12), F.shiftright(place, 6).bitwiseAND(63), place.bitwiseAND(63)
    marks = wanted.select(
        block.alias("_block"),
        word.alias("_word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"),
    )
    words = marks.groupBy("_block", "_word").agg(F.bit_or("_bit").alias("_bits"))
    numbers = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    blocks = words.groupBy("_block").agg(numbers.alias("_map"))  # at most 4,096 rows of 64 numbers
    met = rows.withColumns({"_b": block, "_w": word, "_p": bit}).join(
        F.broadcast(blocks), F.col("_b") == F.col("_block"), "left"
    )
    held = F.coalesce(F.element_at("_map", F.col("_w")), F.lit(0).cast("long"))
    return met.withColumn(flag, F.getbit(held, F.col("_p")) == 1).select(*rows.columns, flag)


def without(docs: DataFrame, gone: DataFrame, key: str, text: str, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose id and MD5 of the text are in ``gone`` (doc_id, text_key).

    Of rows that repeat an id and text listed in ``once``, one stays. Most rows are in neither, as
    a bitmap shows, and are not shuffled. Columns keep their names and order.
    """
    names = docs.columns
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    held = docs.withColumns({"__id": F.col(key).cast("long"), "__text": digest})
    held = held.withColumn("__row", F.concat_ws(":", F.coalesce(F.col("__id").cast("string"), F.lit("")), "__text"))
    marks = gone.select(F.col("doc_id"), "text_key", F.lit(True).alias("__gone"))
    if once is not None:
        marks = marks.unionByName(once.select("doc_id", "text_key", F.lit(False).alias("__gone")))
    marks = marks.select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key").alias("__row"), "__gone"
    ).distinct()
    split = likely(held, marks, "__row", "__likely")
    known = split.filter("__likely").join(marks, "__row", "left").filter("not coalesce(__gone, false)")
    single = known.filter("__gone is not null").dropDuplicates(["__row"])
    rest = [split.filter("not __likely"), known.filter("__gone is null")]
    return rest[0].select(names).unionByName(rest[1].select(names)).unionByName(single.select(names))
