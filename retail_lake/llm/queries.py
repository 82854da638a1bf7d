"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.llm import byte_bpe, conversations, cross_polytope, licences, merkle, packing, positional, quality, secret_scan, sql, suffix_dedup, token_groups, token_output, warc
from retail_lake.llm.common import RANKS, VOCABULARY, lower_ascii, read_table
from retail_lake.session import configure


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages")).drop("payload", "url")


def op2_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY, RANKS)
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_matrix(read_table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY, RANKS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_groups.near_groups(docs, "doc_id", "text", k=3, t=90).drop("text_key", "group_id")


def op9_licence_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source/lang/part/; one that speaks of a licence is a licence file."""
    docs = read_table(spark, sf_dir, "documents")
    states = F.col("text").rlike("(?i)licen[sc]e")
    name = F.concat(F.when(states, F.lit("LICENSE-")).otherwise(F.lit("text-")), F.col("doc_id"))
    folder = F.concat(F.lit("part"), F.floor(F.col("doc_id") / 1_000))
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", folder, name).alias("path"), "text")
    return licences.licences(files, "path", "text", "doc_id")


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.drop("text_key")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", RANKS)
    return byte_bpe.decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by a checksum of its id claims a text in lower case, and its proof must tell."""
    docs = read_table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars"]
    other = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(
        "doc_id",
        "lang",
        merkle.row_digest([F.col(c) for c in (*names, "text")]).alias("leaf"),
        F.when(other, merkle.row_digest([*map(F.col, names), lower_ascii(F.col("text"))])).alias("claim"),
    )
    root = merkle.folded("claimed")
    return (
        merkle.manifest(rows, "doc_id", "lang", "leaf", {"claim": "claim"})
        .withColumn("claimed", F.coalesce("claim", "leaf"))
        .select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), root.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(read_table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, "conv_id", "turn", "role", "text", "copy")


QUERIES = [
    op1_warc_capture_index,
    op2_differencing_packing,
    op3_cross_polytope,
    op4_token_matrix,
    op5_quality_classifier,
    op6_secret_field,
    op7_suffix_dedup,
    op8_token_group_join,
    op9_licence_tfidf,
    op10_positional_decontamination,
    op11_byte_bpe,
    op12_merkle_manifest,
    op13_conversation_repair,
]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, sf_dir: query(configure(spark), sf_dir)

    return {query.__name__: bind(query) for query in QUERIES}


def all_sql() -> dict[str, str]:
    return dict(sql.ALL)
