"""Benchmark decontamination by a distributed positional inverted index.

The index keeps, for the terms of the test set, where they stand in the training texts. Phrases
are found by intersecting posting lists shifted by each term's offset in the phrase, from the
rarest term on, so common terms are only looked up where rarer ones already meet.

Only words that can belong to a phrase are stored: a phrase of L words needs L words of its
length's vocabulary in a row. The vocabularies travel as bitmaps of fixed size, one per phrase
length; a wrong bit only stores a word too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import without
from retail_lake.llm.memory import lean
from retail_lake.llm.words import ALNUM, find, slices
from retail_lake.session import freeze

WINDOW = 10
#: Bits of a vocabulary bitmap; 512 KB for each of at most WINDOW phrase lengths.
BITS = 22
#: Bytes of text looked at together, in place of the usual slice: half of its working memory.
PART = 1_000_000


def phrases(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item_id, words): every run of ``window`` words of an item, or all words of a shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cut = [], []
            for i, values in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                found = find(pa.array([values], pa.large_binary()), ALNUM)
                terms = [found.word(j) for j in range(len(found.starts))]
                for j in range(max(1, len(terms) - window + 1) if terms else 0):
                    keys.append(batch.column(0)[i].as_py())
                    cut.append(terms[j : j + window])
            columns = [pa.array(keys, pa.int64()), pa.array(cut, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "words"])

    chosen = items.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return chosen.mapInArrow(run, "item_id long, words array<string>")


def _vocabularies(wanted: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Phrase length -> which hashes its words have; as large whatever the test set holds."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                seen = maps.setdefault(len(terms), np.zeros(1 << bits, dtype=bool))
                seen[_hash_words(terms, bits)] = True
        columns = [
            pa.array(list(maps), pa.int32()),
            pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["n", "map"])

    def unite(table: pa.Table) -> pa.Table:
        joint = None
        for raw in table.column("map").to_pylist():
            one = np.frombuffer(raw, dtype=np.uint8)
            joint = one if joint is None else joint | one
        return pa.table({"n": table.column("n").slice(0, 1), "map": pa.array([joint.tobytes()], pa.binary())})

    schema = "n int, map binary"
    parts = wanted.select("words").mapInArrow(mark, schema)
    rows = parts.groupBy("n").applyInArrow(unite, schema).collect()  # at most WINDOW rows
    return {r["n"]: np.unpackbits(np.frombuffer(r["map"], dtype=np.uint8)).astype(bool) for r in rows}


def _hash_words(terms: list[str], bits: int) -> np.ndarray:
    found = find(pa.array([t.encode() for t in terms], pa.large_binary()), ALNUM)
    return (found.hashes() >> np.uint64(64 - bits)).astype(np.int64)


def _in_runs(member: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Members that stand in a row of at least ``least`` members within one text."""
    edge = member.copy()
    edge[1:] &= member[:-1]
    begins = np.zeros(len(member), dtype=bool)
    begins[bounds[bounds < len(member)]] = True
    starts = np.flatnonzero(member & (~edge | begins))
    if not len(starts):
        return member
    group = np.cumsum(member & (~edge | begins)) - 1
    sizes = np.bincount(group[member], minlength=len(starts))
    return member & (sizes[np.maximum(group, 0)] >= least)


def build_index(docs: DataFrame, key: str, text: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per text: ``row`` (unique), ``doc_id``, ``n_words``, and terms with positions."""
    vocabularies = _vocabularies(wanted, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        for batch in batches:
            done = 0
            for values in slices(batch.column(1), PART):
                found = find(values, ALNUM)
                spots = (found.hashes() >> np.uint64(64 - bits)).astype(np.int64)
                keep = np.zeros(len(spots), dtype=bool)
                for n, seen in vocabularies.items():
                    keep |= _in_runs(seen[spots], found.first, n)
                chosen = np.flatnonzero(keep)
                cuts = np.searchsorted(chosen, found.first)
                offsets = pa.array(cuts, pa.int32())
                terms = pa.array([found.word(i) for i in chosen.tolist()], pa.string())
                owner = np.searchsorted(found.first, chosen, side="right") - 1
                places = pa.array(chosen - found.first[owner], pa.int32())
                columns = [
                    pa.array(np.arange(serial, serial + len(values))),
                    batch.column(0).slice(done, len(values)),
                    batch.column(2).slice(done, len(values)),
                    pa.array(np.diff(found.first), pa.int64()),
                    pa.ListArray.from_arrays(offsets, terms),
                    pa.ListArray.from_arrays(offsets, places),
                ]
                serial += len(values)
                done += len(values)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_key", "n_words", "terms", "places"])

    value = F.col(text).cast("string")
    chosen = docs.select(F.col(key).cast("long"), value, F.md5(F.coalesce(value, F.lit(""))))
    schema = "row long, doc_id long, text_key string, n_words long, terms array<string>, places array<int>"
    return chosen.mapInArrow(lean(run), schema)


def postings(index: DataFrame) -> DataFrame:
    """(term, row, place)"""
    spots = index.filter(F.size("terms") > 0).select("row", F.explode(F.arrays_zip("terms", "places")).alias("s"))
    return spots.select(F.col("s.terms").alias("term"), "row", F.col("s.places").alias("place"))


def matches(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, words, row, start): where the phrases occur.

    ``slop`` 0 asks for the exact phrase. Otherwise every term may stand up to ``slop`` places
    from where the rarest term puts it; build the index with phrases of one word for that, since
    only then is every place of a term stored.
    """
    lists = postings(index)
    lengths = lists.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    distinct = wanted.select("words").distinct().withColumn("phrase", F.md5(F.concat_ws(" ", "words")))
    parts = distinct.select("phrase", "words", F.posexplode("words").alias("offset", "term"))
    ranked = (
        parts.join(lengths, "term")
        .groupBy("phrase", "words")
        .agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("ranked"))
        .filter(F.size("ranked") == F.size("words"))  # else a term occurs nowhere
    )
    ranked = freeze(ranked)
    first = F.element_at("ranked", 1)
    starts = ranked.select(
        "phrase", first["term"].alias("term"), first["offset"].alias("offset")
    ).join(lists, "term").select("phrase", "row", (F.col("place") - F.col("offset")).alias("start"))
    second = ranked.filter(F.size("ranked") > 1).select(
        "phrase", F.element_at("ranked", 2)["term"].alias("t2"), F.element_at("ranked", 2)["offset"].alias("o2")
    )
    alone = ranked.filter(F.size("ranked") == 1).select("phrase")
    spots = lists.select(F.col("term").alias("t"), F.col("row").alias("r"), F.col("place").alias("p"))

    def meets(offset) -> F.Column:
        at = F.col("start") + F.col(offset)
        return F.col("p") == at if not slop else F.col("p").between(at - slop, at + slop)

    both = (
        starts.join(second, "phrase")
        .join(spots, (F.col("row") == F.col("r")) & (F.col("t2") == F.col("t")) & meets("o2"), "left_semi")
        .select("phrase", "row", "start")
    )
    rest = ranked.filter(F.size("ranked") > 2).select(
        "phrase", F.explode(F.slice("ranked", 3, F.size("ranked"))).alias("x"), (F.size("ranked") - 2).alias("needed")
    ).select("phrase", F.col("x.term").alias("tx"), F.col("x.offset").alias("ox"), "needed")
    whole = (
        both.join(rest, "phrase")
        .join(spots, (F.col("row") == F.col("r")) & (F.col("tx") == F.col("t")) & meets("ox"), "left_semi")
        .groupBy("phrase", "row", "start", "needed")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = needed")
        .select("phrase", "row", "start")
    )
    pairs = both.join(ranked.filter(F.size("ranked") == 2).select("phrase"), "phrase", "left_semi")
    found = starts.join(alone, "phrase", "left_semi").unionByName(pairs).unionByName(whole)
    return found.join(ranked.select("phrase", "words"), "phrase")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if an occurrence of a phrase of any item covers it. Null and empty texts have
    no words; items without words have no phrase; null ids stay null, and a phrase of an item
    without id counts no item. Repeated rows give a row each, empty tables give none or no hits.
    """
    wanted = freeze(phrases(items, item, item_text, window))
    index = freeze(build_index(docs, key, text, wanted))
    found = freeze(matches(index, wanted).select("phrase", F.size("words").alias("n"), "row", "start"))
    hit = (
        found.groupBy("row", "start")
        .agg(F.max("n").alias("n"))
        .select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
        .distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    owners = wanted.select(F.md5(F.concat_ws(" ", "words")).alias("phrase"), "item_id").distinct()
    # at most one entry per item: bounded by the test set
    named = (
        found.select("row", "phrase")
        .distinct()
        .join(owners, "phrase")
        .filter("item_id is not null")
        .select("row", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        index.select("row", "doc_id", "text_key", "n_words")
        .join(hit, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a phrase of an item occurs."""
    found = contamination(docs, items, key, text)
    return without(docs, freeze(found.filter("contaminated").select("doc_id", "text_key").distinct()), key, text)
