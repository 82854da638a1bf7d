"""Byte-level BPE of whole texts by overlapping chunks, and the way back to bytes.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, from its first
character, which may lie inside a pre-token. Two neighbouring chunks are stitched at the first place
in their overlap where a pre-token of both begins: the pattern looks only ahead, so from such a place
on both find the same pre-tokens, and by induction over the chunks all of them are those of the
whole text. Boundaries that text beyond a chunk's window could still move are not used. A text with
an overlap in which the chunks do not meet (one pre-token longer than the overlap) is pre-tokenised
whole. Then each distinct pre-token is merged by rank, once per worker.

A text that fits one window is one chunk without neighbours and is encoded where it is read. Chunks
of longer texts are dealt over all tasks; equal texts are encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import RANKS, keyed_texts
from retail_lake.session import freeze

CHUNK, OVERLAP = 65_536, 1_024  # characters
#: A match is decided by the text up to its end and one character more, at least by its first three.
LOOKAHEAD = 3
#: Distinct pre-tokens a worker remembers; beyond it, it starts anew.
PIECES_KEPT = 200_000
#: Characters of the longest pre-token that is remembered.
LONGEST_KEPT = 256
#: Characters of text handed on together.
BATCH_CHARS = 2_000_000

_CHUNKS = "text_key binary, chunk long, begin long, stop boolean, text string"


@cache
def _table(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


@cache
def _patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The pattern, one for characters that newer Unicode tables class otherwise, and one that finds those.

    The library's own tables decide what is a letter or a number: a pattern of one class, with bytes
    for a vocabulary, gives back the characters of the class out of all there are.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    exact, odd = public_tokenizers.PATTERN, []
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        only = tiktoken.Encoding(
            "class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
        )
        theirs, ours = set(only.decode(only.encode_ordinary(every))), set(regex.findall(name, every))
        if theirs != ours:
            more, fewer = _ranges(theirs - ours), _ranges(ours - theirs)
            odd += [more, fewer]
            exact = exact.replace(name, f"[[{name}{more}]--[{fewer}]]" if fewer else f"[{name}{more}]")
    exact = regex.compile(exact, regex.V1)
    if not odd:
        return exact, exact, regex.compile("(?!)")
    return regex.compile(public_tokenizers.PATTERN), exact, regex.compile(f"[{''.join(odd)}]")


def _ranges(characters: set[str]) -> str:
    """The inside of a character class."""
    found: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if found and code == found[-1][1] + 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in found)


def pattern(text: str) -> regex.Pattern:
    """What cuts this text into pre-tokens, the same for any part of it."""
    plain, exact, odd = _patterns()
    return plain if text.isascii() or not odd.search(text) else exact


class Pieces(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit numbers, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        ranks, _ = _table(path)
        self.merge = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece), dtype="<u4").tobytes()  # one match of the pattern stays one
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), dtype="<u4")


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _texts(column: pa.Array) -> list[str]:
    """Texts as Python strings; a null is empty, bytes that are no UTF-8 become U+FFFD."""
    return [(raw or b"").decode(errors="replace") for raw in column.cast(pa.large_binary()).to_pylist()]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([*parts, np.zeros(0, dtype="<u4")]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about BATCH_CHARS bytes together, or are one text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum([len(v) if v else 0 for v in (s.as_buffer() for s in column)])
        first = 0
        while first < batch.num_rows:
            upto = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, upto + BATCH_CHARS, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _whole(ranks: str, text: str, keep: list[str]) -> Callable:
    """Encode the column ``text`` of each row at once; the columns in ``keep`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks)
        for part in _slices(batches, text):
            table = pa.Table.from_batches([part])
            found = [pieces.ids(pattern(t).findall(t)) for t in _texts(table[text].combine_chunks())]
            columns = [table[c].combine_chunks() for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, _lists(found)], [*keep, "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable:
    """(text_key, text) to the windows of the text: ``chunk`` characters and the overlap with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (text,) = _texts(pa.array([text.as_buffer() and text.as_buffer().to_pybytes()], pa.binary()))
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                for number in range(last + 1):
                    begin = number * chunk
                    window = text[begin:] if number == last else text[begin : begin + chunk + overlap]
                    columns = [[key], [number], [begin], [number == last], [window]]
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["text_key", "chunk", "begin", "stop", "text"])

    return run


def _pre_tokenise(chunk: int, overlap: int) -> Callable:
    """Add to each chunk the ends of its pre-tokens, and the boundaries in both of its overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, begin = row["text"], row["begin"]
                ends = np.fromiter((m.end() for m in pattern(text).finditer(text)), dtype=np.uint32)
                sure = len(text) if row["stop"] else len(text) - LOOKAHEAD - 1
                starts = np.concatenate([[0], ends[ends <= sure]]).astype(np.int64)
                head = begin + starts[starts < overlap]
                tail = begin + starts[starts >= chunk] if not row["stop"] else []
                columns = [[row[c]] for c in ("text_key", "chunk", "begin", "stop", "text")]
                columns += [[ends.tobytes()], [list(head)], [list(tail)]]
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
                kinds += [pa.list_(pa.int64())] * 2
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                names = ["text_key", "chunk", "begin", "stop", "text", "ends", "head", "tail"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _encode_pieces(ranks: str) -> Callable:
    """Encode the pre-tokens of a chunk from ``first`` up to ``last``, places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks)
        for batch in batches:
            for row in batch.to_pylist():
                text, begin = row["text"], row["begin"]
                ends = np.frombuffer(row["ends"], dtype=np.uint32)
                first, last = row["first"] - begin, len(text) if row["stop"] else row["last"] - begin
                cuts = [first, *ends[(ends > first) & (ends <= last)].tolist()]
                ids = pieces.ids([text[a:b] for a, b in zip(cuts, cuts[1:])])
                arrays = [pa.array([row["text_key"]], pa.binary()), pa.array([row["chunk"]], pa.int64()), _lists([ids])]
                yield pa.RecordBatch.from_arrays(arrays, ["text_key", "chunk", "ids"])

    return run


def _stitched(texts: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """(text_key, text) with distinct keys to (text_key, ids)."""
    windows = texts.mapInArrow(_cut(chunk, overlap), _CHUNKS).repartition("text_key", "chunk")
    cut = freeze(
        windows.mapInArrow(
            _pre_tokenise(chunk, overlap), f"{_CHUNKS}, ends binary, head array<long>, tail array<long>"
        )
    )
    tails = cut.select("text_key", (F.col("chunk") + 1).alias("chunk"), "tail").filter("size(tail) > 0")
    meets = freeze(
        cut.select("text_key", "chunk", "head")
        .join(tails, ["text_key", "chunk"], "left")
        .select(
            "text_key",
            "chunk",
            F.when(F.col("chunk") == 0, F.lit(0).cast("long"))
            .otherwise(F.array_min(F.array_intersect("head", "tail")))
            .alias("first"),
        )
    )
    apart = freeze(meets.filter("first is null").select("text_key").distinct())
    later = meets.select("text_key", (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("last"))
    bounds = meets.join(apart, "text_key", "left_anti").join(later, ["text_key", "chunk"], "left")
    held = cut.select("text_key", "chunk", "begin", "stop", "text", "ends").join(bounds, ["text_key", "chunk"])
    parts = held.mapInArrow(_encode_pieces(ranks), "text_key binary, chunk long, ids array<int>")
    # texts whose chunks do not meet, put together again
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "stop", "text")))
    own = F.transform("pieces", lambda p: F.when(p["stop"], p["text"]).otherwise(F.substring(p["text"], 1, chunk)))
    rest = (
        cut.join(apart, "text_key", "left_semi")
        .groupBy("text_key")
        .agg(pieces.alias("pieces"))
        .select("text_key", F.lit(0).cast("long").alias("chunk"), F.array_join(own, "").alias("text"))
        .mapInArrow(_whole(ranks, "text", ["text_key", "chunk"]), "text_key binary, chunk long, ids array<int>")
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return (
        parts.unionByName(rest)
        .groupBy("text_key")
        .agg(ordered.alias("parts"))
        .select("text_key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    )


def encode(
    docs: DataFrame, key: str, text: str, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, ids) for every row: the ids of the whole text, without special tokens.

    A null or empty text has no ids, a null key stays null, repeated rows give a row each, and other
    columns are not looked at. Bytes that are no UTF-8 count as U+FFFD. A text of any length is
    encoded whole; a task holds its ids, or, if its chunks do not meet, the text, but not others with it.
    """
    if not 0 < LOOKAHEAD + 1 < overlap <= chunk:
        raise ValueError("the overlap must be longer than the lookahead and not longer than a chunk")
    rows = keyed_texts(docs, key, text)
    fits = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk + overlap
    short = rows.filter(fits).mapInArrow(_whole(ranks, "text", ["doc_id"]), "doc_id long, ids array<int>")
    long = rows.filter(~fits).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    distinct = long.groupBy("text_key").agg(F.first("text").alias("text"))
    found = _stitched(distinct, ranks, chunk, overlap)
    return short.unionByName(long.drop("text").join(found, "text_key").select("doc_id", "ids"))


def decode(encoded: DataFrame, ids: str = "ids", ranks: str = RANKS, name: str = "bytes") -> DataFrame:
    """Add the raw bytes of each row's tokens, one after another; null for null.

    They need not be UTF-8, since an id may stand for part of a character. An id outside the
    vocabulary is an error.
    """
    kept = [c for c in encoded.columns if c != name]
    schema = encoded.select(*kept).schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = _table(ranks)
        get = tokens.__getitem__
        for batch in batches:
            # one row at a time: its ids as Python numbers take ten times the room
            lists = batch.column(batch.schema.get_field_index(ids))
            raw = [b"".join(map(get, row.values.to_numpy().tolist())) if row.is_valid else None for row in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*kept, name])

    return encoded.select(*kept).mapInArrow(run, schema)
