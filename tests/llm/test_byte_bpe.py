"""Encoding against the public library, with chunks of a few characters, and the way back."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from retail_lake.llm import byte_bpe
from retail_lake.llm.common import RANKS


@pytest.fixture(scope="module")
def library():
    ranks, _ = byte_bpe._table(RANKS)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def odd_texts(n, seed=7):
    draw = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'re", "'", "s", "12", "é", "日本", "　", "!?", "<|endoftext|>", "\U0001f600", "x" * 40, "\x1c"]
    return ["".join(draw.choices(bits, k=draw.randint(0, 120))) for _ in range(n)]


def test_pieces_as_the_library(library):
    pieces, (_, tokens) = byte_bpe.pieces_of(RANKS), byte_bpe._table(RANKS)
    for text in [*odd_texts(200), "ab" * 5_000, "\0" * 300, "zqxj" * 77]:
        ids = pieces.ids(byte_bpe.pattern(text).findall(text)).tolist()
        assert ids == library(text)
        assert b"".join(tokens[i] for i in ids) == text.encode()


def test_every_character_is_split_as_the_library_does(library):
    pieces = byte_bpe.pieces_of(RANKS)
    for first in range(0, 0x110000, 64):
        text = "".join(f"a{c}1{c}{c}a {c}'s " for c in map(chr, range(first, first + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert pieces.ids(byte_bpe.pattern(text).findall(text)).tolist() == library(text)


@pytest.mark.parametrize("chunk, overlap", [(16, 8), (40, 24), (65_536, 1_024)])
def test_chunks_of_any_size_give_the_ids_of_the_whole_text(spark, library, chunk, overlap):
    texts = [*odd_texts(60), None, "", "y" * 500, " " * 90, "it's " * 60 + "we're", "a\n\n\nb " * 50]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (3, texts[3], "x"), (900, texts[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(docs, "doc_id", "text", RANKS, chunk, overlap)).collect()
    want = sorted((str(i), library(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in out) == want


def test_long_text_and_empty_table(spark, library):
    draw = random.Random(1)
    words = ["alpha", "beta ", " gamma", "\n\n", " 42", "'ll", "…", " naïve"]
    text = "".join(draw.choices(words, k=90_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    out = byte_bpe.encode(docs, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in out) == [1, 2]
    assert out[0].ids == out[1].ids == library(text)
    assert byte_bpe.encode(docs.limit(0), "doc_id", "text").collect() == []


def test_query(spark, library):
    from retail_lake.llm.queries import all_queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = all_queries()["op11_byte_bpe"](spark, folder).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
