import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retail_lake.llm import suffix_dedup
from retail_lake.llm.suffix_dedup import equal_windows, remove_repeats, suffix_array, unite


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text(alphabet="ab", max_size=80).map(str.encode)))
def test_suffix_array(raw):
    got = suffix_array(np.frombuffer(raw, np.uint8), len(raw) + 8)
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_equal_windows():
    raw = b"abcabcabcabd" * 20
    starts = np.arange(len(raw) - 10)
    number = equal_windows(np.frombuffer(raw, np.uint8), starts, 10)
    for i in starts:
        for j in starts:
            assert (number[i] == number[j]) == (raw[i : i + 10] == raw[j : j + 10])


def test_unite():
    low, high = unite(np.array([5, 0, 3, 20]), np.array([8, 3, 6, 21]))
    assert list(zip(low.tolist(), high.tolist())) == [(0, 8), (20, 21)]


def brute(rows, length=50):
    first = {}
    order = lambda d: float("inf") if d is None else d
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            first[key] = min(first.get(key, float("inf")), order(doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < order(doc):
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(20) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 30)) for _ in range(3)] + rng.sample(passages, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((rng.randint(0, 50), " ".join(parts)))
    base = text(200)
    rows += [(100 + i, base[: 300 + i] + word() + base[300 + i :]) for i in range(30)]
    rows += [(200, base), (200, base), (201, base), (None, base), (None, None), (202, ""), (203, "a" * 49), (204, "a" * 50), (205, "a" * 400)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rid string, hashes int")
    got = sorted((tuple(r) for r in remove_repeats(df, "doc_id", "text").collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    long = "".join(random.Random(1).choices("abcdefgh ", k=2_500_000))
    rows = spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_100] + "x")], schema)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(rows, "doc_id", "text").collect()}
    assert got == {1: 0, 2: 100}


def test_a_passage_of_half_of_all_texts_makes_no_large_group(spark):
    """Texts of one task are settled there: a bucket sees each pack's witnesses, not its texts."""
    rng = random.Random(7)
    passage = "".join(rng.choices("abcdefghij ", k=300))
    word = lambda n: "".join(rng.choices("klmnopqrst ", k=n))
    rows = [(i, word(80) + (passage if i % 2 else "") + word(40)) for i in range(2_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in remove_repeats(df, "doc_id", "text").collect()), key=str)
    assert got == brute(rows)

    texts = df.selectExpr("doc_id AS same", "doc_id AS rid", "doc_id AS doc", "text")
    lists = suffix_dedup._anchor_lists(texts, 50, 1).filter("bucket >= 0").collect()
    for hashes in Counter(h for r in lists for h in np.frombuffer(r["hashes"], np.uint64).tolist()).values():
        assert hashes <= 4 * suffix_dedup.SEVERAL
    shared = suffix_dedup._shared(suffix_dedup._anchor_lists(texts, 50, 1), 1)
    sent = suffix_dedup._stretches(texts.join(shared, "same"), 50, 1).filter("bucket >= 0").collect()
    number = sum(len(r["rids"]) // 8 for r in sent)
    settled = sum(len(r["rids"]) // 8 for r in suffix_dedup._stretches(texts.join(shared, "same"), 50, 1).filter("bucket < 0").collect())
    assert settled > number
