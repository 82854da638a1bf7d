import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retail_lake.llm.common import RANKS, VOCABULARY
from retail_lake.llm.packing import divide, pack, windows
from retail_lake.llm.token_output import RoomTree, best_fit, pack_matrix, positions
from retail_lake.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, text string, ids string, offset int, start string"
TEXTS = [
    (1, "one two three", "x", 1, "y"),
    (2, None, "x", None, None),
    (3, "", None, 1, "y"),
    (None, "no id", "x", 1, "y"),
    (1, "one two three", "x", 1, "y"),
    (4, "word\n\n  word " * 3_000, "x", 1, "y"),
]


def reference(text):
    tool = encoder(VOCABULARY, RANKS).whole
    return tool.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_equals_tokenizers(texts):
    got = encoder(VOCABULARY, RANKS).encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [reference(t) for t in texts]


def test_encoder_on_white_space_and_special_tokens():
    texts = ["a  b", " a", "a ", "a \n b", "a　 b", "x <|endoftext|> y", "é ü", "z" * 9_000, "", None, "'s 12ab"]
    got = encoder(VOCABULARY, RANKS).encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [reference(t) for t in texts]


def test_the_whole_vocabulary_is_loaded_once_a_text_needs_it():
    tool = Encoder(VOCABULARY, RANKS)
    assert tool.special == [t.content.encode() for t in encoder(VOCABULARY, RANKS).whole.get_added_tokens_decoder().values()]
    for text, loaded in (("plain words", False), ("a  b", False), ("x <|endoftext|> y", True)):
        assert tool.encode(pa.array([text]))[0].tolist() == reference(text)
        assert ("whole" in vars(tool)) == loaded


def test_divide_is_nearly_even():
    sizes = np.array(random.Random(1).choices(range(1, 257), k=400))
    part, sums = divide(sizes, 20)
    assert np.array_equal(np.bincount(part, sizes, minlength=20).astype(int), sums)
    assert sums.max() - sums.min() <= 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_windows_hold_everything_within_capacity(sizes):
    part = windows(np.array(sizes, dtype=np.int64), 50)
    fill = np.bincount(part, sizes, minlength=1) if sizes else np.zeros(1)
    assert len(part) == len(sizes) and fill.max() <= 50


def test_pack_gives_every_id_once(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    rows = pack(df, "doc_id", "text", VOCABULARY, RANKS, window=64, piece=16, batch_windows=8).collect()
    fills, parts = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    expected = {}
    for doc, text, *_ in TEXTS:
        expected.setdefault((doc, len(reference(text)) + 1), []).append(text)
    assert set(parts) == set(expected)
    for key, own in parts.items():
        once = {start: ids for start, ids in own}
        assert len(own) == len(once) * len(expected[key])
        ids = np.frombuffer(b"".join(ids for _, ids in sorted(once.items())), "<u4").tolist()
        assert ids == [*reference(expected[key][0]), 1]


def test_packing_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty, "doc_id", "text", VOCABULARY, RANKS).count() == 0
    assert pack_matrix(empty, "doc_id", "text", VOCABULARY, RANKS).count() == 0


def test_room_tree_finds_the_least_room():
    rng = random.Random(2)
    tree, rooms = RoomTree(100), []
    for _ in range(500):
        if rooms and rng.random() < 0.4:
            room = rooms.pop(rng.randrange(len(rooms)))
            tree.add(room, -1)
        else:
            rooms.append(rng.randint(1, 100))
            tree.add(rooms[-1], 1)
        size = rng.randint(1, 100)
        assert tree.least(size) == min((r for r in rooms if r >= size), default=-1)


def test_best_fit_places_every_piece():
    sizes = random.Random(3).choices(range(1, 65), k=300)
    rows = best_fit(sizes, 64)
    assert sorted(i for row in rows for i in row) == list(range(300))
    assert max(sum(sizes[i] for i in row) for row in rows) <= 64
    assert len(rows) <= 1.1 * sum(sizes) / 64 + 1


def test_matrix_round_trip(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    rows = pack_matrix(df, "doc_id", "text", VOCABULARY, RANKS, window=64).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        cuts = r["cu_seqlens"]
        assert len(ids) == 64 and r["length"] == cuts[-1] and not ids[cuts[-1] :].any()
        assert r["position_resets"] == cuts[:-1]
        where = positions(cuts, 64)
        assert all(where[c] == 0 for c in cuts[:-1])
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], cuts, cuts[1:]):
            parts.setdefault((doc, start), []).append(ids[a:b].tolist())
    whole = [*reference(TEXTS[5][1]), 1]
    got = [x for (doc, _), own in sorted(parts.items(), key=lambda p: (p[0][0] or 0, p[0][1])) if doc == 4 for x in own[0]]
    assert got == whole
    assert parts[(1, 0)] == [[*reference("one two three"), 1]] * 2
    assert parts[(2, 0)] == parts[(3, 0)] == [[1]]


def test_crc_of_little_endian_ids(spark):
    import zlib

    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    row = pack(df, "doc_id", "text", VOCABULARY, RANKS).select("length", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(np.array([*reference("one two"), 1], "<u4").tobytes())


def test_working_memory_is_that_of_a_slice():
    """A worker keeps what it once held, so a pipeline of stages adds up what their slices take."""
    import tracemalloc

    import pyarrow as pa

    from retail_lake.llm.common import RANKS, VOCABULARY
    from retail_lake.llm.tokens import Encoder, encoder

    texts, known = pa.array([("some words of text " * 1_000)] * 210), encoder(VOCABULARY, RANKS)
    known.encode(texts.slice(0, 1))
    tracemalloc.start()
    known.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 << 20
