import random
import tracemalloc

import numpy as np

from retail_lake.llm import secret_scan as s
from tests.llm.planted_secrets import measure, planted

SCHEMA = "doc_id long, text string, n_chars long, spans string"


def hexed(rng, n):
    return "".join(rng.choices("0123456789abcdef", k=n))


def sample(n=300):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        own = rng.choices(words, k=40)
        if i % 5 == 0:
            own.insert(20, f"password={hexed(rng, 18)}")
        if i % 7 == 0:
            own.insert(10, f'token = "{hexed(rng, 40)}"')
        if i % 11 == 0:
            own.insert(5, "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOP234567", k=16)))
        if i % 3 == 0:
            own.insert(30, rng.choice(["call +1 (988) 555-2485", "at 42.144.35.254", "to a.42@mail8.example.com", "in 2024: yes"]))
        rows.append((i, " ".join(own), 1, "x"))
    return rows


def test_base_rules():
    text = 'PassWord: abcdef secret=abc token="x/y+z=-_." api-key=abcdef apikey = abcdefg AKIA' + "A" * 16 + " AKIAAAAA " + "ab12" * 6
    got = [(s.KINDS[k], text[a:b]) for a, k, b in s.base_spans(text)]
    assert got == [
        ("assign", "PassWord: abcdef"),
        ("assign", 'token="x/y+z=-_.'),
        ("assign", "apikey = abcdefg"),
        ("access", "AKIA" + "A" * 16),
        ("hex", "ab12" * 6),
    ]
    assert s.base_spans("paſſword=abcdef") == []


def learned(rows):
    examples = []
    for _, text, *_ in rows:
        known = s.values(text)
        for spans, features in s.stretches(text):
            tags = np.zeros(len(spans), dtype=np.int64)
            for a, b in known:
                own = [i for i, (x, y) in enumerate(spans) if x < b and a < y]
                tags[own], tags[own[:1]] = s.INSIDE, s.BEGIN
            examples.append((features, tags))
    return s.train(examples)


def test_field_finds_what_rules_miss_and_leaves_the_rest():
    field = learned(sample())
    rng = random.Random(7)
    missed = f"the password is now = {hexed(rng, 18)} and so on"
    assert not s.base_spans(missed)
    assert any(missed[a:b] == missed.split()[5] for a, b in s.field_spans(missed, field))
    for _, text, *_ in sample():
        assert all(k < 3 for _, k, _ in s.all_spans(text, field))


def test_parts_decode_like_the_whole():
    field = learned(sample())
    assert not field.whole
    rng = random.Random(3)
    for _, text, *_ in sample(60):
        words = text.split(" ")
        rng.shuffle(words)
        text = " ".join(words)
        parts = s.field_spans(text, field)
        field.whole = True
        assert s.field_spans(text, field) == parts
        field.whole = False


def test_scan_and_redact(spark):
    rows = sample()
    rows += [(900, None, None, "x"), (901, "", 0, "x"), (None, "secret=abcdefgh", 1, None), (0, rows[0][1], 1, "x"), (902, "word " * 50_000 + "secret=abcdefgh", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = s.scan(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append([(x["kind"], x["start"], x["stop"]) for x in r["spans"] if x["kind"] != "crf"])
    for doc, text, *_ in rows:
        assert [(s.KINDS[k], a, b) for a, k, b in s.base_spans(text or "")] in by_id[doc]
    clean = s.redact(df)
    assert clean.columns == df.columns
    texts = clean.collect()
    assert len(texts) == len(rows)
    for r in texts:
        assert r["text"] is None or not s.base_spans(r["text"])
        assert r["n_chars"] == (None if r["n_chars"] is None else len(r["text"]))
    assert s.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_secrets_to_learn_from(spark):
    df = spark.createDataFrame([(1, "plain words 12", 3, "x")], SCHEMA)
    assert s.learn(df, "doc_id", "text") is None and s.scan(df).first()["spans"] == []


def test_rare_secrets_and_long_stretches_are_learned(spark):
    """A secret outside of the sample, and one in a config of far more than 200 telling tokens."""
    lines = [f'"item{i}": {i},' for i in range(200)]
    config = "\n".join([*lines, '"password": "Zx81kQpl92",', *lines])
    for doc in (5, 6):
        rows = [(i, "plain words 12", 14, "x") for i in range(30) if i != doc] + [(doc, config, len(config), "x")]
        assert s.learn(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", sample=1) is not None
    tags = s.np.array([0] * 198 + [1] + [2] * 5 + [0] * 300)
    cut = s.parts_of(tags)
    assert cut[0] == (0, 198) and cut[1] == (198, 398) and cut[-1][1] == len(tags)


def test_planted_secrets_outside_the_rules(spark):
    """Planted forms in other surroundings: the rules find none of them, the field nearly all, and hardly anything else."""
    field = s.learn(spark.createDataFrame(sample(), SCHEMA), "doc_id", "text")
    assert not field.whole
    assert not any(s.base_spans(text) for text in [t for _, t, _ in planted(10)[0]] + planted(10)[1])
    recall, false, clean = measure(lambda text: [(a, b) for a, _, b in s.all_spans(text, field)], n=10)
    assert sum(recall.values()) / len(recall) >= 0.9 and min(recall.values()) >= 0.5
    assert len(false) <= 0.05 * clean


def test_uncovered_parts_of_a_field_span_stay(monkeypatch):
    text = 'token = "abcdef12" and AKIA' + "Z" * 16
    a, b = text.index("abcdef12"), text.index(" and")
    monkeypatch.setattr(s, "field_spans", lambda *_: [(a, b), (b + 1, len(text))])
    assert s.all_spans(text, s.Field(None, None)) == sorted([*s.base_spans(text), (b + 1, 3, text.index("AKIA"))])


def long_examples(n, tokens=200):
    rng = np.random.default_rng(3)
    features = rng.integers(0, s.N_FEATURES, (n, tokens, s.WIDTH), dtype=np.int32)
    tags = np.zeros((n, tokens), dtype=np.int64)
    tags[:, 10], tags[:, 11] = s.BEGIN, s.INSIDE
    return [(x[: 2 + i % tokens], y[: 2 + i % tokens]) for i, (x, y) in enumerate(zip(features, tags, strict=True))]


def test_training_holds_the_emissions_of_one_block_only():
    examples = long_examples(4_000)
    tracemalloc.start()
    try:
        s.train(examples, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 60e6  # all at once: 350 MB
    finally:
        tracemalloc.stop()


def test_blocks_do_not_change_what_is_learned(monkeypatch):
    examples = long_examples(60, 40)
    fields = []
    for together in (1, 150, 1 << 30):
        monkeypatch.setattr(s, "TOGETHER", together)
        fields.append(s.train(examples, rounds=20))
    for field in fields[1:]:
        assert np.allclose(field.weights, fields[0].weights, atol=1e-9) and np.allclose(field.moves, fields[0].moves, atol=1e-9)
