import hashlib
import random
import re

from retail_lake.llm import positional
from retail_lake.llm.positional import build_index, clean, contamination, matches, phrases

SCHEMA = "doc_id long, text string, row string, terms string"
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs away home."),
    (2, "Short item"),
    (3, "one"),
    (4, None),
    (5, "..."),
    (12, "Short item"),
    (None, "nameless item here"),
]


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items=ITEMS):
    out = []
    for doc, text, *_ in rows:
        words, hit, found = split(text), set(), set()
        for item, phrase in items:
            own = split(phrase)
            n = min(10, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(1)
    vocabulary = split(" ".join(t or "" for _, t in ITEMS)) + ["é", "other", "x1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80))), "r", "t") for i in range(40)]
    rows += [(100, "so: " + ITEMS[0][1].upper() + " The quick", "r", None), (100, ITEMS[0][1], "r", "t"), (101, None, "r", "t"), (102, "", "r", "t")]
    rows += [(None, "short-ITEM", "r", "t"), (103, "brown " * 5_000 + ITEMS[0][1], "r", "t"), (104, "quick brown fox jumps over the lazy dog and", "r", "t")]
    return rows


def test_against_all_windows(spark):
    rows = sample()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(spark.createDataFrame(rows, SCHEMA), items).drop("text_key")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_clean_keeps_the_rest(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = clean(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == df.columns
    bad = {(r[0], r[1]) for r in rows if brute([r])[0][5]}
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        (str(r[0]), r[1] or "") for r in rows if (r[0], r[1]) not in bad
    )


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(sample(), SCHEMA)
    assert contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert contamination(some, items).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha y z beta q gamma")], "doc_id long, text string")
    wanted = phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), "item_id", "text")
    words = phrases(spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "item_id long, text string"), "item_id", "text")
    index = build_index(docs, "doc_id", "text", words).cache()

    def found(slop):
        return {r["doc_id"] for r in matches(index, wanted, slop).join(index.select("row", "doc_id"), "row").collect()}

    assert found(0) == {2} and found(1) == {1, 2}


def test_phrases_longer_than_twelve_words_are_found(spark):
    words = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, words.replace("w14", "other"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, words)], "item_id long, text string")
    for window, second in ((13, 14), (15, 0)):
        got = positional.contamination(docs, items, window=window).select("doc_id", "n_hit").collect()
        assert sorted(map(tuple, got)) == [(1, 15), (2, second)]
