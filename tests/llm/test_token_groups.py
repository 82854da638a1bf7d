import random
import re

import pytest

from retail_lake.llm import token_groups
from retail_lake.llm.components import components
from retail_lake.llm.token_groups import keep_one, near_groups

SCHEMA = "doc_id long, text string, cls string, row string"


def brute(rows, k, t):
    sets = []
    for _, text, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
        for i in range(n)
    ]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for size in (3, 8, 25, 60, 120):
        for _ in range(4):
            base = rng.choices(words, k=size)
            for _ in range(rng.randint(1, 8)):
                copy = base[:]
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(size)] = rng.choice(words)
                rows.append((len(rows) + rng.randint(0, 1), " ".join(copy), "x", "y"))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (902, " \n ", "x", "y"), (903, "Two words", "x", "y"), (904, "two  WORDS", "x", "y")]
    rows += [(None, rows[3][1], "x", "y"), (905, rows[3][1], "x", None), (905, rows[3][1], "x", "y"), (906, "É é", "x", "y"), (907, "é É", "x", "y")]
    return rows


@pytest.mark.parametrize("k,t,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_all_pairs(spark, k, t, seed):
    rows = sample(seed)
    got = near_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", k, t)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, k, t)


def test_hot_tokens_and_blocks_lose_no_link(spark, monkeypatch):
    """One cluster in several blocks, whose tokens are all hot, beside texts with a hot passage."""
    monkeypatch.setattr(token_groups, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"a{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(12))
    rows = []
    for i in range(70):
        copy = base[:]
        copy[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(copy), "x", "y"))
    for i in range(60):
        own = " ".join(f"o{i}_{j}" for j in range(40))
        rows.append((100 + 2 * i, f"{own} {passage}", "x", "y"))
        if i % 3 == 0:
            rows.append((101 + 2 * i, f"{own} {passage} more", "x", "y"))
    got = near_groups(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 3, 90)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows, 3, 90)


def test_keep_one_of_each_group(spark):
    rows = [(i, text, "x", "y") for i, (_, text, *_) in enumerate(sample(4))]
    rows += rows[:5]  # repeated rows are copies too
    df = spark.createDataFrame(rows, SCHEMA)
    kept = keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    found = brute(rows, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in found})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_groups(empty, "doc_id", "text").count() == 0 and keep_one(empty).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges, root = [], {}
    for g, size in enumerate([2, 3, 50, 200]):
        nodes = [g * 1_000 + i for i in range(size)]
        rng.shuffle(nodes)
        edges += list(zip(nodes, nodes[1:]))
        root |= {n: g for n in nodes}
    edges += [(5_000, 5_000 + i) for i in range(1, 40)]
    root |= {5_000 + i: 9 for i in range(40)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"] for r in got} == set(root)
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(root[r["node"]])
    assert len(groups) == 5 and all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("leaders", [0, 4])
def test_group_unlike_its_leader_is_bounded(spark, monkeypatch, leaders):
    """Members alike but not like their leader: a task holds few askers, and links only span."""
    for name, value in (("BLOCK", 16), ("ASKED", 24), ("LEADERS", leaders)):
        monkeypatch.setattr(token_groups, name, value, raising=False)
    largest, asked, open_ = [], [], token_groups._open

    def watched(queries, *more):
        counts = queries.groupBy(*[c for c in queries.columns if c not in ("q_cls", "q_text")]).count()
        largest.append(counts.agg({"count": "max"}).first()[0] or 0)
        asked.append(queries.count())
        return open_(queries, *more)

    monkeypatch.setattr(token_groups, "_open", watched)
    rng = random.Random(11)
    base = [f"a{i}" for i in range(60)]
    first = base[:]
    first[10] = first[30] = first[50] = "other"
    rows = [(0, " ".join(first), "x", "y")]
    for i in range(1, 120):
        copy = base[:]
        copy[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(copy), "x", "y"))
    docs = spark.createDataFrame(rows, SCHEMA)
    _, links = token_groups.similar_classes(docs, "doc_id", "text", 3, 80)
    assert links.count() <= 8 * 5 * (16 + 24)  # a task's links only span; all pairs are 119 * 118
    assert max(largest) <= 2 * 24
    if leaders:
        assert sum(asked) < 120 * 8 / 2  # without more leaders all members ask all of eight blocks
    got = near_groups(docs, "doc_id", "text", 3, 80).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 3, 80)
