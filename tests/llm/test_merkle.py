"""The tree against one built by plain lists, and changed rows found by their proofs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from retail_lake.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(nodes):
    """The root and, for each node, (left, right) per level."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j in range(len(run)):
                for i in under[a + j]:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_under.append([i for j in range(len(run)) for i in under[a + j]])
        nodes, under = up, up_under
    return nodes[0], ways


def expected(rows):
    """rows: (key, group, leaf) -> sorted (key, group, leaf, subroot, root, way)"""
    low = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for k, g, leaf in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), low(r[0]), r[2])):
        groups.setdefault(g, []).append((k, leaf))
    trees = {g: plain([leaf for _, leaf in members]) for g, members in groups.items()}
    root, lasts = plain([t[0] for t in trees.values()])
    out = []
    for (g, members), last in zip(groups.items(), lasts):
        subroot, ways = trees[g]
        out += [(k, g, leaf, subroot, root, way + last) for (k, leaf), way in zip(members, ways)]
    return out


@pytest.mark.parametrize("sizes", [[1], [1, 1, 8], [513, 2, 64], [4_097, 512, 9], [1] * 20])
def test_tree_against_plain_lists(spark, sizes):
    draw = random.Random(3)
    rows = []
    for g, n in enumerate(sizes):
        name = None if g == 1 else f"é{g}" if g % 2 else f"z{g}"
        rows += [(draw.randint(0, n * 3) if draw.random() > 0.01 else None, name, sha(f"{g}.{i // 2}")) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, part string, leaf string").withColumn("way", F.lit("own column"))
    got = merkle.manifest(df, "id", "part", "leaf").collect()
    key = lambda r: tuple(map(str, r))
    have = sorted(((r.id, r.part, r.leaf, r.subroot, r.root, [tuple(s) for s in r.way]) for r in got), key=key)
    assert have == sorted(expected(rows), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, part string, leaf string")
    assert merkle.manifest(df, "id", "part", "leaf").collect() == []


def test_leaf_of_a_row(spark):
    df = spark.createDataFrame([(7, None, "é"), (None, "", "x" * 100_000)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.row_digest([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [sha("1:7-2:é"), sha("-0:100000:" + "x" * 100_000)]


def test_changed_rows_do_not_fold_to_the_root(spark):
    rows = [(i, str(i % 3), sha(str(i)), sha(str(i) + "!" * (i % 5 == 0))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, part string, leaf string, now string")
    out = merkle.manifest(df, "id", "part", "leaf", {"now": "now"})
    got = out.select("id", (merkle.folded("now") == F.col("root")).alias("same"), merkle.folded("leaf").alias("r"), "root").collect()
    assert len(got) == 700
    assert all(r.same == (r.id % 5 != 0) and r.r == r.root for r in got)
