"""Jaccard self-join of word shingles with a token-group matrix.

Equal sets are one class. Similar classes form groups: a class follows the smallest class of
most of its leading tokens. The matrix holds, per token, the groups whose members have it
among their leading tokens; counting a class's tokens against it bounds its overlap with every
group at once, and only groups over the bound are opened. Opened groups are compared block by
block with parts of those that ask, first against the union of the block's tokens, then against its members.

Tokens of many classes are hot and left out wherever the others suffice, so chance meetings grow
with the rows, not with their square.

Exactness. Tokens are 64-bit hashes in one order: frequent tokens last, else by hash. With
alpha = ceil(t * n), two sets of similarity t or more share at least l of their first
n - alpha + l tokens (l at most alpha). The order only decides how much work is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import likely, settled, without
from retail_lake.llm.components import components
from retail_lake.llm.memory import lean
from retail_lake.llm.words import SPACED, Words, find, mix, slices
from retail_lake.session import freeze

#: Leading tokens that two similar sets must share.
SHARED = 8
#: Classes that share a token from which on it is hot.
HOT = 24
#: A token counts as frequent from this share of all texts on; at most so many are kept (2 MB).
FREQUENT, FREQUENT_KEPT = 1e-3, 1 << 18
#: Bytes of text whose sets are made together, in place of the usual slice: half of its working memory.
PART = 1_000_000
#: Shingles counted together by a task.
COUNTED = 4_000_000
#: Members of a group that one task compares at a time.
BLOCK = 512
#: Classes asking a group that one task compares with a block, and bytes of text on either side.
ASKED, BLOCK_BYTES = 4_096, 16 << 20
#: Further leaders of a group with more than BLOCK members that are not like its leader.
LEADERS = 4


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and where each text's begin; fewer than k words are one."""
    h = found.hashes()
    count = np.diff(found.first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begin[-1], dtype=np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(begin[-1]) - begin[:-1][owner] + found.first[:-1][owner]
    width = np.minimum(count, k)[owner]
    for j in range(k):
        more = j < width
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + j] + np.uint64(j))
    return out, begin


def token_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles of one text, in order."""
    return np.unique(shingles(find(pa.array([text], pa.large_binary()), SPACED), k)[0])


def frequent_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """Tokens found in many texts, sorted; at most FREQUENT_KEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keys, n = keys[n > 2], n[n > 2]
            keys, n = np.append(keys, np.uint64(0)), np.append(n, seen)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches:
            for values in slices(batch.column(0)):
                hashes, begin = shingles(find(values, SPACED), k)
                held += [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                size, seen = size + len(hashes), seen + len(values)
                if size >= COUNTED:
                    yield counted()
                    held, size, seen = [], 0, 0
        yield counted()

    counts = freeze(texts.select("text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    all_texts = counts.filter("token = 0").first()
    if all_texts is None:
        return np.zeros(0, dtype=np.uint64)
    least = max(3, int(FREQUENT * all_texts["n"]))
    top = counts.filter((F.col("token") != 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT)
    kept = top.select("token").toArrow().column(0).to_numpy()
    return np.sort(kept.view(np.uint64))


def leading(tokens: np.ndarray, frequent: np.ndarray, t: int) -> tuple[np.ndarray, int]:
    """The first tokens of a set and how many of them a similar set must share; t in percent."""
    n = len(tokens)
    alpha = -(-t * n // 100)
    need = min(SHARED, alpha)
    if len(frequent):
        near = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[near] == tokens
        tokens = np.concatenate([tokens[~common], tokens[common]])
    return tokens[: n - alpha + need], need


def token_sets(texts: DataFrame, k: int, t: int, frequent: np.ndarray) -> DataFrame:
    """One row per text: ``row`` (unique), ``n``, the set's digest, its leading tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        for batch in batches:
            done = 0
            for values in slices(batch.column(1), PART):
                hashes, begin = shingles(find(values, SPACED), k)
                sizes, keys, heads, needs = [], [], [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    own = np.unique(hashes[a:b])
                    head, need = leading(own, frequent, t)
                    sizes.append(len(own))
                    keys.append((mix(own).sum(), mix(own ^ np.uint64(0x5DEECE66D)).sum()))
                    heads.append(head.view(np.int64))
                    needs.append(need)
                key = np.array(keys, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in heads])]), pa.int32())
                columns = [
                    pa.array(np.arange(serial, serial + len(values))),
                    *(batch.column(c).slice(done, len(values)) for c in (0, 2, 3)),
                    pa.array(sizes, pa.int64()),
                    pa.array(key[:, 0]),
                    pa.array(key[:, 1]),
                    pa.array(needs, pa.int32()),
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]))),
                ]
                serial += len(values)
                done += len(values)
                names = ["row", "doc_id", "text_key", "bytes", "n", "key_a", "key_b", "need", "head"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "row long, doc_id long, text_key string, bytes long, n long, key_a long, key_b long, need int, head array<long>"
    return texts.select("doc_id", "text", "text_key", F.octet_length("text").cast("long")).mapInArrow(lean(run), schema)


def _similar(inter, n_a, n_b, t: int):
    return 100 * inter >= t * (n_a + n_b - inter)


def _open(queries: DataFrame, members: DataFrame, k: int, t: int) -> DataFrame:
    """Similar (query, member) pairs of a block, as many as joining the components needs."""

    def run(asking: pa.Table, block: pa.Table) -> pa.Table:
        a, b = [], []
        if asking.num_rows and block.num_rows:
            names = block.column("cls").to_pylist()
            sets = [token_set(x.encode(), k) for x in block.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            union, begin = np.unique(tokens, return_index=True)
            begin = np.append(begin, len(tokens))
            label = np.arange(len(sets))  # members joined so far have one label
            place = {name: i for i, name in enumerate(names)}
            for cls, text in zip(asking.column("q_cls").to_pylist(), asking.column("q_text").to_pylist(), strict=True):
                own = token_set(text.encode(), k)
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                at = at[union[at] == own]
                # no member is smaller than the smallest: the least overlap that can be enough
                if 100 * len(at) < t * (len(own) + sizes.min() - len(at)):
                    continue
                spans = [owner[begin[i] : begin[i + 1]] for i in at.tolist()]
                inter = np.bincount(np.concatenate(spans), minlength=len(sets))
                alike = np.flatnonzero(_similar(inter, len(own), sizes, t))
                met, example = np.unique(label[alike], return_index=True)
                itself = label[place[cls]] if cls in place else -1
                for i in alike[example[met != itself]].tolist():
                    a.append(cls)
                    b.append(names[i])
                label[np.isin(label, met)] = itself if itself >= 0 else met.min(initial=len(sets))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    asked = queries.groupBy("q_grp", "q_block", "q_salt")
    return asked.cogroup(members.groupBy("grp", "block", "salt")).applyInArrow(run, "a long, b long")


def _groups(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per class: its group, how many of its leading tokens are hot, and whether hot ones count.

    The group is the class that leads most of its tokens; with too few for similarity, itself.
    """
    votes = shared.groupBy("cls", "lead").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("cls").agg(F.max(F.struct("votes", -F.col("lead"))).alias("best"))
    own = shared.groupBy("cls").agg(F.count_if("hot").alias("hots")).join(sizes, "cls")
    led = F.when(F.col("best.votes") >= F.col("need"), -F.col("best.col2")).otherwise(F.col("cls"))
    whole = (F.col("hots") >= F.col("need")) | (F.col("n") <= 2 * SHARED)
    return own.join(best, "cls").select("cls", "n", "need", "bytes", "hots", whole.alias("whole"), led.alias("grp"))


def _over_the_bound(grouped: DataFrame, facts: DataFrame, t: int) -> DataFrame:
    """(cls, grp): the other groups whose tokens could hold enough of a class's.

    A token of a group counts only if some member that leads with it can be of similar size, so the
    matrix keeps the smallest and largest set per token and group. Similar sets share SHARED leading tokens. If fewer of a class's are hot, one that is not hot
    is among them: such a class asks by its other tokens, of which it must share SHARED less its
    hot ones. All others (and tiny sets) ask among themselves by all tokens.
    """

    def matrix(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token", F.col("grp").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))

    of_size = (F.col("hi") * 100 >= F.col("n") * t) & (F.col("lo") * t <= F.col("n") * 100)
    some = grouped.filter("not hot")
    plain = (
        some.filter("not whole")
        .join(matrix(some), "token")
        .filter(of_size & (F.col("grp") != F.col("other")))
        .groupBy("cls", "other")
        .agg(F.count(F.lit(1)).alias("bound"))
        .join(facts.select("cls", "need", "hots"), "cls")
        .filter("bound >= need - hots")
        .select("cls", "other")
    )
    all_ = grouped.filter("whole")
    needs = facts.filter("whole").groupBy("grp").agg(F.min("need").alias("least")).withColumnRenamed("grp", "other")
    whole = (
        all_.join(matrix(all_), "token")
        .filter(of_size & (F.col("other") < F.col("grp")))  # both sides would ask
        .groupBy("cls", "other")
        .agg(F.count(F.lit(1)).alias("bound"))
        .join(facts.select("cls", "need"), "cls")
        .join(needs, "other")
        .filter(F.col("bound") >= F.least("need", "least"))
        .select("cls", "other")
    )
    return plain.unionByName(whole).withColumnRenamed("other", "grp")


def similar_classes(docs: DataFrame, key: str, text: str, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their class, and the links between classes that join its components.

    Rows: row, doc_id, text_key, n, cls (null without words). Links: a, b.
    """
    texts = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_key", F.md5("text"))
    sets = freeze(token_sets(texts, k, t, frequent_tokens(texts, k)))
    first = sets.filter("n > 0").groupBy("key_a", "key_b").agg(F.min("row").alias("cls"))
    rows = settled(
        sets.select("row", "doc_id", "text_key", "n", "key_a", "key_b")
        .join(first, ["key_a", "key_b"], "left")
        .select("row", "doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    )
    # one shuffle by token serves the counts and the join with them
    heads = (
        sets.join(rows.filter("row = cls").select("row"), "row", "left_semi")
        .select(F.col("row").alias("cls"), F.explode("head").alias("token"))
        .repartition("token")
    )
    lead = heads.groupBy("token").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = heads.join(lead, "token")  # tokens of one class alone are gone
    shared = settled(shared.select("cls", "token", "lead", (F.col("df") > HOT).alias("hot")))
    facts = freeze(_groups(shared, sets.select(F.col("row").alias("cls"), "n", "need", "bytes")))
    grouped = freeze(
        shared.select("cls", "token", "hot").join(facts.select("cls", "n", "whole", "grp"), "cls")
    )
    foreign = settled(_over_the_bound(grouped, facts, t))
    group = facts.select("cls", "grp", "bytes")
    inside = group.filter("cls <> grp").select("cls", "grp")

    # texts of the classes that meet any other, with their place in a group
    needed = inside.select("cls").union(inside.select("grp")).union(foreign.select("cls")).union(
        group.join(foreign.select("grp").distinct(), "grp", "left_semi").select("cls")
    ).distinct()

    def parts(most: int) -> F.Column:
        return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(most), F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int")

    sizes = group.groupBy("grp").agg(parts(BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size"))
    place = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")
    placed = freeze(
        group.select("cls", "grp").join(needed, "cls", "left_semi").join(sizes, "grp").select("cls", "grp", "blocks", "size", place)
        .join(rows.filter("row = cls").select("cls", "text_key"), "cls")
    )
    distinct = likely(texts.select("text_key", "text"), placed, "text_key").filter("likely")
    distinct = distinct.groupBy("text_key").agg(F.first("text").alias("text"))
    members = settled(distinct.join(placed, "text_key").drop("text_key"))

    def asks(rows: DataFrame, salt: F.Column) -> DataFrame:
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block")
        return rows.select(
            F.col("grp").alias("q_grp"), block, salt.alias("q_salt"), F.col("cls").alias("q_cls"), F.col("text").alias("q_text")
        )

    # first the leaders ask their groups; then members not like their leader, and outsiders over
    # the bound, ask all of the group
    once = members.withColumn("salt", F.lit(0))
    led = settled(_open(asks(members.filter("cls = grp and size > 1"), F.lit(0)), once.filter("size > 1"), k, t))
    rest, more = _rest(inside, led, lambda leaders: settled(
        _open(
            asks(members.join(leaders.select("cls"), "cls", "left_semi"), F.lit(0)),
            once.join(leaders.select("grp"), "grp", "left_semi"),
            k,
            t,
        )
    ))
    asking = freeze(rest.unionByName(foreign))
    salts = asking.join(group.select("cls", "bytes"), "cls").groupBy("grp").agg(parts(ASKED).alias("salts")).filter("salts > 1")
    salts = freeze(salts)  # few: only groups that very many ask
    salted = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    # what is asked for is narrow until the texts join, so they are shuffled twice and no more
    queries = (
        asking.join(sizes.select("grp", "blocks"), "grp").join(salts, "grp", "left").join(members.select("cls", "text"), "cls")
    )
    part = F.pmod(F.xxhash64("cls"), F.coalesce("salts", F.lit(1))).cast("int")
    found = _open(asks(queries, part), members.join(salts, "grp", "left").withColumn("salt", salted), k, t)
    return rows, freeze(led.unionByName(more).unionByName(found))


def _rest(inside: DataFrame, led: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cls, grp): the members that must ask all of their group; and the links found on the way.

    A pair of one group is found if either side asks. Members that the leaders' links have joined
    to the largest part of their group need not ask, for any two of them are in one component. In
    groups with many others, more leaders are tried first, which ask all of the group.
    """
    apart = inside.join(led.select(F.col("b").alias("cls")), "cls", "left_anti")
    none = led.limit(0)
    crowded, links, leaders = None, none, None
    for _ in range(LEADERS):
        apart = freeze(apart)
        counted = apart.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min_by("cls", F.xxhash64("cls")).alias("cls"))
        chosen = freeze(counted.filter(F.col("n") > BLOCK).select("cls", "grp"))
        if chosen.isEmpty():
            break
        crowded = chosen.select("grp") if crowded is None else crowded
        found = ask(chosen)
        links = links.unionByName(found)
        leaders = chosen.select("cls") if leaders is None else leaders.union(chosen.select("cls"))
        apart = apart.join(found.select(F.col("b").alias("cls")).union(chosen.select("cls")).distinct(), "cls", "left_anti")
    if crowded is None:
        return apart, none
    first = led.join(crowded.withColumnRenamed("grp", "a"), "a", "left_semi")
    joined = components(first.unionByName(links)).withColumnRenamed("node", "cls")
    pool = inside.join(crowded, "grp", "left_semi").join(joined, "cls", "left").withColumn("part", F.coalesce("root", "cls"))
    pool = freeze(pool.select("cls", "grp", "part"))
    counts = pool.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    left = pool.join(largest, "grp").filter("part <> largest").join(leaders, "cls", "left_anti").select("cls", "grp")
    return apart.join(crowded, "grp", "left_anti").select("cls", "grp").unionByName(left), links


def near_groups(docs: DataFrame, key: str, text: str, k: int = 5, t: int = 80) -> DataFrame:
    """One row per document row: doc_id, text_key, n_shingles, component_id, group_id.

    Two sets link at a Jaccard similarity of ``t`` percent or more. The component is named by its
    smallest document id. Null and empty texts and those without words have no shingles and stand
    alone; fewer than k words are one shingle. Null ids stay null and name a component only if it
    has no other; repeated rows are copies of each other. Empty tables give no rows.
    """
    rows, links = similar_classes(docs, key, text, k, t)
    joined = rows.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").select(
        "row", "doc_id", "text_key", "n", F.coalesce("root", "cls", "row").alias("root")
    )
    named = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return joined.join(named, "root").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("root").alias("group_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest id, then text digest."""
    rows = freeze(near_groups(docs, key, text, k, t).withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")))
    grouped = rows.filter("n_shingles > 0")
    kept = grouped.groupBy("group_id").agg(F.min("order").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = grouped.join(kept, "group_id")
    gone = members.filter("order <> kept").select("doc_id", "text_key").distinct()
    once = members.filter("order = kept").select("doc_id", "text_key").distinct()
    return without(docs, gone, key, text, once)
