"""Merkle manifest of a table: a digest for each row, a tree for each group, one root, and proofs.

The leaves of a group are ordered by key; every eight consecutive nodes, the last run fewer, become
the digest of their concatenated digests, until one node is left, the subroot. The subroots, ordered
by group, make the root in the same way.

A level is not kept as rows. Leaves are dealt to aligned blocks of 512 (three levels), and a block
keeps each of its levels as one string of digests of 64 hexadecimal characters. Parents are hashes of
substrings of fixed width; the siblings of a node are what lies left and right of it in the substring
of its run. The tops of the blocks are the leaves of the next tree, built by the same step, so each
step has a 512th of the rows of the one before. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.operators.ranking import global_row_number
from retail_lake.session import freeze

FANOUT = 8
LEVELS = 3
BLOCK = FANOUT**LEVELS
HEX = 64
_RUN = FANOUT * HEX
_STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row: of each field its UTF-8 byte count, a colon and its text; null is ``-``."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / F.lit(_RUN)).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256)
    )
    return F.array_join(hashed, "")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (grp, pos, n, node) to blocks with their levels; a finished block has no further levels.

    A block of a group with more than one ends three levels up, the group's only block when one
    node is left.
    """
    held = F.array_sort(F.collect_list(F.struct("pos", "node", *carried)))
    rows = nodes.groupBy("grp", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).agg(
        F.first("n").alias("n"), held.alias("nodes")
    )
    out = rows.withColumn("level0", F.array_join(F.transform("nodes", lambda m: m["node"]), ""))
    for number in range(LEVELS):
        below = F.col(f"level{number}")
        goes_on = (F.col("n") > BLOCK) | (F.length(below) > HEX)
        out = out.withColumn(f"level{number + 1}", F.when(goes_on, _parents(below)))
    levels = [F.col(f"level{number}") for number in range(LEVELS, -1, -1)]
    return freeze(out.withColumn("top", F.coalesce(*levels)))


def _steps(pos: Column) -> Column:
    """The siblings left and right of a node of a block, for each level of the block."""
    steps = []
    for number in range(LEVELS):
        place = F.floor(pos / F.lit(FANOUT**number)).cast("int")
        run = F.substring(F.col(f"level{number}"), F.floor(place / F.lit(FANOUT)).cast("int") * _RUN + 1, F.lit(_RUN))
        at = (place % FANOUT) * HEX
        step = F.struct(
            F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + HEX + 1, F.lit(_RUN)).alias("right")
        )
        steps.append(F.when(F.col(f"level{number + 1}").isNotNull(), step))
    return F.array_compact(F.array(*steps)).cast(f"array<{_STEP}>")


def _upwards(blocks: DataFrame) -> DataFrame:
    """Add to each block the way from its top to the root of its group (``upper``) and that root."""
    if blocks.filter(F.col("n") > BLOCK).isEmpty():
        return blocks.withColumns({"upper": F.array().cast(f"array<{_STEP}>"), "top_root": F.col("top")})
    tops = blocks.select(
        "grp",
        F.col("block").alias("pos"),
        F.ceil(F.col("n") / F.lit(BLOCK)).alias("n"),
        F.col("top").alias("node"),
    )
    above = _nodes(_upwards(_blocks(tops)))
    ways = freeze(above.select("grp", F.col("pos").alias("block"), F.col("way").alias("upper"), F.col("root").alias("top_root")))
    return blocks.join(ways, ["grp", "block"])


def _nodes(blocks: DataFrame) -> DataFrame:
    """Blocks with their way upwards to their nodes (grp, pos, node, carried), each with its whole way and root."""
    first = F.col("block") * BLOCK
    single = blocks.withColumn("m", F.explode("nodes")).withColumn("_at", F.col("m.pos") - first)
    return single.select("grp", "m.*", F.concat(_steps(F.col("_at")), "upper").alias("way"), F.col("top_root").alias("root"))


def manifest(leaves: DataFrame, key: str, group: str, leaf: str, carried: Mapping[str, str] | None = None) -> DataFrame:
    """Per leaf: key, group, leaf, the carried columns, ``subroot``, ``root`` and ``way``.

    ``way`` holds for each level from the leaf to the root the digests left and right of the node on
    it. ``carried`` maps names of columns of ``leaves`` to those in the result. A group may be null and
    comes first then, as does a null key in its group; equal keys go by leaf, and repeated rows are
    leaves of their own. A group of one row has its leaf as subroot, a table without rows no leaf.
    """
    carried = carried or {}
    rows = freeze(
        leaves.select(
            F.col(key).alias("k"),
            F.col(group).alias("g"),
            F.col(leaf).alias("node"),
            *[F.col(old).alias(f"c_{new}") for old, new in carried.items()],
            F.monotonically_increasing_id().alias("spread"),  # lets equal rows be dealt to several tasks
        )
    )
    order = [F.col(c).asc_nulls_first() for c in ("g", "k", "node", "spread")]
    numbered = global_row_number(rows, order, "at").drop("spread")
    groups = freeze(numbered.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    groups = global_row_number(groups, [F.col("first").asc()], "grp", "groups")
    known = groups.withColumnRenamed("g", "own")
    placed = numbered.join(known, F.col("g").eqNullSafe(F.col("own"))).withColumn("pos", F.col("at") - F.col("first"))
    names = ["k", "g", *[f"c_{new}" for new in carried.values()]]
    trees = _upwards(_blocks(placed, *names))
    tops = trees.filter("block = 0").join(groups.select("grp", "groups"), "grp").select(
        F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.col("groups").alias("n"), F.col("top_root").alias("node")
    )
    over = freeze(_nodes(_upwards(_blocks(tops))).select(F.col("pos").alias("grp"), F.col("way").alias("last"), F.col("root").alias("all")))
    return _nodes(trees.join(over, "grp").withColumn("upper", F.concat("upper", "last")).withColumn(
        "nodes", F.transform("nodes", lambda m: m.withField("all", F.col("all")))
    )).select(
        F.col("k").alias(key),
        F.col("g").alias(group),
        F.col("node").alias(leaf),
        *[F.col(f"c_{new}").alias(new) for new in carried.values()],
        F.col("root").alias("subroot"),
        F.col("all").alias("root"),
        "way",
    )


def proof_digest(way: str = "way") -> Column:
    """One digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: str, way: str = "way") -> Column:
    """The root that a leaf and its siblings give; equal to the root of the manifest if the row is unchanged."""
    return F.aggregate(way, F.col(leaf), lambda node, s: digest(s["left"], node, s["right"]))
