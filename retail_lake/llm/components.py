"""Connected components by repeated contraction of the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.session import freeze


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is one node of its component.

    Each round sends every node to the first of itself and its neighbours, in an order by hash that
    is new in every round, and keeps the edges between what is left. A constant share of the nodes
    is expected to go whatever the shape and the ids, chains in id order too, so the number of
    rounds grows with the logarithm of the size. Rounds are written to the shared folder, which
    cuts the lineage. The way of each node is then followed back from the last round.
    """
    both = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    left = freeze(edges.filter(F.col(a) != F.col(b)).select(both.alias("e")).select("e.u", "e.v").distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(steps))

        def order(node: str) -> Column:
            return F.struct(F.xxhash64(node, turn).alias("at"), F.col(node).alias("node"))

        step = freeze(left.groupBy("u").agg(F.least(order("u"), F.min(order("v")))["node"].alias("to")))
        steps.append(step)
        from_, to = step.select("u", F.col("to").alias("tu")), step.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        left = freeze(
            left.join(from_, "u")
            .join(to, "v")
            .filter("tu <> tv")
            .select(F.col("tu").alias("u"), F.col("tv").alias("v"))
            .distinct()
        )
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    way = steps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = way.select(F.col("node").alias("to"), "root")
        way = freeze(
            step.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
        )
    return way
