"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.sources.tables import durable


def connected(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str, rounds: list | None = None) -> DataFrame:
    """keys, node, group: the least node that edges (keys, node, other) lead to, each node of `nodes` alone at least.

    A round points all greater neighbours of a node at its least neighbour, then all smaller ones and the node itself. Stars
    around the least node are what is left when a round changes nothing, after about the logarithm of the longest way. A
    node's neighbours are never listed, its least one is an aggregate; each round is written durably. `rounds` takes each
    round's number of edges."""
    a, b = F.col("a"), F.col("b")
    at = durable(edges.where(F.col(node) != F.col("other")).select(*keys, F.greatest(node, "other").alias("a"), F.least(node, "other").alias("b")).distinct())
    same = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first())
    before = same(at)
    while before[0]:
        both = at.unionByName(at.select(*keys, b.alias("a"), a.alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, [*keys, "a"]).select(*keys, b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, b.alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.withColumnRenamed("m", "b"))
        at = durable(small.distinct())
        now = same(at)
        if rounds is not None:
            rounds.append(now[0])
        if now == before:
            break
        before = now
    return nodes.select(*keys, node).join(at.select(*keys, a.alias(node), b.alias("group")), [*keys, node], "left").select(*keys, node, F.coalesce("group", node).alias("group"))
