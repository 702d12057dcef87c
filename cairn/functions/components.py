"""Connected components by contraction, for any node type that has an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, delete, sweep, written


def components(edges: DataFrame, seed: int = 5) -> DataFrame:
    """(node, component): component is the smallest node that edges (a, b) reach; nodes without an edge are left out.

    In each round every node takes as its representative the least of itself and its neighbours in an order of the round's
    own (a seeded hash), and the graph shrinks to the representatives. Whatever the numbering and the shape, over a quarter of the
    nodes that are left are expected to go in a round (more than half of a chain, nearly all of a star), so rounds grow with the
    logarithm of the nodes and there is no limit to reach. The names are then handed back from the last round to the first.
    A node's neighbours are aggregated before the shuffle and joined to tables of unique keys, so a node with very many
    edges can be split. Self-loops, repeated edges and null ends change nothing.
    """
    pairs = cut(_pairs(edges.where("a IS NOT NULL AND b IS NOT NULL"), F.col("a"), F.col("b")))
    at, rounds = written[-1], []
    while True:
        order = lambda node: F.xxhash64(F.lit(seed + len(rounds)), node)  # noqa: E731, B023
        both = pairs.union(pairs.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order(F.col("b"))).alias("near"))
        own = cut(near.select("node", F.when(order(F.col("near")) < order(F.col("node")), F.col("near")).otherwise(F.col("node")).alias("rep")))
        rounds.append(own)
        a, b = own.select(F.col("node").alias("a"), F.col("rep").alias("ra")), own.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        pairs, old = cut(_pairs(pairs.join(a, "a").join(b, "b"), F.col("ra"), F.col("rb"))), at
        at = written[-1]
        del near, both
        sweep(pairs.sparkSession, old)
        if pairs.isEmpty():
            delete(pairs.sparkSession, at)
            break
    named = rounds[-1].withColumnRenamed("rep", "root")
    for at, own in enumerate(reversed(rounds[:-1])):
        later = named.select(F.col("node").alias("rep"), "root")
        named = own.join(later, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
        if at % 4 == 3:
            named = cut(named)
    named = cut(named)
    least = cut(named.groupBy("root").agg(F.min("node").alias("component")))  # read again, so that a large component's side of the join can be split
    return named.join(least, "root").select("node", "component")


def _pairs(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Each link once, without self-loops."""
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
