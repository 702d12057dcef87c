"""Relational paths between pairs of nodes, ranked by a flow that each step weakens, without listing all paths.

What a node can at best still hand on to a target within the steps left is worked out backward first. A narrow search then finds some
paths, whose flow says what the best ones have at least; the wide search drops every partial path that can't reach that, so
that the result is that of listing all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import bucketed, cut, spread

#: An edge without a confidence, and what is left of a flow after a step.
WEIGHT, DECAY = 0.8, 0.8
_EPS = 1e-12


def potentials(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(target, id, left, best): the greatest flow that reaches target from id within `left` steps, for left from 0 to most. Nodes from which nothing does are left out."""
    now = targets.select(F.col("target"), F.col("target").alias("id"), F.lit(1.0).alias("best")).distinct()
    out = now.withColumn("left", F.lit(0))
    for left in range(1, most + 1):
        step = now.join(edges, F.col("id") == F.col("dst")).select("target", F.col("src").alias("id"), (F.col("best") * F.col("w")).alias("best"))
        now = cut(now.unionByName(step).groupBy("target", "id").agg(F.max("best").alias("best")))
        out = out.unionByName(now.withColumn("left", F.lit(left)))
    return out


def _onward(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """edges on walks of at most `most` steps from sources (id). They are written in buckets of src, so a step shuffles only the nodes it goes on from."""
    held = bucketed(spread(edges, "src"), "src")
    front = seen = cut(sources.distinct())
    out = None
    for step in range(most):
        got = cut(held.join(front.withColumnRenamed("id", "src"), "src"))
        out = got if out is None else out.unionByName(got)
        if step < most - 1:
            front = cut(got.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
            seen = seen.unionByName(front)
    return out


def _search(pairs: DataFrame, edges: DataFrame, hope: DataFrame, most: int, beam: int | None) -> DataFrame:
    """(source, target, nodes, types, flow) of simple paths; pairs has `least`, the flow below which nothing is followed."""
    front = pairs.select("source", "target", "least", F.array("source").alias("nodes"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("flow"))
    out = None
    for step in range(1, most + 1):
        ahead = hope.where(F.col("left") == most - step).select("target", F.col("id").alias("dst"), "best")
        front = front.join(edges, F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).join(ahead, ["target", "dst"])
        front = front.where(F.col("flow") * F.col("w") * F.col("best") >= F.col("least") - _EPS)
        front = front.select("source", "target", "least", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("types", F.col("type")).alias("types"), (F.col("flow") * F.col("w")).alias("flow"))
        if beam:
            place = F.row_number().over(Window.partitionBy("source", "target", F.element_at("nodes", -1)).orderBy(F.desc("flow"), "nodes", "types"))
            front = front.withColumn("_p", place).where(F.col("_p") <= beam).drop("_p")
        front = cut(front)
        ended = F.element_at("nodes", -1) == F.col("target")
        out = front.where(ended) if out is None else out.unionByName(front.where(ended))
        front = front.where(~ended)
    return out.drop("least")


def _ranked(paths: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("source", "target").orderBy(F.desc(F.round("flow", 12)), F.size("nodes"), "nodes", "types")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def best_paths(edges: DataFrame, pairs: DataFrame, most: int = 4, top: int = 5, decay: float = DECAY, weight: float = WEIGHT, beam: int = 5) -> DataFrame:
    """(source, target, rank, nodes, types, flow): of each pair (source, target) the `top` simple directed paths of at most `most` steps with the
    greatest flow, decay ** steps times the edges' confidences; ties go to the shorter, then by nodes and types.

    edges (src, dst, type, confidence; null: weight). The narrow search keeps `beam` partial paths for each node, so its state is bounded;
    the wide one keeps those that can still be among the best. Pairs of one node, unknown nodes and pairs that nothing joins give no row;
    repeated pairs count once. Edges that no source reaches are left out first. Confidences lie between 0 and 1, and an edge that stands twice makes two paths.
    """
    kept = edges.where("src <> dst").select("src", "dst", F.coalesce("type", F.lit("")).alias("type"), (F.coalesce("confidence", F.lit(weight)) * decay).alias("w"))
    asked = cut(pairs.where("source <> target").select("source", "target").distinct())
    kept = _onward(kept, asked.select(F.col("source").alias("id")), most)
    hope = cut(potentials(kept, asked.select("target"), most))
    some = _ranked(_search(asked.withColumn("least", F.lit(0.0)), kept, hope, most, beam), top)
    sure = some.groupBy("source", "target").agg(F.min("flow").alias("f"), F.count("*").alias("n")).where(F.col("n") == top).select("source", "target", F.col("f").alias("least"))
    bound = cut(asked.join(sure, ["source", "target"], "left").withColumn("least", F.coalesce("least", F.lit(0.0))))
    return _ranked(_search(bound, kept, hope, most, None), top).select("source", "target", "rank", "nodes", "types", "flow")


def linear(nodes: Column, types: Column) -> Column:
    """`a -[KIND]-> b -[KIND]-> c`"""
    steps = F.zip_with(F.slice(nodes, F.lit(2), F.size(types)), types, lambda n, t: F.concat(F.lit(" -["), t, F.lit("]-> "), n.cast("string")))
    return F.concat(F.element_at(nodes, 1).cast("string"), F.array_join(steps, ""))
