"""What a graph's structure tells: audits, projections, communities, merges and deletions. nodes (id, label), edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ratio
from ..functions.storage import spread
from .graph import between, undirected


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree 2E/N and density E/(N(N-1))."""
    both = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    n, e = F.col("nodes"), F.col("edges")
    return both.select("nodes", "edges", ratio(2 * e, n).alias("mean_degree"), ratio(e, n * (n - 1)).alias("density"))


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Count of every kind and its share of all; the kinds are few."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the labels of both ends (src_label, dst_label), null where an end is unknown."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def off_schema(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Kinds of edges (src_label, type, dst_label) that the schema allowed (the same columns) doesn't have, and how many there are."""
    kinds = labelled(nodes, edges).groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))
    return kinds.join(allowed, ["src_label", "type", "dst_label"], "left_anti")


def cardinality(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (label, type, low, high; null: no limit): nodes whose number of out-edges of a type is outside."""
    out = edges.groupBy(F.col("src").alias("id"), "type").agg(F.count("*").alias("n"))
    found = nodes.join(rules, "label").join(out, ["id", "type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return found.where((F.col("n") < F.coalesce("low", F.lit(0))) | (F.col("n") > F.coalesce("high", F.lit(2**62)))).select("id", "label", "type", "n")


def weighted_projection(edges: DataFrame, weight: str) -> DataFrame:
    """(a, b, weight): canonical pairs with the sum of the weights of parallel and antiparallel edges, null as 0."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce(F.col(weight), F.lit(0.0)).alias("w"))
    return pair.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def strength(projection: DataFrame) -> DataFrame:
    ends = projection.select(F.explode(F.array("a", "b")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("strength"), F.count("*").alias("neighbours"))


def boundary(edges: DataFrame, member: DataFrame) -> DataFrame:
    """member (id, community): entities with links to other communities: inside, outside, and which others, in order."""
    m = between(edges, member)
    ends = F.array(F.struct(F.col("src").alias("id"), "own", "other"), F.struct(F.col("dst").alias("id"), F.col("other").alias("own"), F.col("own").alias("other")))
    counted = m.select(F.explode(ends).alias("e")).select("e.*").groupBy("id", "own", "other").agg(F.count("*").alias("n"))
    away = F.col("own") != F.col("other")
    found = counted.groupBy("id", "own").agg(F.coalesce(F.sum(F.when(~away, F.col("n"))), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(away, F.col("n"))), F.lit(0)).alias("outside"), F.array_join(F.array_sort(F.collect_set(F.when(away, F.col("other")))), ",").alias("others"))
    return found.where("outside > 0")


def merge_candidates(edges: DataFrame, member: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of communities a < b whose cross links are at least a share of cross links and both inner ones."""
    e = undirected(edges).where("src < dst")
    m = e.join(member.select(F.col("id").alias("src"), F.col("community").alias("x")), "src").join(member.select(F.col("id").alias("dst"), F.col("community").alias("y")), "dst")
    c = m.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
    inner = c.where("a = b").select(F.col("a").alias("c"), F.col("n").alias("inner"))
    cross = c.where("a <> b").join(inner.select(F.col("c").alias("a"), F.col("inner").alias("ia")), "a", "left").join(inner.select(F.col("c").alias("b"), F.col("inner").alias("ib")), "b", "left").na.fill(0, ["ia", "ib"])
    return cross.select("a", "b", F.col("n").alias("cross"), (F.col("n") / (F.col("n") + F.col("ia") + F.col("ib"))).alias("cohesion")).where(F.col("cohesion") >= least)


def community_metrics(member: DataFrame) -> DataFrame:
    """One row: communities, largest, singletons, and the sum of squared shares."""
    size = member.groupBy("community").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return size.withColumn("s", share).agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.col("s") * F.col("s")).alias("concentration"))


def top_members(member: DataFrame, degree: DataFrame, most: int = 3) -> DataFrame:
    """(community, names): its members of highest degree, ties by id."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    top = member.join(degree.select("id", "degree"), "id").withColumn("_k", place).where(F.col("_k") <= most)
    return top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]), ", ").alias("names"))


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without those of gone (id) and all that touches them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def relink(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """edges with the ids of merged (id, canonical) replaced; loops that this makes go, and of equal edges one stays."""
    a, b = merged.select(F.col("id").alias("src"), F.col("canonical").alias("_a")), merged.select(F.col("id").alias("dst"), F.col("canonical").alias("_b"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    src, dst = F.coalesce("_a", "src"), F.coalesce("_b", "dst")
    return spread(e.where((src != dst) | (F.col("src") == F.col("dst"))).select(src.alias("src"), dst.alias("dst"), "type"), "src", "dst").distinct()


def symmetric(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """edges, those of symmetric kinds once per pair, from the lesser to the greater id."""
    turn = F.col("type").isin(kinds)
    return spread(edges.select(F.when(turn, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"), "type"), "src", "dst").distinct()


def histogram_of_degrees(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count("*").alias("nodes"))


def minimap(points: DataFrame, cells: int = 10) -> DataFrame:
    """points (x, y): how many are in each cell of a grid over all of them; a flat axis is one cell."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, low, high: F.when(F.col(high) > F.col(low), F.least(F.lit(cells - 1), F.floor((F.col(v) - F.col(low)) / (F.col(high) - F.col(low)) * cells))).otherwise(0).cast("long")
    return points.crossJoin(F.broadcast(box)).groupBy(at("x", "x0", "x1").alias("column"), at("y", "y0", "y1").alias("row")).agg(F.count("*").alias("n"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in ids (id)."""
    i = ids.select("id").distinct()
    return edges.join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi")


def first_wins(*tables: DataFrame, key: str = "id") -> DataFrame:
    """The union of tables with the row of the first table that has a key."""
    rest = [c for c in tables[0].columns if c != key]
    rows = None
    for place, t in enumerate(tables):
        one = t.select(key, F.struct(F.lit(place).alias("_p"), *rest).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min("v").alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def ensemble(scores: DataFrame, names: list[str]) -> DataFrame:
    """scores (id, names...): mean of the scores scaled to 0..1 each, 0 where one is flat."""
    box = scores.agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))))
    scaled = lambda n: F.coalesce(F.try_divide(F.col(n) - F.col(f"_low_{n}"), F.col(f"_high_{n}") - F.col(f"_low_{n}")), F.lit(0.0))
    return scores.crossJoin(F.broadcast(box)).select("id", (sum((scaled(n) for n in names), F.lit(0.0)) / len(names)).alias("centrality"))


def path_score(hops: Column, evidence: Column) -> Column:
    """Half for being short, half for being supported."""
    return 0.5 / (1 + hops) + 0.5 * evidence / (1 + evidence)


def closure(parents: DataFrame) -> DataFrame:
    """parents (id, parent): (id, ancestor, hops) of all ancestors, by doubling.

    Where parents form a circle, all on it and all that lead into it have each node of it as an ancestor once, by the least hops, and
    none is its own; other trees are not touched by that. Each round doubles the hops, and there are no more of them than the logarithm of the
    longest chain, or of a circle's length.
    """
    from ..functions.storage import cut

    jump = cut(parents.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("hops")).distinct())
    found, many = jump.where("id <> to"), -1
    while True:
        again = jump.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"))
        longer = found.join(again, "to").where("id <> far").select("id", F.col("far").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
        found = cut(found.unionByName(longer).groupBy("id", "to").agg(F.min("hops").alias("hops")))
        jump = cut(jump.join(again, "to").select("id", F.col("far").alias("to"), (F.col("hops") + F.col("more")).alias("hops")).distinct())
        before, many = many, found.count()
        if jump.isEmpty() or many == before:
            return found.select("id", F.col("to").alias("ancestor"), "hops")
