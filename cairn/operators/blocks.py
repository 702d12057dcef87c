"""Bridges, articulation points and blocks (biconnected components) as joins.

Where a breadth-first forest is shallow, each node keeps its path from the root, and a link outside the forest says at once, by the paths of
its ends, which tree edges it goes around: `shallow`. Else they come by Tarjan and Vishkin's method: a spanning forest is found by Boruvka's rounds, walked along as one list of edge sides (an Euler tour) whose places come from
pointer doubling, and numbered in preorder. What a subtree's links reach is a least and greatest over a range of numbers, from tables of
doubling width. Two tree edges are of one block if a link goes around where they meet, and blocks are connected components
of tree edges. Every step is a join or an aggregation over rows of nodes or edges, and their number grows with the logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.order import cumulative
from ..functions.storage import cut, sweep
from .graph import adjacency

#: Levels of a breadth-first forest up to which nodes keep their paths.
LEVELS = 16


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """Those of pairs (a < b, different) that join up all that pairs join up, without a circle. Each part takes its least outgoing edge by a hash."""
    edges = cut(pairs.select("a", "b", F.xxhash64("a", "b").alias("h")))
    part = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("part", F.col("id"))
    part, taken = cut(part), None
    left = edges.withColumns({"pa": F.col("a"), "pb": F.col("b")})
    while True:
        order = F.struct("h", "a", "b")
        way = left.select(F.col("pa").alias("p"), F.col("pb").alias("q"), order.alias("o")).unionByName(left.select(F.col("pb").alias("p"), F.col("pa").alias("q"), order.alias("o")))
        best = cut(way.groupBy("p").agg(F.min(F.struct("o", "q")).alias("m")).select("p", "m.q", F.col("m.o.a").alias("a"), F.col("m.o.b").alias("b")))
        if best.isEmpty():
            return taken if taken is not None else edges.select("a", "b")
        chosen = best.select("a", "b").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        # the order of edges is strict, so pointers meet in pairs at most and make no longer circle
        joined = components(best.select(F.col("p").alias("a"), F.col("q").alias("b")))
        part = cut(part.join(joined, F.col("part") == F.col("node"), "left").select("id", F.coalesce("component", "part").alias("part")))
        own = lambda end: part.select(F.col("id").alias(end), F.col("part").alias(f"p{end}"))
        left = cut(left.select("a", "b", "h").join(own("a"), "a").join(own("b"), "b").where("pa <> pb"))


def rooted(tree: DataFrame) -> DataFrame:
    """(id, parent, pre, size, root) of the nodes of a forest of pairs (a, b): rooted at the least node of each tree, numbered in preorder over all trees without gaps."""
    sides = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v")))
    follow = _around(sides)
    root = components(tree).withColumnsRenamed({"node": "v", "component": "root"})
    follow = cut(follow.join(root, "v"))
    # the tour of a tree ends where it would leave the root for its first neighbour again
    ends = (F.col("v") == F.col("root")) & F.col("last")
    tour = cut(follow.select("u", "v", "root", F.when(~ends, F.col("v")).alias("nu"), F.when(~ends, F.col("next")).alias("nv"), F.lit(1).cast("long").alias("d")))
    while not tour.where("nu IS NOT NULL").isEmpty():
        far = tour.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nnu"), F.col("nv").alias("nnv"), F.col("d").alias("dd"))
        tour = cut(tour.join(far, ["nu", "nv"], "left").select("u", "v", "root", F.col("nnu").alias("nu"), F.col("nnv").alias("nv"), (F.col("d") + F.coalesce("dd", F.lit(0))).alias("d")))
    # d: sides from here to the end. Of the two sides of an edge, that which is walked first goes down
    back = tour.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("d").alias("d_back"))
    both = tour.join(back, ["u", "v"])
    down = both.where("d > d_back").select(F.col("v").alias("id"), F.col("u").alias("parent"), "root", F.col("d"), ((F.col("d") - F.col("d_back") + 1) / 2).cast("long").alias("size"))
    sizes = cut(down.groupBy("root").agg((F.count("*") + 1).alias("nodes")))
    offsets = cumulative(sizes, "root", ["nodes"]).select("root", (F.col("upto_nodes") - F.col("nodes")).alias("offset"), "nodes")
    nodes = cut(down.join(offsets, "root"))
    # before a node's own step down: as many steps down as up, but for those still open, so its number is counted from the tour's steps down
    steps = nodes.select("root", "id", "parent", "size", "offset", "nodes", (2 * (F.col("nodes") - 1) - F.col("d")).alias("at"))
    placed = _preorder(steps)
    top = offsets.select(F.col("root").alias("id"), F.lit(None).cast(dict(tree.dtypes)["a"]).alias("parent"), F.col("offset").alias("pre"), F.col("nodes").alias("size"), "root")
    return cut(placed.unionByName(top))


def _around(sides: DataFrame) -> DataFrame:
    """sides (u, v) with the side that follows: on to next, the neighbour of v after u, or the first after the last. Placed over ranges of all sides, so that a hub is no one task."""
    keyed = sides.withColumns({"key": F.struct("v", "u"), "one": F.lit(1).cast("long")})
    placed = cut(cumulative(keyed, "key", ["one"]).select("u", "v", F.col("upto_one").alias("at")))
    after = placed.select((F.col("at") - 1).alias("at"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    first = cut(placed.groupBy("v").agg(F.min_by("u", "at").alias("_first")))
    both = placed.join(after, "at", "left").join(first, "v").withColumn("last", F.coalesce(F.col("_v") != F.col("v"), F.lit(True)))
    return both.select("u", "v", F.when(F.col("last"), F.col("_first")).otherwise(F.col("_u")).alias("next"), "last")


def _preorder(steps: DataFrame) -> DataFrame:
    """(id, parent, pre, size, root): numbers by place in the tour, offset by the trees before. Counted over ranges of places, so that a large tree is no one task."""
    n = cumulative(steps.withColumn("place", 2 * F.col("offset") + F.col("at")).withColumn("one", F.lit(1).cast("long")).withColumn("key", F.struct("place")), "key", ["one"])
    # among all trees: steps down so far, and one root for each tree up to this one
    trees = steps.select("root", "offset").distinct().withColumn("one", F.lit(1).cast("long"))
    many = cumulative(trees, "offset", ["one"]).select("root", F.col("upto_one").alias("roots"))
    return n.join(many, "root").select("id", "parent", (F.col("upto_one") - 1 + F.col("roots")).alias("pre"), "size", "root")


def _extremes(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with low and high: the least `low` and greatest `high` of values (pre, low, high; one for each number) in pre .. pre + size - 1."""
    k, width, table = 0, 1, values
    largest = nodes.agg(F.max("size")).first()[0] or 1
    asked = nodes.withColumn("k", F.length(F.bin("size")) - 1)
    out = None
    while True:
        own = asked.where(F.col("k") == k)
        first, last = table.select("pre", "low", "high"), table.select(F.col("pre").alias("_at"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        got = own.withColumn("_at", F.col("pre") + F.col("size") - width).join(first, "pre").join(last, "_at").select(*nodes.columns, F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))
        out = got if out is None else out.unionByName(got)
        if 2 * width > largest:
            return cut(out)
        ahead = table.select((F.col("pre") - width).alias("pre"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        table = cut(table.join(ahead, "pre", "left").select("pre", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
        k, width = k + 1, 2 * width


def blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, parent, pre, size, root, block; block is null of a root) and links (a, b) outside the tree. The block is that of the edge to the parent."""
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    tree = cut(spanning_forest(pairs))
    nodes = rooted(tree)
    rest = cut(pairs.join(tree, ["a", "b"], "left_anti"))
    number = lambda end: nodes.select(F.col("id").alias(end), F.col("pre").alias(f"pre_{end}"), F.col("size").alias(f"size_{end}"))
    links = cut(rest.join(number("a"), "a").join(number("b"), "b"))
    met = links.select(F.col("pre_a").alias("pre"), F.col("pre_b").alias("to")).unionByName(links.select(F.col("pre_b").alias("pre"), F.col("pre_a").alias("to")))
    reach = met.groupBy("pre").agg(F.min("to").alias("l"), F.max("to").alias("h"))
    values = cut(nodes.select("pre").join(reach, "pre", "left").select("pre", F.least("pre", "l").alias("low"), F.greatest("pre", "h").alias("high")))
    wide = _extremes(values, nodes)
    # a child's edge and its parent's are of one block if a link leads from the child's subtree out of the parent's
    up = wide.select(F.col("id").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"), F.col("parent").alias("p_parent"))
    chained = wide.join(up, "parent").where("p_parent IS NOT NULL AND (low < p_pre OR high >= p_pre + p_size)").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    # and the edges above both ends of a link between subtrees, neither of which holds the other
    apart = "NOT (pre_b >= pre_a AND pre_b < pre_a + size_a) AND NOT (pre_a >= pre_b AND pre_a < pre_b + size_b)"
    same = components(chained.unionByName(links.where(apart).select("a", "b")))
    named = cut(nodes.join(same, F.col("id") == F.col("node"), "left").select("id", "parent", "pre", "size", "root", F.when(F.col("parent").isNotNull(), F.coalesce("component", "id")).alias("block")))
    return named, links


def breadth_first(both: DataFrame, most: int) -> DataFrame | None:
    """(id, path) of the nodes of both (see adjacency), path leading from the least node of the part to id itself; None if one has more than most levels."""
    roots = components(both.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))).where("node = component")
    front = cut(roots.select(F.col("node").alias("id"), F.array("node").alias("path")))
    before, out = None, front
    for _ in range(most):
        met = both.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
        # a node's neighbours are at most one level from it
        seen = front.select("id") if before is None else front.select("id").unionByName(before.select("id"))
        new = met.join(seen, "id", "left_anti").join(front.select(F.col("id").alias("up"), "path"), "up")
        before, front = front, cut(new.select("id", F.array_append("path", F.col("id")).alias("path")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    return None


def shallow(both: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a breadth-first forest: covered (id, common) and tops (a, b).

    No link outside the forest leads to an ancestor, so it closes a circle through the last node that its ends' paths have in common: through all tree
    edges below that, of which those next to it are the tops. covered has the nodes whose edge to the parent is on a circle,
    with the least number of nodes in common of all circles there. Nodes without are ends of bridges.
    """
    own = lambda end: paths.select(F.col("id").alias(end), F.col("path").alias(f"path_{end}"))
    met = both.where("src < dst").join(own("src"), "src").join(own("dst"), "dst")
    up = lambda end: F.coalesce(F.try_element_at(f"path_{end}", F.lit(-2)), F.col(end))
    common = F.size(F.array_intersect("path_src", "path_dst"))
    met = met.where((up("src") != F.col("dst")) & (up("dst") != F.col("src"))).select("src", "dst", common.alias("common"), *(F.try_element_at(f"path_{e}", common + 1).alias(f"top_{e}") for e in ("src", "dst")))
    met = cut(met)
    ends = met.select(F.col("src").alias("id"), "common").unionByName(met.select(F.col("dst").alias("id"), "common")).groupBy("id").agg(F.min("common").alias("common"))
    above = ends.join(paths, "id").select("common", F.posexplode("path").alias("at", "id")).where("at >= common")
    covered = cut(above.groupBy("id").agg(F.min("common").alias("common")))
    return covered, met.select(F.least("top_src", "top_dst").alias("a"), F.greatest("top_src", "top_dst").alias("b")).distinct()


def blocks_of_shallow(both: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, parent, block) as blocks() has them: a tree edge and the one above it are of one block if a circle holds both, and so are a circle's tops."""
    covered, tops = shallow(both, paths)
    below = covered.join(paths, "id").where(F.col("common") < F.size("path") - 1).select(F.col("id").alias("a"), F.try_element_at("path", F.lit(-2)).alias("b"))
    same = components(below.unionByName(tops))
    parent = F.try_element_at("path", F.lit(-2))
    return paths.join(same, F.col("id") == F.col("node"), "left").select("id", parent.alias("parent"), F.when(parent.isNotNull(), F.coalesce("component", "id")).alias("block"))


def bridges(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(a, b), a < b: links without which their ends fall apart. Loops and repeated links are none and change nothing."""
    both = adjacency(edges)
    paths = breadth_first(both, levels)
    sweep(edges.sparkSession)
    if paths is None:
        return bridges_of(blocks(edges)[0])
    alone = paths.where(F.size("path") > 1).join(shallow(both, paths)[0], "id", "left_anti").select("id", F.try_element_at("path", F.lit(-2)).alias("up"))
    return alone.select(F.least("id", "up").alias("a"), F.greatest("id", "up").alias("b"))


def bridges_of(named: DataFrame) -> DataFrame:
    alone = named.where("block IS NOT NULL").groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct("id", "parent")).alias("e")).where("n = 1")
    return alone.select(F.least("e.id", "e.parent").alias("a"), F.greatest("e.id", "e.parent").alias("b"))


def cut_points_of(named: DataFrame) -> DataFrame:
    """(id): nodes whose edges are of two blocks or more."""
    ends = named.where("block IS NOT NULL")
    return ends.select("id", "block").unionByName(ends.select(F.col("parent").alias("id"), "block")).groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("id")


def cut_points(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id): nodes without which some of their neighbours fall apart."""
    both = adjacency(edges)
    paths = breadth_first(both, levels)
    sweep(edges.sparkSession)
    return cut_points_of(cut(blocks_of_shallow(both, paths)) if paths is not None else blocks(edges)[0])
