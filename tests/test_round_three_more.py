"""One test for each step that findings of round 3 on growth were mended by."""

from __future__ import annotations

import random

from cairn.operators import blocks
from cairn.sources.tables import _name, named, number

from .test_graph_structure import GRAPHS, plain_cuts


def jobs_of(spark, work):
    """What work() returns, and how many jobs it took."""
    context, group = spark.sparkContext, f"jobs {random.random()}"
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(group))


def test_bridges_and_cut_points_of_shallow_and_deep_graphs(spark):
    """hundreds of jobs on the smallest graph; by paths from the roots, some dozens. A forest of more levels goes the other way and ends alike."""
    edges = GRAPHS["tree, circle, clique and parts"] + [(40 + i, 41 + i) for i in range(5)]
    links = spark.createDataFrame(edges, "src long, dst long")
    bridges, points = plain_cuts(edges)
    got, jobs = jobs_of(spark, lambda: {tuple(r) for r in blocks.bridges(links).collect()})
    assert got == bridges and 0 < jobs < 120
    assert {r.id for r in blocks.cut_points(links).collect()} == points
    assert {tuple(r) for r in blocks.bridges(links, levels=2).collect()} == bridges


def test_numbers_of_nodes_have_the_order_of_names(spark):
    """Ids as numbers (F6, F7 and those after) come back as names and keep their order, on which least ids hang."""
    rnd = random.Random(1)
    keys = {0, 1, 2, 9, 10, 12, 99, 100, -1, -10, -2, 10**15 - 1, 1 - 10**15} | {rnd.randrange(-(10**n), 10**n) for n in range(1, 15) for _ in range(10)}
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = [r for p in "cnoprs" for r in df.select(_name(p, "k").alias("name"), number(p, "k").alias("id")).select("name", "id", named("id").alias("back")).collect()]
    assert all(r.name == r.back for r in rows)
    assert [r.name for r in sorted(rows, key=lambda r: r.name)] == [r.name for r in sorted(rows, key=lambda r: r.id)]


from cairn.functions.storage import spread
from cairn.operators import graph as g
from cairn.operators import structure as st


def test_distinct_links_are_spread_before_they_are_taken_once(spark):
    """A task's hash table held all links of its part of a file before they were shuffled."""
    edges = spark.createDataFrame([(1, 2, "t"), (2, 1, "t"), (1, 2, "t"), (3, 3, "u")], "src long, dst long, type string")
    merged = spark.createDataFrame([(2, 1)], "id long, canonical long")
    for got, want in ((st.symmetric(edges, ["t"]), {(1, 2, "t"), (3, 3, "u")}), (st.relink(edges, merged), {(3, 3, "u")})):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert spread(edges, "src").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
