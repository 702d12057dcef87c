"""Connected components against union-find, with numberings that are hard for labels that spread."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import storage
from cairn.functions.components import components


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    least = {}
    for x in up:
        least[root(x)] = min(least.get(root(x), x), x)
    return {x: least[root(x)] for x in up}


def chain(order):
    return list(zip(order, order[1:], strict=False))


def shapes():
    rnd = random.Random(8)
    shuffled = rnd.sample(range(10_000), 10_000)
    arms = [chain([0, *range(1 + 100 * k, 101 + 100 * k)][:: 1 if k % 2 else -1]) for k in range(100)]
    yield "descending", chain([0, *range(10_000, 0, -1)])
    yield "shuffled", chain(shuffled)
    yield "many shuffled", [e for k in range(40) for e in chain(shuffled[k * 250 : (k + 1) * 250])]
    yield "star of chains", [e for arm in arms for e in arm]
    yield "star", [(0, i) for i in range(1, 10_000)]
    yield "random", [(rnd.randrange(9_000), rnd.randrange(9_000)) for _ in range(5_000)]


@pytest.mark.parametrize("name,edges", list(shapes()))
def test_components_equal_union_find(spark, name, edges):
    before = len(storage.written)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges)
    rounds = (len(storage.written) - before - 3) // 2  # two tables each
    assert rounds <= 3 * math.log2(len(got))


def test_loops_repeats_nulls_and_strings(spark):
    edges = [("b", "a"), ("a", "b"), ("a", "b"), ("c", "c"), (None, "a"), ("d", None), ("é", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "é": "z", "z": "z"}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_hub_and_its_copies_change_nothing(spark):
    hub = spark.range(1, 2000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(hub.union(hub)).where("component = 0").count() == 2000
