"""Findings of round 4 on small inputs."""

from __future__ import annotations

from cairn.operators import graph


def test_typed_degrees_count_both_ways_and_every_type(spark):
    """Ways in, and types that the query left out, were missing."""
    edges = [("cd", "ew", "about"), ("ew", "ni", "applies"), ("cd", "e1", "by"), ("cd", "cd", "about"), ("e1", "ew", "other")]
    got = graph.typed_degrees(spark.createDataFrame(edges, "src string, dst string, type string"), ["about", "applies", "by"])
    assert got.columns == ["id", "out_about", "out_applies", "out_by", "in_about", "in_applies", "in_by", "total_out", "total_in"]
    assert sorted(tuple(r) for r in got.collect()) == [
        ("cd", 2, 0, 1, 1, 0, 0, 3, 1), ("e1", 0, 0, 0, 0, 0, 1, 1, 1), ("ew", 0, 1, 0, 1, 0, 0, 1, 2), ("ni", 0, 0, 0, 0, 1, 0, 0, 1),
    ]


def test_typed_degree_has_every_node_with_an_edge(spark):
    from cairn import registry

    got = {r.id: r for r in registry.queries()["typed_degree"](spark, "/root/testdata/sf0.001").collect()}
    assert got["r0"].in_in_region == got["r0"].total_in == 5 and got["n1"].out_in_region == 1
    assert sum(r.total_in for r in got.values()) == sum(r.total_out for r in got.values())


def test_blocked_pairs_of_any_length_equal_all_pairs(spark):
    """Names of no letter, of few and of many, copies and nulls: against a comparison of all pairs."""
    import random

    from pyspark.sql import functions as F

    from cairn.operators import retrieval

    rnd, rows = random.Random(3), []
    for length in (0, 1, 2, 5, 9, 10, 11, 19, 20, 21, 35):
        for _ in range(12):
            base = "".join(rnd.choice("abé") for _ in range(length))
            for _ in range(2):
                s = list(base)
                for _ in range(rnd.randint(0, 3)):
                    at = rnd.randint(0, len(s))
                    s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
                rows.append((len(rows), "".join(s), rnd.choice([1, 1, 2, None])))
    rows += [(5, rows[7][1], 1), (len(rows), None, 1), (None, "ab", 1)]
    table = spark.createDataFrame(rows, "id long, name string, k int")
    a, b = table.alias("a"), table.alias("b")
    score = 1 - F.levenshtein("a.name", "b.name") / F.greatest(F.length("a.name"), F.length("b.name"), F.lit(1))
    for least in (0.9, 0.5, 0.0, 1.0):
        want = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).select("a.id", "b.id", score.alias("score")).where(F.col("score") >= least)
        got = retrieval.blocked_pairs(table, "id", [F.col("k")], "name", least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), least


def test_blocked_pairs_of_a_large_block_are_not_all_made(spark):
    """All pairs of a block were compared: 450 million here, half an hour in one task."""
    import threading

    from pyspark.sql import functions as F

    from cairn.operators import retrieval

    number = F.col("id") * 7919 % 100_003
    names = spark.range(30_000).select("id", F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0")).alias("name"), F.lit(1).alias("k"))
    digits = [f"{i * 7919 % 100_003:09}" for i in range(30_000)]
    place = {d: i for i, d in enumerate(digits)}
    want = {(i, place[t]) for d, i in place.items() for at in range(9) for x in "0123456789" if (t := d[:at] + x + d[at + 1 :]) in place and i < place[t]}
    late = threading.Timer(120, spark.sparkContext.cancelJobGroup, ["pairs"])
    spark.sparkContext.setJobGroup("pairs", "pairs")
    late.start()
    try:
        got = retrieval.blocked_pairs(names, "id", [F.col("k")], "name", 0.9).collect()
    finally:
        late.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want


def test_core_numbers_keep_their_state_in_bytes_and_leave_no_old_rounds(spark, tmp_path):
    """Links and states were arrays of numbers, taken apart value by value in each round, and every round's table and shuffles stayed on disk."""
    import os
    import random

    from cairn.functions.storage import shared_dir
    from cairn.operators import graph as g

    from .test_operators import plain_cores

    rnd = random.Random(5)
    links = [(a, b) for a in range(60) for b in range(a) if rnd.random() < (0.5 if a < 20 else 0.08)]
    before = set(os.listdir(shared_dir(spark).removeprefix("file://"))) if os.path.isdir(shared_dir(spark).removeprefix("file://")) else set()
    got = g.core_numbers(None, spark.createDataFrame(links + links[:9] + [(4, 4), (None, 3)], "src long, dst long"), block=60, least=1)
    assert {r.id: r.core for r in got.collect()} == {i: k for i, k in plain_cores(60, links).items() if any(i in e for e in links)}
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert len(left) == 4  # the links once, in blocks, the last round, the result


def test_louvain_leaves_only_its_levels_on_disk(spark):
    """The blocks and links of each level stayed until the end."""
    import os

    from cairn.functions.storage import shared_dir
    from cairn.operators import louvain

    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    edges = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(6) for j in range(i)] + [(10 * c, 10 * c + 10) for c in range(5)]
    got = louvain.louvain(spark.range(60), spark.createDataFrame(edges, "src long, dst long"))
    levels = len(got.quality)
    left = set(os.listdir(place)) - before
    assert levels == got.levels.select("level").distinct().count() and len(left) <= levels + 1  # the nodes and each level


def test_components_leave_no_links_on_disk(spark):
    """Each round's links stayed until the end."""
    import os

    from cairn.functions.components import components
    from cairn.functions.storage import cut, shared_dir

    cut(spark.range(1))
    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    got = components(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))
    new = set(os.listdir(place)) - before
    assert {r.component for r in got.collect()} == {0}
    kept = [spark.read.parquet(f"{place}/{name}").columns for name in new]
    assert ["a", "b"] not in kept and len(kept) > 3
