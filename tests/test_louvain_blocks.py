"""Louvain in blocks against a plain version of the same rounds, and names and hashes that blocks work out for themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import louvain
from cairn.sources.tables import named, number, spelled


def plain(spark, ids, edges, tolerance=0.03, seed=1):
    """louvain()'s levels, node by node; turns are drawn by Spark's own hash of the names."""
    links, levels, at, first = {}, [], {i: i for i in ids}, True
    for a, b, w in edges:
        links[a, b] = links.get((a, b), 0) + w
        links[b, a] = links.get((b, a), 0) + w
    total = sum(links.values())

    def quality(k, c):
        tot = {}
        for i, x in k.items():
            tot[c[i]] = tot.get(c[i], 0) + x
        return sum(w for (a, b), w in links.items() if c[a] == c[b]) / total - sum((x / total) ** 2 for x in tot.values()), tot

    for level in range(1, 21):
        k = {}
        for (a, _), w in links.items():
            k[a] = k.get(a, 0) + w
        c, turn, share = {i: i for i in k}, 0, 0.5
        q, tot = quality(k, c)
        start = q
        names = spark.createDataFrame([(i,) for i in k], "id long")
        while share > 0.1:
            turn += 1
            may = {r.id for r in names.where(F.pmod(F.xxhash64(F.lit(seed + 1000 * level + turn), named(F.col("id"))), F.lit(1 << 20)) < int(share * (1 << 20))).collect()}
            new = dict(c)
            for i in may:
                to = {}
                for (a, b), w in links.items():
                    if a == i and b != i:
                        to[c[b]] = to.get(c[b], 0) + w
                own = to.pop(c[i], 0)
                gains = [(-round(w - own - k[i] * (tot[x] - (tot[c[i]] - k[i])) / total, 12), x) for x, w in to.items() if w - own - k[i] * (tot[x] - (tot[c[i]] - k[i])) / total > 1e-12]
                new[i] = min(gains)[1] if gains else c[i]
            got, new_tot = quality(k, new)
            share = share if got > q + tolerance * abs(got) else share / 4
            if got > q + 1e-12:
                c, q, tot = new, got, new_tot
        if not first and q <= start + tolerance * abs(q):
            break
        first = False
        at = {i: c.get(x, x) for i, x in at.items()}
        levels += [(level, i, x) for i, x in at.items()]
        merged = {}
        for (a, b), w in links.items():
            merged[c[a], c[b]] = merged.get((c[a], c[b]), 0) + w
        links = merged
    return sorted(levels), q


def test_louvain_in_blocks_equals_a_plain_version(spark):
    rnd = random.Random(4)
    keys = [r.id for r in spark.range(60).select(number("o", "id").alias("id")).collect()]
    pairs = [(a, b) for a in range(50) for b in range(a) if rnd.random() < (0.7 if a // 10 == b // 10 else 0.04)]
    edges = [(keys[a], keys[b], float(rnd.choice([1, 1, 2]))) for a, b in pairs] + [(keys[3], keys[3], 2.0), (keys[1], keys[2], 1.0), (keys[51], keys[51], 1.0), (keys[52], keys[53], 1.0)]
    wanted, _ = plain(spark, keys, edges)
    nodes, links = spark.createDataFrame([(i,) for i in keys], "id long"), spark.createDataFrame(edges + [(keys[1], keys[9], 0.0), (None, keys[9], 1.0)], "src long, dst long, w double")
    for least in (500_000, 40):
        got = louvain.louvain(nodes, links, spell=spelled(), least=least)
        assert sorted(tuple(r) for r in got.levels.collect()) == wanted
        assert got.quality == sorted(got.quality)


def test_louvain_rounds_start_few_jobs(spark):
    """A round was twenty jobs and more, each over all links."""
    rnd = random.Random(7)
    edges = [(a, b) for a in range(40) for b in range(a) if rnd.random() < (0.8 if a // 8 == b // 8 else 0.03)]
    tracker, group = spark.sparkContext.statusTracker(), "louvain-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = louvain.louvain(spark.range(40), spark.createDataFrame(edges, "src long, dst long"))
        assert got.quality[-1] > 0.5
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    print("jobs", jobs)
    assert jobs < 140


def test_louvain_of_names_in_text(spark):
    edges = [(f"n{c}{i}", f"n{c}{j}") for c in range(3) for i in range(5) for j in range(i)] + [("n00", "n10")]
    nodes = spark.createDataFrame([(f"n{c}{i}",) for c in range(3) for i in range(5)] + [("z",)], "id string")
    got = louvain.louvain(nodes, spark.createDataFrame(edges, "src string, dst string"))
    last = {r.id: r.community for r in got.levels.orderBy("level").collect()}
    assert last["z"] == "z" and all(len({last[f"n{c}{i}"] for i in range(5)}) == 1 for c in range(3))
    assert got.quality == sorted(got.quality) and got.quality[-1] == pytest.approx(30 / 31 - (21 / 62) ** 2 * 2 - (20 / 62) ** 2)


def test_spelled_is_named(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 7, -7, 10, 12345678, 999_999_999_999_999, -100)], "k long")
    rows = keys.select(F.explode(F.array(number("o", "k"), number("c", "k"))).alias("id")).select("id", named(F.col("id")).alias("name")).collect()
    ids, found = np.array([r.id for r in rows]), {}
    for at, letters in spelled()(ids):
        found |= {int(i): bytes(x).decode() for i, x in zip(at, letters, strict=True)}
    assert [found[i] for i in range(len(rows))] == [r.name for r in rows]
