"""Communities, calibrators, resampling and clusters against plain versions."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest

from cairn.operators import calibrators, clusters, louvain, resampling


def modularity(edges, part):
    links = [(a, b) for a, b in edges]
    degree, inner = {}, 0
    for a, b in links:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
        inner += 2 * (part[a] == part[b])
    m2 = 2 * len(links)
    tot = {}
    for n, k in degree.items():
        tot[part[n]] = tot.get(part[n], 0) + k
    return inner / m2 - sum((t / m2) ** 2 for t in tot.values())


def cliques(n, size):
    out = [(c * size + i, c * size + j) for c in range(n) for i in range(size) for j in range(i)]
    return out + [(c * size, ((c + 1) % n) * size + 1) for c in range(n)]


def test_louvain_finds_cliques_and_never_falls(spark):
    edges = cliques(6, 5) + [(3, 3)]
    nodes = spark.createDataFrame([(i,) for i in range(30)] + [(99,)], "id long")
    got = louvain.louvain(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert got.quality == sorted(got.quality) and len(got.quality) >= 1
    last = {}
    for r in got.levels.orderBy("level").collect():
        last[r.id] = r.community
    assert len(last) == 31 and last[99] == 99
    assert got.quality[-1] == pytest.approx(modularity(edges, last))
    best = modularity(edges, {i: i // 5 for i in range(30)})
    assert got.quality[-1] >= 0.95 * best


def test_louvain_is_near_the_best_of_all_partitions(spark):
    rnd = random.Random(2)
    edges = [(a, b) for a in range(7) for b in range(a) if rnd.random() < (0.8 if (a < 4) == (b < 4) else 0.2)]
    best = max(modularity(edges, p) for p in product(range(3), repeat=7))
    got = louvain.louvain(spark.range(7), spark.createDataFrame(edges, "src long, dst long"))
    assert 0.8 * best <= got.quality[-1] <= best + 1e-9
    alone = louvain.louvain(spark.range(2), spark.createDataFrame([], "src long, dst long"))
    assert {(r.id, r.community) for r in alone.levels.collect()} == {(0, 0), (1, 1)} and alone.quality == [0.0]


def plain_isotonic(pairs):
    per = {}
    for x, y in pairs:
        p, n = per.get(x, (0, 0))
        per[x] = (p + y, n + 1)
    blocks = []
    for x in sorted(per):
        blocks.append([x, x, *per[x]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(a, b, n, pytest.approx(p / n)) for a, b, p, n in blocks]


def test_isotonic_equals_plain_pools(spark):
    rnd = random.Random(5)
    for n in (1, 5, 400):
        pairs = [(round(rnd.random(), 2), int(rnd.random() < 0.3 + 0.4 * rnd.random())) for _ in range(n)]
        df = spark.createDataFrame([*pairs, (None, 1), (0.5, None)], "confidence double, label int")
        for ranges in (1, 20):
            got = sorted((r.low, r.high, r.n, r.value) for r in calibrators.isotonic(df.repartition(4), ranges).collect())
            assert got == plain_isotonic(pairs)
    assert calibrators.isotonic(spark.createDataFrame([], "confidence double, label int")).count() == 0


def test_platt_and_bins(spark):
    rnd = random.Random(7)
    pairs = [(x := rnd.uniform(-3, 3), int(rnd.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5))))) for _ in range(3000)]
    a, b = calibrators.platt(spark.createDataFrame(pairs, "confidence double, label int"))
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    pos = y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    w = np.zeros(2)
    for _ in range(100):  # plain Newton
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        h = np.array([[(p * (1 - p) * x * x).sum(), (p * (1 - p) * x).sum()], [(p * (1 - p) * x).sum(), (p * (1 - p)).sum()]])
        w -= np.linalg.solve(h, g)
    assert (a, b) == pytest.approx(tuple(w), abs=1e-3)
    assert calibrators.platt(spark.createDataFrame([], "confidence double, label int")) == (1.0, 0.0)
    assert all(np.isfinite(calibrators.platt(spark.createDataFrame([(0.5, 1), (0.5, 1)], "confidence double, label int"))))
    got = calibrators.histogram_bins(spark.createDataFrame([(0.0, 1), (0.05, 0), (1.0, 1), (2.0, 0), (None, 1)], "confidence double, label int"), 2).orderBy("low").collect()
    assert [(r.low, r.value) for r in got] == [(0.0, 0.5), (0.5, 0.5)]


def test_permutations_are_exact_or_near_and_do_not_depend_on_partitions(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.gauss(0.4, 1), rnd.gauss(0, 1)) for i in range(14)]
    df = spark.createDataFrame([*rows, (99, None, 1.0)], "k long, a double, b double")
    d = [a - b for _, a, b in rows]
    want = np.mean([abs(sum(s * v for s, v in zip(signs, d, strict=True))) >= abs(sum(d)) - 1e-9 for signs in product((1, -1), repeat=14)])
    exact = resampling.permutation(df, ["k"]).first()
    assert exact.exact and exact.n == 14 and exact.n_resamples == 2**14 and exact.p_value == pytest.approx(want)
    near = [resampling.permutation(df.repartition(p), ["k"], most_exact=0, replicates=4000).first() for p in (1, 5)]
    assert near[0].p_value == near[1].p_value == pytest.approx(want, abs=0.04) and not near[0].exact and near[0].observed_diff == pytest.approx(exact.observed_diff)
    none = resampling.permutation(df.where("k > 90"), ["k"]).first()
    assert (none.n, none.observed_diff, none.p_value) == (0, None, 1.0)


def test_bootstrap_covers_the_mean(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.gauss(10, 2)) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, None)], "k long, x double")
    got = [resampling.bootstrap(df.repartition(p), ["k"], "x", replicates=400).first() for p in (1, 6)]
    assert got[0] == pytest.approx(got[1])
    se = 2 / 30
    assert got[0].n == 900 and got[0].lower == pytest.approx(got[0].point - 1.96 * se, abs=0.05) and got[0].upper == pytest.approx(got[0].point + 1.96 * se, abs=0.05)
    assert tuple(resampling.bootstrap(df.where("k < 0"), ["k"], "x").first()) == (0, None, None, None)


def vectors(spark, n=400, d=12, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, d))
    rows = [(i, (centres[i % 8] + 0.15 * rnd.normal(size=d)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (900, None), (901, [float("nan")] * d), (902, [0.0] * d), (903, [1.0])], "id long, v array<double>")


def test_kmeans_inertia_falls_to_the_plain_one(spark):
    rows, df = vectors(spark)
    centres, inertia = clusters.kmeans(clusters.whole(df.where("id < 900")), 8)
    x = np.array([v for _, v in rows])
    want = sum(((x[k::8] - x[k::8].mean(0)) ** 2).sum() for k in range(8))
    assert len(centres) == 8 and all(b <= a + 1e-9 for a, b in zip(inertia, inertia[1:], strict=False)) and inertia[-1] <= 1.02 * want
    assert clusters.kmeans(clusters.whole(df.where("id < 0")), 8)[1] == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert len(clusters.kmeans(clusters.whole(same), 3)[0]) == 1


def test_inverted_file_recall(spark):
    rows, df = vectors(spark, d=16)
    asked = df.where("id % 40 = 0").withColumnRenamed("id", "query")
    got = clusters.inverted_file_search(df, asked, lists=10, probes=3).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 400, 40):
        best = set(np.lexsort((np.arange(400), -np.round(x @ x[q], 9)))[:10].tolist())
        mine = [r.id for r in got if r["query"] == q]
        assert len(mine) == len(set(mine)) == 10
        hits, total = hits + len(best & set(mine)), total + 10
    assert hits / total >= 0.9
    assert clusters.inverted_file_search(df.where("id < 0"), asked.where("query < 0"), 4, 2).count() == 0


def test_inverted_file_recall_on_the_tables(spark):
    from cairn import registry

    sf = "/root/testdata/sf0.01"
    q = registry.queries()
    exact = {(r["query"], r.id) for r in q["cosine_topk"](spark, sf).collect()}
    mine = {(r["query"], r.id) for r in q["inverted_file_topk"](spark, sf).collect()}
    assert len(exact & mine) >= 0.9 * len(exact)
