"""Blocks, betweenness and chains against plain versions."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cairn.operators import betweenness as bw
from cairn.operators import blocks, lineage


def parts(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    return len({root(n) for n in nodes})


def plain_cuts(edges):
    """By taking each link and each node away."""
    links = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    nodes = {n for e in links for n in e}
    n = parts(nodes, links)
    bridges = {e for e in links if parts(nodes, links - {e}) > n}
    points = {x for x in nodes if parts(nodes - {x}, {e for e in links if x not in e}) > n}
    return bridges, points


def random_graph(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


GRAPHS = {
    "tree, circle, clique and parts": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (9, 10), (10, 9), (11, 11), *combinations(range(20, 25), 2), (24, 30), (30, 31), (31, 32), (32, 30)],
    "random": random_graph(1, 60, 62) + [(100 + a, 100 + b) for a, b in random_graph(2, 40, 70)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_bridges_and_cut_points_equal_plain_ones(spark, name):
    edges = GRAPHS[name]
    named, _ = blocks.blocks(spark.createDataFrame(edges, "src long, dst long"))
    bridges, points = plain_cuts(edges)
    assert {tuple(r) for r in blocks.bridges_of(named).collect()} == bridges
    assert {r.id for r in blocks.cut_points_of(named).collect()} == points
    pre = sorted((r.pre, r["size"], r.id, r.parent) for r in named.collect())
    assert [p[0] for p in pre] == list(range(len(pre)))
    at = {i: (p, s) for p, s, i, _ in pre}
    assert all(at[q][0] < p and p + s <= at[q][0] + at[q][1] for p, s, _, q in pre if q is not None)


def test_no_links_no_blocks(spark):
    empty = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert blocks.bridges(empty).count() == 0 and blocks.cut_points(empty).count() == 0


def plain_betweenness(nodes, edges, sources):
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return {n: x / 2 * len(nodes) / max(1, len(sources)) for n, x in out.items()}


def test_betweenness_equals_a_plain_one(spark):
    edges = random_graph(4, 30, 45) + [(1, 1), (50, 51)]
    nodes = sorted({n for e in edges for n in e} | {99})
    df, links = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.betweenness for r in bw.betweenness(df, links).collect()}
    assert got == pytest.approx(plain_betweenness(nodes, edges, nodes))
    some = [n for n in nodes if n % 5 == 0]
    got = {r.id: r.betweenness for r in bw.betweenness(df, links, df.where("id % 5 = 0")).collect()}
    assert got == pytest.approx(plain_betweenness(nodes, edges, some))
    assert bw.betweenness(df.where("id < 0"), links.where("src < 0")).count() == 0


def test_chains_of_replacements(spark):
    rows = [(i, i + 1 if i < 99 else None, False) for i in range(100)]  # a long chain
    rows += [(200, 201, True), (201, 999, True), (202, 201, False), (203, None, False), (204, 204, False)]  # a tree to a retracted head, an unknown pointer, an orphan, itself
    rows += [(300, 301, False), (301, 302, False), (302, 300, False), (303, 301, False), (304, 303, False)]  # a circle and what leads into it
    rows += [(203, None, False), (None, 1, False)]  # a repeated row, no id
    places, chains = lineage.supersedence(spark.createDataFrame(rows, "id long, superseded_by long, retracted boolean"))
    got = {r.id: (r.head, r.hops, r.cycle) for r in places.collect()}
    assert len(got) == 110 and all(got[i] == (99, 99 - i, False) for i in range(100))
    assert (got[200], got[201], got[202], got[203], got[204]) == ((201, 1, False), (201, 0, False), (201, 1, False), (203, 0, False), (204, 0, False))
    assert [got[i] for i in range(300, 305)] == [(302, 2, True), (302, 1, True), (302, 0, True), (302, 2, True), (302, 3, True)]
    found = {r.head: (r.length, r.active_head, r.cycle) for r in chains.collect()}
    assert found == {99: (100, 99, False), 201: (3, None, False), 203: (1, 203, False), 204: (1, 204, False), 302: (5, 302, True)}
    places, chains = lineage.supersedence(spark.createDataFrame([], "id string, superseded_by string, retracted boolean"))
    assert places.count() == 0 and chains.count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_aliases_within_edits_lose_nothing(spark):
    from cairn.operators import aliases

    rnd = random.Random(12)
    keys = {"".join(rnd.choices("ab1", k=rnd.randint(1, 14))) for _ in range(250)} | {"a", "b" * 40}
    names = spark.createDataFrame([(i, k) for i, k in enumerate(sorted(keys))] + [(999, " A "), (7, None), (None, "x"), (8, "--")], "entity long, surface string")
    texts = sorted({k[:i] + rnd.choice(["", "a", "c"]) + k[i + rnd.randint(0, 1) :] for k in sorted(keys)[::3] for i in (0, len(k) // 2, len(k))} | {""})
    asked = spark.createDataFrame([*enumerate(texts), (10_000, texts[-1]), (10_001, None)], "query long, text string")
    known = aliases.index(names)
    for edits in (1, 2):
        got = {(r["query"], r.key): r.distance for r in aliases.within(known, asked, edits).collect()}
        want = {(q, k): d for q, t in [*enumerate(texts), (10_000, texts[-1])] for k in keys if (d := edit_distance(t, k)) <= edits}
        assert got == want
    best = {r["query"]: (r.distance, r.key) for r in aliases.resolved(known, asked).collect()}
    assert best == {q: min((d, k) for (p, k), d in want.items() if p == q) for q in {q for q, _ in want}}
    begin = {(r["query"], r.key) for r in aliases.beginning_with(known, asked).collect()}
    assert begin == {(q, k) for q, t in [*enumerate(texts), (10_000, texts[-1])] for k in keys if t and k.startswith(t)}
    assert {(r.key, r.entity) for r in known.where("key = 'a'").collect()} == {("a", sorted(keys).index("a"))}


def test_token_bucket(spark):
    from cairn.operators import records

    rows = [(u, i, t) for u in (1, None) for i, t in ((1, 0), (2, 0), (3, 1), (4, 20), (5, 21))] + [(1, 9, None)]
    df = spark.createDataFrame(rows, "u long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((str(r.u), r.i, r.admitted, round(r.left, 6)) for r in records.token_bucket(df, "u", "ts", "i", 2.0, 0.1).collect())
    one = [(1, True, 1.0), (2, True, 0.0), (3, False, 0.1), (4, True, 1.0), (5, True, 0.1)]
    assert got == sorted((u, *r) for u in ("1", "None") for r in one)
    with pytest.raises(ValueError):
        records.token_bucket(df, "u", "ts", "i", 0, 1)


def test_best_paths_equal_all_paths(spark):
    from cairn.operators import flow

    rnd = random.Random(21)
    edges = [(a, b, rnd.choice("xy"), rnd.choice([None, 0.2, 0.5, 0.9, 1.0])) for a, b in random_graph(22, 14, 60)] + [(1, 1, "x", 1.0)]
    pairs = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(12)] + [(3, 3), (1, 77), (2, 5), (2, 5)]

    def walk(path, types, f, target):
        if path[-1] == target:
            yield f, path, types
        elif len(types) < 4:
            for a, b, t, c in edges:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b], [*types, t], f * 0.8 * (0.8 if c is None else c), target)

    want = []
    for s, t in set(pairs):
        if s != t:
            best = sorted(walk([s], [], 1.0, t), key=lambda p: (-round(p[0], 12), len(p[1]), p[1], p[2]))[:3]
            want += [(s, t, i, p, k, pytest.approx(f)) for i, (f, p, k) in enumerate(best, 1)]
    df, asked = spark.createDataFrame(edges, "src long, dst long, type string, confidence double"), spark.createDataFrame(pairs, "source long, target long")
    got = flow.best_paths(df, asked, top=3, beam=1)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3]) and len(want) > 10
    one = spark.createDataFrame([(["a", "b"], ["T"])], "n array<string>, t array<string>").select(flow.linear(F.col("n"), F.col("t"))).first()[0]
    assert one == "a -[T]-> b"
    assert flow.best_paths(df.where("src < 0"), asked).count() == 0
