"""Fellegi-Sunter linkage against one that looks at every pair by itself."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.strings import jaro_winkler_of
from cairn.operators import linkage as link

SCHEMA = "id string, family string, initial string, mail string, orcid string"
MODEL = link.Model(
    comparisons=(link.exact("orcid"), link.jaro_winkler_at("family", (0.92, 0.85), tf=True), link.exact("initial"), link.exact("mail", tf=True)),
    rules=(("family", "initial"), ("orcid",)), deterministic=(("orcid",), ("family", "mail")), training=(("family",), ("initial",)),
)
NAMES = ["id", "family", "initial", "mail", "orcid"]


def people(copies=True):
    rnd, rows = random.Random(6), []
    families = ["ivanov", "smith", "muller", "garcia", "petrenko", "okafor", "tanaka"] + ["ivanova", "smyth", "garcía"]
    for i in range(60):
        person = [rnd.choice(families), rnd.choice("abcd"), rnd.choice(["x.org", "y.org", "z.org", None]), rnd.choice([None, f"o{i}"])]
        for _ in range(rnd.choice((1, 1, 2, 3))):
            own = [v if rnd.random() > 0.1 else None for v in person]
            if own[0] and rnd.random() < 0.2:
                own[0] = own[0][:-1] + rnd.choice("aeo")
            rows.append(own)
    if copies:
        rows += rows[:6] + rows[:3]
    rows = [(f"p{i:03d}", *r) for i, r in enumerate(rows)]
    return rows + [(None, "smith", "a", None, None)]


def plain(rows, recall=0.9, threshold=0.5):
    rows = [r for r in rows if r[0] is not None]
    kinds = {"orcid": 2, "family": 4, "initial": 2, "mail": 2}
    value = lambda r, n: r[NAMES.index(n)]

    def level(n, a, b):
        x, y = value(a, n), value(b, n)
        if x is None or y is None:
            return -1
        if n != "family":
            return int(x == y)
        j = jaro_winkler_of(x, y)
        return 3 if x == y else 2 if j >= 0.92 else 1 if j >= 0.85 else 0

    agree = lambda a, b, rule: all(value(a, n) is not None and value(a, n) == value(b, n) for n in rule)
    pairs = list(combinations(rows, 2))
    same = lambda a, b: a[1:] == b[1:]
    u = {}
    for n, k in kinds.items():
        got = Counter(level(n, a, b) for a, b in pairs if not same(a, b))
        u[n] = np.array([got[i] + 0.5 for i in range(k)])
        u[n] /= u[n].sum()
    prior = sum(any(agree(a, b, r) for r in MODEL.deterministic) for a, b in pairs) / recall / len(pairs)
    trained = {n: [] for n in kinds}
    for rule in MODEL.training:
        own = [(a, b) for a, b in pairs if agree(a, b, rule)]
        open_ = [n for n in kinds if n not in rule]
        levels = {n: np.array([level(n, a, b) for a, b in own]) for n in open_}
        m = {n: 10.0 ** np.arange(kinds[n]) / (10.0 ** np.arange(kinds[n])).sum() for n in open_}
        share = 0.5
        for _ in range(200):
            yes, no = np.full(len(own), share), np.full(len(own), 1 - share)
            for n in open_:
                known = levels[n] >= 0
                yes = np.where(known, yes * m[n][levels[n]], yes)
                no = np.where(known, no * u[n][levels[n]], no)
            p = yes / (yes + no)
            old = {n: v.copy() for n, v in m.items()} | {"share": share}
            for n in open_:
                got = np.array([p[levels[n] == k].sum() for k in range(kinds[n])])
                m[n] = np.maximum(got / got.sum(), 1e-9)
                m[n] /= m[n].sum()
            share = p.mean()
            if max(abs(share - old["share"]), *(np.abs(m[n] - old[n]).max() for n in open_)) < 1e-6:
                break
        for n in open_:
            trained[n].append(m[n])
    m = {n: np.mean(v, axis=0) for n, v in trained.items() if v}
    tf = {n: Counter(value(r, n) for r in rows if value(r, n) is not None) for n in ("family", "mail")}
    out = {}
    for a, b in pairs:
        if not any(agree(a, b, r) for r in MODEL.rules):
            continue
        w = math.log2(prior / (1 - prior))
        for n, k in kinds.items():
            g = level(n, a, b)
            if g < 0:
                continue
            below = tf[n][value(a, n)] / sum(tf[n].values()) if n in tf and g == k - 1 else u[n][g]
            w += math.log2(m[n][g] / below)
        if 1 / (1 + 2**-w) >= threshold:
            out[a[0], b[0]] = w
    return out, m, u, prior


def test_matches_equal_plain_ones(spark):
    rows = people(copies=False)
    rows = [r for i, r in enumerate(rows) if r[1:] not in {x[1:] for x in rows[:i]}]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("clash")).repartition(3)
    pairs, clusters, fitted = link.link(df, MODEL, "id")
    want, m, u, prior = plain(rows)
    got = {(r.left_id, r.right_id): r.weight for r in pairs.collect()}
    assert fitted.prior == pytest.approx(prior)
    for n in m:
        assert fitted.u[n] == pytest.approx(u[n]) and fitted.m[n] == pytest.approx(m[n], abs=1e-6)
    assert set(got) == set(want) and all(got[k] == pytest.approx(w, abs=1e-4) for k, w in want.items()) and len(got) > 8
    reach = {r[0]: {r[0]} for r in rows if r[0]}
    for a, b in want:
        joined = reach[a] | reach[b]
        for x in joined:
            reach[x] = joined
    assert {r.id: r.cluster for r in clusters.collect()} == {x: min(s) for x, s in reach.items()}


def test_copies_count_but_are_not_expanded(spark):
    rows = people()
    df = spark.createDataFrame(rows, SCHEMA)
    one, members = link.classes(df, MODEL, "id")
    assert one.count() < members.count() == len(rows) - 1
    levels = link.patterns(one, MODEL.comparisons, MODEL.rules).collect()
    real = [r for r in rows if r[0]]
    agree = lambda a, b, rule: all(a[NAMES.index(n)] is not None and a[NAMES.index(n)] == b[NAMES.index(n)] for n in rule)
    assert sum(r.pairs for r in levels) == sum(any(agree(a, b, r) for r in MODEL.rules) for a, b in combinations(real, 2))
    stats = {r["rule"]: r for r in link.blocking_stats(one, MODEL.rules).collect()}
    assert stats["orcid"]["pairs"] == sum(agree(a, b, ("orcid",)) for a, b in combinations(real, 2))
    _, clusters, _ = link.link(df, MODEL, "id")
    found = {r.id: r.cluster for r in clusters.collect()}
    by_row = {}
    for r in real:
        by_row.setdefault(r[1:], set()).add(found[r[0]])
    assert all(len(v) == 1 for v in by_row.values()) and len(found) == len(real)


def test_random_pairs_are_all_pairs_of_few_rows(spark):
    for n in (1, 2, 5, 6, 9):
        one, _ = link.classes(spark.createDataFrame([(f"p{i}", f"n{i}", "a", None, None) for i in range(n)], SCHEMA), MODEL, "id")
        got = [tuple(sorted((r.l_id, r.r_id))) for r in link.random_pairs(one, 500, 1).collect()]
        assert sorted(got) == sorted(combinations(sorted(f"p{i}" for i in range(n)), 2))


def test_decisions_and_empty_tables(spark):
    found = spark.createDataFrame([("a", "a", 0.96), ("b", "a", 0.96), ("c", "c", 0.93), ("d", "c", 0.93), ("e", "e", 0.8), ("f", "e", 0.8), ("g", "g", None), ("h", "h", 0.5), ("i", "h", 0.5)], "id string, cluster string, probability double")
    got = {r.cluster: (r.members, r.decision, r.blocked) for r in link.proposals(found, spark.createDataFrame([("b",)], "id string")).collect()}
    assert got == {"a": (2, "review_needed", True), "c": (2, "auto_merge", False), "e": (2, "review_needed", False), "h": (2, "separate", False)}
    strict = {r.cluster: r.decision for r in link.proposals(found, spark.createDataFrame([], "id string"), "Person").collect()}
    assert strict == {"a": "auto_merge", "c": "review_needed", "e": "review_needed", "h": "separate"}
    pairs, clusters, _ = link.link(spark.createDataFrame([], SCHEMA), MODEL, "id")
    assert pairs.count() == 0 and clusters.count() == 0


def test_jaro_winkler_by_its_known_values():
    for a, b, want in (("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("", "", 1.0), ("", "a", 0.0), ("abc", "xyz", 0.0)):
        assert jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-4)
