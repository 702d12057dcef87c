"""One test for each step that the last findings of round 3 on growth were mended by."""

from __future__ import annotations

import random

from cairn.operators import flow, graph, retrieval, structure
from cairn.operators import linkage as link

from .test_operators import plain_cores
from .test_round_three_more import jobs_of


def test_core_numbers_settle_within_blocks_and_across_them(spark):
    """a path of 60 nodes took a round, with two jobs, for each step from its ends; now what lies in one block settles in one round."""
    path = [(i, i + 1) for i in range(59)]
    got, jobs = jobs_of(spark, lambda: {r.id: r.core for r in graph.core_numbers(None, spark.createDataFrame(path, "src long, dst long")).collect()})
    assert got == dict.fromkeys(range(60), 1) and 0 < jobs < 30
    rnd = random.Random(3)
    links = [(a, b) for a in range(30) for b in range(a) if rnd.random() < (0.6 if a < 12 else 0.1)]
    want = {f"n{i}": k for i, k in plain_cores(30, links).items() if any(i in e for e in links)}
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links + [(b, a) for a, b in links[:5]] + [(1, 1)]], "src string, dst string")
    assert {r.id: r.core for r in graph.core_numbers(None, named, block=20, least=1).collect()} == want


def test_large_blocks_are_cut_into_parts_and_equal_columns_are_not_compared(spark):
    """A block's pairs were one task's, and all of them went through Python, alike or not."""
    rows = [(i, 1, "same head", f"tail {i % 3}", i % 7) for i in range(60)] + [(90, 1, None, "tail 1", 2), (91, 1, "other", None, 2)]
    one = spark.createDataFrame(rows, "id long, copies long, head string, tail string, n long")
    seen = (link.jaro_winkler_at("head"), link.within("n", (0.1,)))
    got = link.rule_pairs(one, (("head",),), seen, most=50)
    assert "jaro" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    assert sorted((r.l_id, r.r_id) for r in got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert {r.g_head for r in got} == {3} and all((r.g_n == 2) == (r.l_n == r.r_n) for r in got)
    both = link.rule_pairs(one, (("head",), ("tail",)), seen, most=50).collect()
    assert len(both) == 60 * 59 // 2 + 20 and {r.g_head for r in both if r.rule == 1} == {-1}


def test_links_between_communities_are_dealt_once(spark):
    """each link was shuffled in both directions, and again for each end's community."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (3, 4), (1, 4)], "src long, dst long")
    member = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, community string")
    for got, want in (
        (structure.boundary(edges, member), [(1, "a", 1, 1, "b"), (2, "a", 1, 1, "b"), (3, "b", 1, 1, "a"), (4, "b", 1, 1, "a")]),
        (graph.modularity(edges, member).select("community", "inside", "cut", "conductance", "modularity"), [("a", 1, 2, 0.5, 0.0), ("b", 1, 2, 0.5, 0.0)]),
    ):
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_paths_follow_only_edges_that_sources_reach(spark):
    """what can be handed on was worked out for all nodes, whether a source reaches them or not."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (8, 3), (9, 8)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert sorted(tuple(r) for r in flow._onward(edges, start, 3).collect()) == [(1, 2), (2, 3), (3, 1), (3, 4)]


def test_best_sums_keep_each_querys_best_and_no_pair_is_a_row(spark):
    """every document that shares a word with a query was a row of a hash table."""
    rnd = random.Random(5)
    post = [(i, t, rnd.choice([0.25, 0.5])) for i in range(40) for t in "abcde" if rnd.random() < 0.6]
    asked = [(q, t, w) for q, words in enumerate(("ab", "bcd", "e")) for w, t in zip((1.0, 2.0, -3.0), words)]
    want = []
    for q in range(3):
        weight = {t: w for p, t, w in asked if p == q}
        sums = {}
        for i, t, x in post:
            if t in weight:
                sums[i] = sums.get(i, 0.0) + weight[t] * x
        best = sorted((-round(v, 6), i) for i, v in sums.items() if v > 0)[:4]
        want += [(q, i, -v, k) for k, (v, i) in enumerate(best, 1)]
    got = retrieval.best_sums(spark.createDataFrame(post, "id long, term string, part double"), spark.createDataFrame(asked, "query long, term string, weight double"), 4, block=3)
    assert sorted((r["query"], r["id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == sorted(want)
