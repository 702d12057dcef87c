"""Edge cases: ties, empty and flat inputs, nulls, zero denominators."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import order
from cairn.operators import absence, evaluation, fusion, gaps, graph, judging, records, rerank, retrieval, structure
from cairn.streaming import events as stream_events

RUNS = "query string, source string, source_pos int, id long, score double"


def test_flat_runs(spark):
    runs = spark.createDataFrame([("q", "a", 0, 1, 2.0), ("q", "a", 0, 2, 2.0)], RUNS)
    got = {r.id: r for r in fusion.normalised(runs).collect()}
    assert (got[1].minmax, got[1].z, got[1].softmax) == (0.0, 0.0, 0.5)
    assert {r.fused for r in fusion.dbsf(runs).collect()} == {0.5}
    assert {r.comb_sum for r in fusion.comb(runs).collect()} == {0.0}


def test_rank_bases(spark):
    runs = spark.createDataFrame([("q", "a", 0, 1, 2.0)], RUNS)
    assert fusion.rrf(runs).first().fused == 1 / 61
    assert fusion.rrf(runs, base=0).first().fused == 1 / 60


def test_null_keys_are_not_capped(spark):
    hits = spark.createDataFrame([("q", i, 1.0, None) for i in range(5)] + [("q", 9, 0.5, "k"), ("q", 10, 0.4, "k"), ("q", 11, 0.3, "k")], "query string, id long, score double, key string")
    assert sorted(r.id for r in fusion.diversify(hits, "key").collect()) == [0, 1, 2, 3, 4, 9, 10]


def test_empty_inputs(spark):
    runs = spark.createDataFrame([], RUNS)
    assert fusion.rrf(runs).count() == fusion.condorcet(runs).count() == fusion.autocut(runs).count() == 0
    assert graph.components(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_wilson_without_trials(spark):
    low, high = absence.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)


def test_components_of_a_chain_and_loops(spark):
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(70)], "id string")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(39)] + [("050", "050"), ("060", "061"), ("061", "060")], "src string, dst string")
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(40))
    assert got["050"] == "050" and got["061"] == "060" and len(got) == 70


def test_retrieval_without_relevant(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 2, 3)], "query string, id long, rank long")
    none = spark.createDataFrame([], "query string, id long")
    got = evaluation.retrieval_metrics(ranked, none, 2).first()
    assert (got["recall"], got["ndcg"], got["ap"]) == (1.0, 0.0, 0.0)
    got = evaluation.retrieval_metrics(ranked, spark.createDataFrame([("q", 2)], "query string, id long"), 2).first()
    assert (got["recall"], got["rr"]) == (1.0, 0.5)  # a repeated id takes one place


def test_packing_passes_over(spark):
    hits = spark.createDataFrame([("q", 1, 3.0, 60), ("q", 2, 2.0, 50), ("q", 3, 1.0, 40)], "query string, id long, score double, tokens long")
    assert [r.id for r in records.pack(hits, 100).orderBy("place").collect()] == [1, 3]


def test_upsert_keeps_old_where_null(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = records.upsert(base, spark.createDataFrame([(2, None), (3, "c")], "k long, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_cosine_of_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert row.select(retrieval.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def plain_cores(n, links):
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(n)}
    core = {}
    for k in itertools.count():
        while low := [i for i in near if len(near[i]) <= k]:
            for i in low:
                core[i] = k
                for j in near.pop(i):
                    if j in near:
                        near[j].discard(i)
        if not near:
            return core


@pytest.mark.parametrize("seed", [1, 2])
def test_core_numbers_equal_peeling(spark, seed):
    rnd = random.Random(seed)
    links = [(a, b) for a in range(30) for b in range(a) if rnd.random() < (0.5 if a < 12 else 0.08)] + [(31, 30), (32, 31), (33, 32)]
    nodes = spark.createDataFrame([(i,) for i in range(36)], "id long")
    got = {r.id: r.core for r in graph.core_numbers(nodes, spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == plain_cores(36, links)


def test_autocut_of_flat_and_short_lists(spark):
    rows = [("flat", i, 1.0) for i in range(4)] + [("two", i, 9.0 - i) for i in range(2)] + [("late", i, s) for i, s in enumerate([10.0, 4.0, 3.9, 3.8, 1.0])]
    df = spark.createDataFrame(rows, "query string, id long, score double")
    kept = lambda k: {q: sum(r.keep_gap for r in fusion.autocut(df, min_keep=k).collect() if r["query"] == q) for q in ("flat", "two", "late")}
    assert kept(1) == {"flat": 1, "two": 1, "late": 1}
    assert kept(2) == {"flat": 2, "two": 2, "late": 4}


def test_linear_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        fusion.weighted_sum(spark.createDataFrame([("q", "a", 0, 1, 2.0)], RUNS), {"a": 0.5})


def test_frequent_words_count_a_little(spark):
    docs = spark.createDataFrame([(i, f"the cat x{i} y{i}" if i else "the dog ran") for i in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the dog"), (2, "the"), (3, "zebra")], "query long, text string")
    got = {(r["query"], r.id): r.score for r in retrieval.bm25(docs, asked).collect()}
    assert set(got) == {(1, i) for i in range(6)} | {(2, i) for i in range(6)} and max(got, key=lambda k: got[k] * (k[0] == 1)) == (1, 0)


def test_bm25_equals_a_plain_sum(spark):
    import math

    rnd = random.Random(4)
    texts = [" ".join(rnd.choices([f"w{int(rnd.paretovariate(0.6))}" for _ in range(30)], k=rnd.randint(1, 40))) for _ in range(300)]
    queries = {q: " ".join(rnd.choices(texts[q].split() + ["w1", "w1", "w2"], k=12)) for q in range(20)}
    tok = [t.split() for t in texts]
    df = {}
    for t in tok:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(300 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    mean = sum(map(len, tok)) / 300
    want = {}
    for q, text in queries.items():
        s = [(-round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split()), 6), i) for i, t in enumerate(tok)]
        want[q] = [i for x, i in sorted(s)[:5] if x < 0]
    got = retrieval.bm25(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(queries.items()), "query long, text string"), top=5).collect()
    assert {q: [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] for q in queries} == want


def test_nearest_in_blocks(spark):
    rnd = random.Random(5)
    v = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    q = df.where("id % 10 = 0").select(F.col("id").alias("query"), "v")
    one, many = (sorted(map(tuple, retrieval.nearest(df, q, top=3, block=b).select("query", "id", "rank").collect())) for b in (4096, 7))
    assert one == many and len(one) == 21


def test_cover_has_no_silent_end(spark):
    offers = spark.createDataFrame([("a", 1, 1.0, 5.0), ("a", 2, 1.0, 5.0), ("b", 2, 0.1, 5.0), ("c", 3, 9.0, 1.0)] + [(f"z{i}", 10 + i, 1.0, 1.0) for i in range(8)], "candidate string, gap long, cost double, weight double")
    plan = rerank.set_cover(offers).orderBy("place").collect()
    assert [r.candidate for r in plan] == ["b", "a", *(f"z{i}" for i in range(8)), "c"] and plan[-1].covered == 1.0
    part = rerank.set_cover(offers, most=2)
    assert sorted(r.gap for r in rerank.uncovered(offers, part).collect()) == [3, *range(10, 18)]
    assert rerank.set_cover(offers.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rerank.set_cover(offers.withColumn("cost", F.lit(0.0)))


def test_sums_over_an_order(spark):
    rows = [(float(i * 7 % 101), i) for i in range(101)]
    got = {r.v: r.upto_n for r in order.cumulative(spark.createDataFrame(rows, "v double, n long").repartition(5), "v", ["n"]).collect()}
    total, want = 0, {}
    for v, n in sorted(rows):
        total += n
        want[v] = total
    assert got == want


def test_closure_of_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "id long, parent long")
    assert structure.closure(chain).count() == 66
    # a circle of three, one that leads into it, its own parent, and a chain that has nothing to do with them
    odd = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (7, 7), (20, 21), (21, 22), (22, None)], "id long, parent long")
    assert sorted(map(tuple, structure.closure(odd).collect())) == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2), (9, 1, 1), (9, 2, 2), (9, 3, 3), (20, 21, 1), (20, 22, 2), (21, 22, 1)]
    assert structure.closure(odd.where("id < 0")).count() == 0


def test_verdicts_in_order(spark):
    cells = spark.createDataFrame([(1, 1, 0, True), (1, 0, 0, False), (0, 0, 2, True), (0, 0, 0, True), (0, 0, 0, False)], "active long, valued long, retracted long, mentioned boolean")
    assert [r.verdict for r in gaps.verdicts(cells).collect()] == ["present", "covered", "retracted", "possible_miss", "abstain"]


def test_signed_rank_without_differences(spark):
    same = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert judging.signed_rank(same).first()["positive"] == 0


def test_streams_of_many_files_lose_nothing(spark, tmp_path):
    """Files in no order of time, more than a batch would once take."""
    rows = [(i, f"2024-01-{1 + i * 7 % 28:02d} 0{i % 10}:00:00", i % 3, "view", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    source = stream_events.source(spark, f"{tmp_path}/events.parquet")
    got = stream_events.settle(stream_events.first_seen(source.select("user_id", "event_type", "ts"), ["user_id", "event_type"]), "append")
    assert got.count() == df.select("user_id", "event_type", "ts").distinct().count()
    admitted = stream_events.rate_limited(stream_events.source(spark, f"{tmp_path}/events.parquet"))
    assert admitted.count() == 200


def plain_limit(rows, most=3, seconds=86_400):
    """rows of (user, event, seconds), in order of time."""
    times, admitted = {}, {}
    for user, event, t in sorted(rows, key=lambda r: (r[2], r[1])):
        own = [x for x in times.get(user, []) if t - x < seconds]
        admitted[event] = len(own) < most
        times[user] = [*own, t] if admitted[event] else own
    return admitted


def written_events(spark, path, rows, files):
    """Files of events, in the order of rows."""
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz")).drop("s")
    df.coalesce(1).write.option("maxRecordsPerFile", max(1, -(-len(rows) // files))).parquet(path)
    return path


def test_rate_limit_of_one_user_with_very_many_events_in_reverse(spark, tmp_path):
    rows = [(1, i, i) for i in range(25_000)][::-1]
    got = {r.event_id: r.admitted for r in stream_events.rate_limited(stream_events.source(spark, written_events(spark, f"{tmp_path}/e.parquet", rows, 1))).collect()}
    assert got == plain_limit(rows) and sum(got.values()) == 3


def test_rate_limit_over_batches_in_order_of_time(spark, tmp_path):
    """Batches of two files: what is within the delay is held back, and state passes from batch to batch."""
    rnd = random.Random(3)
    rows = sorted(((rnd.choice([1, 2, 3, None]), i, i * 4000 + rnd.randrange(20_000)) for i in range(400)), key=lambda r: r[2] + rnd.randrange(40_000))
    source = stream_events.source(spark, written_events(spark, f"{tmp_path}/e.parquet", rows, 8), files=2)
    got = {r.event_id: r.admitted for r in stream_events.rate_limited(source, delay=86_400).collect()}
    assert got == plain_limit(rows) and 0 < sum(got.values()) < 400


def test_rate_limit_leaves_late_rows_out(spark, tmp_path):
    rows = [(1, i, 1_000_000 + i) for i in range(4)] + [(1, 9, 5)]  # the last comes in a batch of its own, long after its time
    source = stream_events.source(spark, written_events(spark, f"{tmp_path}/e.parquet", rows, 2), files=1)
    got = {r.event_id: r.admitted for r in stream_events.rate_limited(source, delay=0).collect()}
    assert set(got) == {0, 1, 2, 3} or 9 in got and len(got) == 5


def test_folded_keeps_one_state_for_null_keys(spark):
    big = 2**60 + 1
    rows = [(None, 1), (None, 2), (None, 3), (5, 1), (big, 1), (big, 2)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = order.folded(df, ["k"], ["v"], "k long, v long, n long", lambda: 0, lambda s, r: (s + 1, (r[0], r[1], s + 1))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, 1), (None, 2, 2), (None, 3, 3), (5, 1, 1), (big, 1, 1), (big, 2, 2)], key=repr)
    none = order.folded(df.where("v > 9"), ["k"], ["v"], "k long, v long", lambda: 0, lambda s, r: (s, r))
    assert none.collect() == []


def test_triage_of_every_status(spark):
    cells = spark.createDataFrame([(1, "covered", None), (2, " Confident_Absence ", None), (3, None, "POSSIBLE_ABSENCE"), (4, "retracted", "COVERED"), (5, "odd", None), (6, None, None), (7, "", "retracted"), (8, "UNKNOWN", None)], "id long, status string, verdict string")
    got = {r.id: r.action for r in gaps.triage(cells).collect()}
    assert got == {1: "SKIP", 2: "INVESTIGATE", 3: "EXTRACT_MORE", 4: "REVIEW_RETRACTION", 5: "SKIP", 6: "SKIP", 7: "REVIEW_RETRACTION", 8: "SKIP"}
    assert {r.action: r.n for r in gaps.triage_board(cells).collect()} == {"INVESTIGATE": 1, "EXTRACT_MORE": 1, "REVIEW_RETRACTION": 2, "SKIP": 4}
    assert [r.id for r in gaps.triage_shortlist(cells, ["id"], 5).collect()] == [2, 3] and gaps.triage_shortlist(cells, ["id"], 0).count() == 0
    assert {r.n for r in gaps.triage_board(cells.where("id < 0")).collect()} == {0}


def test_priors_go_by_rank_then_arrival(spark):
    rows = [("a", 0.5, "heuristic", False, 1), ("a", 0.9, "gold_calibrated", False, 2), ("a", 0.6, "gold_calibrated", False, 3), ("b", 0.2, "heuristic", True, 1), ("b", 0.3, "gold_calibrated", False, 2), ("c", 0.1, None, None, 2), ("c", 0.3, "other", None, 1)]
    got = {r.context: (r.recall, r.source, r.calibrated, r.conflict, r["rank"]) for r in gaps.fuse_priors(spark.createDataFrame(rows, "context string, recall double, method string, calibrated boolean, at long")).collect()}
    assert got == {"a": (0.9, "gold_calibrated", False, True, 3), "b": (0.2, "heuristic", True, False, 11), "c": (0.3, "other", False, False, 0)}


def test_sign_test_is_exact(spark):
    from math import comb

    for pos, neg in ((0, 0), (5, 0), (3, 7), (20, 20), (60, 40)):
        pairs = spark.createDataFrame([(1.0, 0.0)] * pos + [(0.0, 1.0)] * neg + [(1.0, 1.0)], "a double, b double")
        n = pos + neg
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(pos, neg) + 1)) / 2**n) if n else 1.0
        assert judging.signed_rank(pairs).first()["sign_p"] == pytest.approx(want)
