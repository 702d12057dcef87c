"""Queries that compare systems and runs: events, orders and parts stand for answers, tests and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import judging as jd
from ..registry import query
from ..sources.tables import PLACE, RANKED_PARTS_SQL, placed, ranked_parts, read
from .evaluation import rounded


@query("signed_rank", """WITH d AS (SELECT round(l_quantity * 2 - l_extendedprice / 1500, 0) AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
s AS (SELECT sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS statistic FROM r)
SELECT *, round(least(1, 2 * (SELECT sum(exp(lgamma(positive + negative + 1) - lgamma(i + 1) - lgamma(positive + negative - i + 1) - (positive + negative) * ln(2))) FROM range(0, least(positive, negative) + 1) x(i))), 6) AS sign_p FROM s""")
def _signed(spark, sf):
    d = F.round(F.col("l_quantity") * 2 - F.col("l_extendedprice") / 1500, 0)
    got = jd.signed_rank(read(spark, sf, "lineitem").select(d.alias("a"), F.lit(0.0).alias("b")))
    return got.select(*(F.col(c).cast("double").alias(c) for c in ("w_plus", "w_minus")), "positive", "negative", F.col("statistic").cast("double").alias("statistic"), r6(F.col("sign_p")).alias("sign_p"))


@query("text_edit_distance", "WITH p AS (SELECT p_partkey AS id, p_name AS gold, p_type || substr(p_name, 3) AS pred FROM part) SELECT id, round(levenshtein(gold, pred)::DOUBLE / length(gold), 6) AS cer, round(1 - levenshtein(gold, pred)::DOUBLE / greatest(length(gold), length(pred)), 6) AS similarity FROM p")
def _edit(spark, sf):
    pairs = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("gold"), F.concat("p_type", F.expr("substr(p_name, 3)")).alias("pred"))
    return rounded(jd.edit_scores(pairs), "id")


@query("gap_ranking_eval", f"""WITH {RANKED_PARTS_SQL}, g AS (SELECT query, id, rank1 AS rank, id % 4 AS grade FROM ranked WHERE source = 'revenue'), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS best FROM g)
SELECT query, round(coalesce(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1.0) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN grade / log2(best + 1.0) ELSE 0 END), 0), 0), 6) AS ndcg FROM k GROUP BY 1""")
def _graded(spark, sf):
    from ..operators.fusion import with_rank

    r = with_rank(ranked_parts(spark, sf)).where("source = 'revenue'").select("query", "id", F.col("rank1").alias("rank"), (F.col("id") % 4).alias("grade"))
    return rounded(jd.graded_ndcg(r), "query")


@query("citation_check", "WITH c AS (SELECT l_orderkey AS answer, l_partkey + l_linenumber * 40 AS id FROM lineitem) SELECT answer, count(*) AS citations, count(*) FILTER (id NOT IN (SELECT p_partkey FROM part)) AS phantoms, round(count(*) FILTER (id NOT IN (SELECT p_partkey FROM part))::DOUBLE / count(*), 6) AS rate FROM c GROUP BY 1")
def _citations(spark, sf):
    cited = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), (F.col("l_partkey") + F.col("l_linenumber") * 40).alias("id"))
    return jd.phantoms(cited, read(spark, sf, "part").select(F.col("p_partkey").alias("id"))).withColumn("rate", r6(F.col("rate")))


@query("eval_diff", """WITH a AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS value FROM part WHERE p_partkey % 7 > 0), b AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE + (p_partkey % 5 - 2) / 60.0 AS value FROM part WHERE p_partkey % 5 > 0),
f AS (SELECT id, a.value AS old, b.value AS new FROM a FULL JOIN b USING (id)) SELECT id, round(old, 6) AS old, round(new, 6) AS new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN round(new - old, 9) > 0.02 THEN 'improved' WHEN round(new - old, 9) < -0.02 THEN 'regressed' ELSE 'same' END AS change FROM f""")
def _run_diff(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("value"))
    after = p.where("id % 5 > 0").withColumn("value", F.col("value") + (F.col("id") % 5 - 2) / 60.0)
    return rounded(jd.run_diff(p.where("id % 7 > 0"), after, "id"), "id", "change")


@query("flaky_tests", """WITH r AS (SELECT user_id, event_id, value > 30 AS passed FROM events), t AS (SELECT *, CAST(passed <> lag(passed) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS t FROM r),
g AS (SELECT user_id, count(*) AS runs, count(*) FILTER (passed) AS passes, sum(t)::BIGINT AS flips FROM t GROUP BY 1) SELECT *, round(flips::DOUBLE / (runs - 1), 6) AS flip_rate FROM g WHERE runs >= 3 AND passes > 0 AND passes < runs""")
def _flaky(spark, sf):
    runs = read(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 30).alias("passed"))
    return jd.flaky(runs, "user_id", "event_id").withColumn("flip_rate", r6(F.col("flip_rate")))


@query("kg_health_score", """WITH s AS (SELECT l_suppkey AS slice, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS orphan, avg(CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0 END) AS duplicate, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) AS stale FROM lineitem GROUP BY 1),
h AS (SELECT slice, 100 * (0.5 * (1 - orphan) + 0.3 * (1 - duplicate) + 0.2 * (1 - stale)) AS score FROM s) SELECT slice, round(score, 4) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM h""")
def _health(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    s = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("slice")).agg(share(F.col("l_returnflag") == "R").alias("orphan"), share(F.col("l_discount") > 0.08).alias("duplicate"), share(F.col("l_linestatus") == "F").alias("stale"))
    score, grade = jd.health({"orphan": (5.0, F.col("orphan")), "duplicate": (3.0, F.col("duplicate")), "stale": (2.0, F.col("stale"))})
    return s.select("slice", F.round(score, 4).alias("score"), grade.alias("grade"))


SIDES = """g AS (SELECT DISTINCT 'c' || o_custkey AS src, lower(o_orderpriority) AS relation, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < 5),
p AS (SELECT DISTINCT 'c' || o_custkey AS src, lower(o_orderpriority) AS relation, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 2)"""


@query("relation_triple_f1", f"""WITH {SIDES}, b AS (SELECT relation, g.src IS NOT NULL AS x, p.src IS NOT NULL AS y FROM (SELECT *, 1 AS i FROM g) g FULL JOIN (SELECT *, 1 AS i FROM p) p USING (src, relation, dst)),
b2 AS (SELECT relation, i = 1 AS x, j = 1 AS y FROM (SELECT *, 1 AS i FROM g) FULL JOIN (SELECT *, 1 AS j FROM p) USING (src, relation, dst)), r AS (SELECT unnest([relation, '*']) AS relation, coalesce(x, false) AS x, coalesce(y, false) AS y FROM b2),
s AS (SELECT relation, count(*) FILTER (x AND y)::DOUBLE AS tp, count(*) FILTER (x) AS g, count(*) FILTER (y) AS p FROM r GROUP BY 1) SELECT relation, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(g, 0), 0), 6) AS recall, round(2 * tp / (g + p), 6) AS f1 FROM s""".replace("""b AS (SELECT relation, g.src IS NOT NULL AS x, p.src IS NOT NULL AS y FROM (SELECT *, 1 AS i FROM g) g FULL JOIN (SELECT *, 1 AS i FROM p) p USING (src, relation, dst)),
""", ""))
def _triples(spark, sf):
    t = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.select("l_linenumber", F.concat(F.lit(" C"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return rounded(jd.triples(t.where("l_linenumber < 5"), t.where("l_linenumber > 2")), "relation")


@query("gap_metrics", """WITH g AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 > 0), p AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS id FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 4 > 0),
b AS (SELECT key, i = 1 AS x, j = 1 AS y FROM (SELECT *, 1 AS i FROM g) FULL JOIN (SELECT *, 1 AS j FROM p) USING (key, id)), s AS (SELECT key, count(*) FILTER (x AND y)::DOUBLE AS tp, count(*) FILTER (x) AS g, count(*) FILTER (y) AS p FROM b GROUP BY 1)
SELECT key, round(CASE WHEN p = 0 THEN CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END ELSE tp / p END, 6) AS precision, round(CASE WHEN g = 0 THEN 1.0 ELSE tp / g END, 6) AS recall FROM s""")
def _sets(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus")
    return rounded(jd.set_scores(lines.where("l_returnflag = 'A' AND key % 3 > 0"), lines.where("l_linestatus = 'F' AND key % 4 > 0"), "key"), "key")


@query("quality_gates", """WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), r(metric, low, high) AS (VALUES ('view', 40.0::DOUBLE, NULL::DOUBLE), ('purchase', NULL, 45.0), ('click', 10.0, 90.0), ('absent', 0.0, 1.0))
SELECT metric, round(value, 6) AS value, value IS NOT NULL AND coalesce(value >= low, true) AND coalesce(value <= high, true) AS kept FROM r LEFT JOIN m USING (metric)""")
def _gates(spark, sf):
    m = read(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    rules = spark.createDataFrame([("view", 40.0, None), ("purchase", None, 45.0), ("click", 10.0, 90.0), ("absent", 0.0, 1.0)], "metric string, low double, high double")
    return jd.gates(m, rules).withColumn("value", r6(F.col("value")))


@query("entity_linking_eval", """WITH r AS (SELECT l_orderkey AS mention, l_partkey AS id, l_linenumber AS rank FROM lineitem WHERE l_orderkey % 5 > 0), g AS (SELECT o_orderkey AS mention, CASE WHEN o_orderkey % 10 > 0 THEN (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) END AS gold FROM orders),
h AS (SELECT g.mention, gold, min(CASE WHEN id = gold THEN rank END) AS place, count(rank) AS n FROM g LEFT JOIN r ON r.mention = g.mention GROUP BY 1, 2), s AS (SELECT CASE WHEN gold IS NULL AND n = 0 THEN 1 WHEN gold IS NOT NULL THEN place END AS r FROM h)
SELECT round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM s""")
def _linking(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))
    first = lines.groupBy("mention").agg(F.min("id").alias("id"))
    gold = read(spark, sf, "orders").select(F.col("o_orderkey").alias("mention")).join(first, "mention", "left").select("mention", F.when(F.col("mention") % 10 > 0, F.col("id")).alias("id"))
    return rounded(jd.linking(lines.where("mention % 5 > 0"), gold, 3))


@query("active_learning_sample", """WITH r AS (SELECT event_id AS id, event_type, value / 100 AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(p - 0.5), id) AS place FROM r) SELECT id, event_type, round(p, 6) AS p, place FROM k WHERE place <= 25""")
def _sample(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("value") / 100).alias("p"))
    return jd.to_label(rows, "event_type", 25).select("id", "event_type", r6(F.col("p")).alias("p"), F.col("place").cast("long").alias("place"))


@query("cost_per_query", "WITH c AS (SELECT l_orderkey AS query, sum(l_tax * l_quantity) AS cost FROM lineitem GROUP BY 1) SELECT count(*) AS queries, round(avg(cost), 6) AS mean, round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95, count(*) FILTER (cost > 5) AS over FROM c")
def _costs(spark, sf):
    steps = placed(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_tax") * F.col("l_quantity")).alias("cost"), *PLACE)
    return rounded(jd.costs(steps, 5.0, PLACE), "queries", "over")


@query("abstention_score", """WITH a AS (SELECT user_id, value > 40 AS answered, event_type = 'view' AS correct FROM events), g AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (answered) AS a, count(*) FILTER (answered AND correct) AS c FROM a GROUP BY 1)
SELECT user_id, round(coalesce(c::DOUBLE / nullif(a, 0), 1), 6) AS precision, round(a / n, 6) AS coverage, round(c / n, 6) AS accuracy, round(coalesce(c::DOUBLE / nullif(a, 0), 1) * a / n, 6) AS score FROM g""")
def _abstention(spark, sf):
    a = read(spark, sf, "events").select("user_id", (F.col("value") > 40).alias("answered"), (F.col("event_type") == "view").alias("correct"))
    return rounded(jd.abstention(a, "user_id"), "user_id")


@query("token_bag_f1", """WITH g AS (SELECT l_orderkey AS id, l_suppkey % 7 AS token, count(*) AS g FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), p AS (SELECT l_orderkey AS id, l_partkey % 7 AS token, count(*) AS p FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2),
b AS (SELECT id, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (id, token)) SELECT id, round(2.0 * sum(least(g, p)) / (sum(g) + sum(p)), 6) AS f1 FROM b GROUP BY 1""")
def _bags(spark, sf):
    lines = read(spark, sf, "lineitem")
    of = lambda where, c: lines.where(where).select(F.col("l_orderkey").alias("id"), (F.col(c) % 7).alias("token"))
    return rounded(jd.bag_overlap(of("l_linenumber < 4", "l_suppkey"), of("l_linenumber > 1", "l_partkey")), "id")


@query("input_robustness", """WITH s AS (SELECT p_type AS kind, p_size - 3.0::DOUBLE AS clean, p_size - 5.0 + p_partkey % 4 AS changed FROM part), l AS (SELECT kind, CASE WHEN clean > 0 THEN (clean - changed) / clean ELSE 0 END AS l FROM s) SELECT kind, round(avg(l), 6) AS mean, round(max(l), 6) AS worst, count(*) FILTER (l > 0) AS worse FROM l GROUP BY 1""")
def _robust(spark, sf):
    s = read(spark, sf, "part").select(F.col("p_type").alias("kind"), (F.col("p_size") - 3.0).alias("clean"), (F.col("p_size") - 5.0 + F.col("p_partkey") % 4).alias("changed"))
    return rounded(jd.degradation(s, "kind"), "kind", "worse")
