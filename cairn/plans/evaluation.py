"""Queries of evaluation metrics and statistics: labels against document features, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import half_up, r6
from ..functions.order import sums_in_order
from ..operators import evaluation as ev
from ..registry import query
from ..sources.tables import PLACE, RANKED_PARTS_SQL, placed, ranked_parts, read
from ..operators.fusion import with_rank


def rounded(df, *plain):
    return df.select(*plain, *(r6(F.col(c)).alias(c) for c in df.columns if c not in plain))


PAIRS = """pairs AS (SELECT doc_id, least(1.0, n_chars / 8000.0)::DOUBLE AS confidence, quality AS label FROM labels JOIN documents USING (doc_id))"""


def pairs(spark, sf):
    """A length-based guess at a document's quality, against its label."""
    both = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("confidence"), F.col("quality").alias("label"))


@query("retrieval_metrics", f"""WITH {RANKED_PARTS_SQL}, rk AS (SELECT query, id, rank1 FROM ranked WHERE source = 'revenue'), gold AS (SELECT query, id FROM ranked WHERE source = 'quantity' AND rank1 <= 15),
h AS (SELECT r.query, r.rank1 AS rank, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS hit, sum(CASE WHEN g.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.query ORDER BY r.rank1) AS upto FROM rk r LEFT JOIN gold g ON g.query = r.query AND g.id = r.id),
n AS (SELECT query, count(*) AS n FROM gold GROUP BY 1),
p AS (SELECT query, sum(hit) FILTER (rank <= 10) AS found, count(*) FILTER (rank <= 10) AS shown, min(CASE WHEN hit = 1 THEN rank END) AS best, sum(hit / log2(rank + 1.0)) FILTER (rank <= 10) AS dcg, sum(hit * upto::DOUBLE / rank) AS ap FROM h GROUP BY 1)
SELECT query, round(found::DOUBLE / n, 6) AS recall, round(found::DOUBLE / shown, 6) AS precision, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(1.0::DOUBLE / best, 0), 6) AS rr,
round(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg, round(ap / n, 6) AS ap FROM p JOIN n USING (query)""")
def _retrieval(spark, sf):
    runs = with_rank(ranked_parts(spark, sf))
    found = runs.where("source = 'revenue'").select("query", "id", F.col("rank1").alias("rank"))
    gold = runs.where("source = 'quantity' AND rank1 <= 15").select("query", "id")
    return rounded(ev.retrieval_metrics(found, gold, 10), "query", "hit")


@query("reliability_bins", f"""WITH {PAIRS} SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(label), 6) AS accuracy FROM pairs GROUP BY 1""")
def _bins(spark, sf):
    return rounded(ev.reliability(pairs(spark, sf)), "bin", "n")


@query("calibration", f"""WITH {PAIRS}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(label) AS a FROM pairs GROUP BY 1), t AS (SELECT sum(n) AS t, sum(n * a) / sum(n) AS base FROM b)
SELECT (SELECT t FROM t)::BIGINT AS n, round((SELECT avg((confidence - label) * (confidence - label)) FROM pairs), 6) AS brier, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS mce, round(sum(n * (a - c) * (a - c)) / sum(n), 6) AS reliability,
round(sum(n * (a - (SELECT base FROM t)) * (a - (SELECT base FROM t))) / sum(n), 6) AS resolution, round((SELECT base * (1 - base) FROM t), 6) AS uncertainty FROM b""")
def _calibration(spark, sf):
    return rounded(ev.calibration(pairs(spark, sf)), "n")


CURVE = f"""WITH {PAIRS}, s AS (SELECT confidence AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM pairs GROUP BY 1),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""


def scored(spark, sf):
    return pairs(spark, sf).withColumnRenamed("confidence", "score")


@query("auc", f"{CURVE} SELECT round(1 - sum(pos * fp - pos * neg / 2.0) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), 6) AS pr_auc FROM t")
def _auc(spark, sf):
    return rounded(ev.auc(scored(spark, sf)))


@query("threshold_sweep", f"{CURVE} SELECT round(score, 6) AS score, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall, round(2.0 * tp / (tp + fp + p), 6) AS f FROM t")
def _sweep(spark, sf):
    return rounded(ev.threshold_sweep(scored(spark, sf)))


@query("risk_coverage", f"""{CURVE} SELECT round(score, 6) AS confidence, round((tp + fp)::DOUBLE / (p + n), 6) AS coverage, round(fp::DOUBLE / (tp + fp), 6) AS risk FROM t""")
def _risk(spark, sf):
    rows = pairs(spark, sf).select("confidence", (F.col("label") == 1).alias("correct"))
    return rounded(ev.risk_coverage(rows))


@query("latency_percentiles", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.95), 6) AS nearest95,
round(avg(CASE WHEN value <= 90 THEN 1.0 ELSE 0.0 END), 6) AS within_slo FROM events GROUP BY 1""")
def _latency(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    t = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), q.alias("q"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("nearest95"), F.avg((F.col("value") <= 90).cast("double")).alias("within_slo"))
    return rounded(t.select("event_type", "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "nearest95", "within_slo"), "event_type", "n")


VERDICT = "CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'mid' ELSE 'high' END"


@query("verdict_confusion", """WITH p AS (SELECT l_returnflag AS gold, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS pred FROM lineitem),
g AS (SELECT gold AS label, count(*) AS g FROM p GROUP BY 1), q AS (SELECT pred AS label, count(*) AS p FROM p GROUP BY 1), h AS (SELECT gold AS label, count(*) AS tp FROM p WHERE gold = pred GROUP BY 1)
SELECT label, g AS support, round(tp::DOUBLE / p, 6) AS precision, round(tp::DOUBLE / g, 6) AS recall, round(2.0 * tp / (p + g), 6) AS f1 FROM g JOIN q USING (label) JOIN h USING (label)""")
def _confusion(spark, sf):
    p = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("gold"), F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 35, "N").otherwise("R").alias("pred"))
    return rounded(ev.confusion(p), "label", "support")


@query("cohen_kappa", """WITH p AS (SELECT quality AS a, CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*)::DOUBLE AS t, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS s FROM p),
x AS (SELECT sum(f.n * g.n) AS xy FROM (SELECT a AS l, count(*) AS n FROM p GROUP BY 1) f JOIN (SELECT b AS l, count(*) AS n FROM p GROUP BY 1) g USING (l)), k AS (SELECT s / t AS po, xy / (t * t) AS pe FROM n, x)
SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def _cohen(spark, sf):
    both = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(ev.cohen_kappa(both.select(F.col("quality").alias("a"), (F.col("n_chars") >= 600).cast("int").alias("b"))))


_LEVELS = {"l_quantity": (17, 34), "l_extendedprice": (20_000, 45_000), "l_discount": (0.03, 0.07)}
RATINGS = "s AS (SELECT l_orderkey * 8 + l_linenumber AS item, unnest([" + ", ".join(f"CASE WHEN {c} < {low} THEN 'low' WHEN {c} < {high} THEN 'mid' ELSE 'high' END" for c, (low, high) in _LEVELS.items()) + "]) AS label FROM lineitem)"


def ratings(spark, sf):
    """Every order line, rated by three raters: its quantity, its price and its discount."""
    said = [F.when(F.col(c) < low, "low").when(F.col(c) < high, "mid").otherwise("high") for c, (low, high) in _LEVELS.items()]
    return read(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.explode(F.array(*said)).alias("label"))


@query("fleiss_kappa", f"""WITH {RATINGS}, c AS (SELECT item, label, count(*) AS n FROM s GROUP BY 1, 2), i AS (SELECT item, (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1.0)) AS p FROM c GROUP BY 1),
q AS (SELECT sum(n)::DOUBLE / (SELECT count(*) FROM s) AS q FROM c GROUP BY label), k AS (SELECT (SELECT avg(p) FROM i) AS po, (SELECT sum(q * q) FROM q) AS pe) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def _fleiss(spark, sf):
    return rounded(ev.fleiss_kappa(ratings(spark, sf)))


@query("krippendorff_alpha", f"""WITH c AS (SELECT user_id AS item, {VERDICT} AS label, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM c), o AS (SELECT sum(n * (m - n) / (m - 1.0)) AS d, sum(n) AS t FROM m WHERE m > 1),
e AS (SELECT sum(n) * sum(n) - sum(n * n) AS d FROM (SELECT sum(n) AS n FROM m WHERE m > 1 GROUP BY label)) SELECT round(1 - o.d * (o.t - 1) / e.d, 6) AS alpha FROM o, e""")
def _krippendorff(spark, sf):
    """All events of every user, however many they have."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("item"), F.when(F.col("value") < 25, "low").when(F.col("value") < 75, "mid").otherwise("high").alias("label"))
    return rounded(ev.krippendorff(e))


SUPPLY = "p AS (SELECT s_nationkey AS g, s_suppkey AS id, round(s_acctbal, 0) AS x, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey)::DOUBLE AS y FROM supplier)"


def supply(spark, sf):
    n = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("y"))
    s = read(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.round("s_acctbal", 0).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


@query("spearman", f"""WITH {SUPPLY}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS b FROM p)
SELECT g, round(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0), 6) AS rho FROM r GROUP BY g""")
def _spearman(spark, sf):
    return rounded(ev.spearman(supply(spark, sf), ["g"]), "g")


@query("kendall_tau_a", f"WITH {SUPPLY} SELECT a.g, round(avg(sign((a.x - b.x) * (a.y - b.y))), 6) AS tau FROM p a JOIN p b ON a.g = b.g AND a.id < b.id GROUP BY a.g")
def _kendall(spark, sf):
    return rounded(ev.kendall(supply(spark, sf), ["g"]), "g")


@query("effect_sizes", """WITH v AS (SELECT c_mktsegment AS side, c_acctbal AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), a AS (SELECT value FROM v WHERE side = 'BUILDING'), b AS (SELECT value FROM v WHERE side = 'MACHINERY'),
m AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT avg(value) FROM a) AS ma, (SELECT avg(value) FROM b) AS mb, (SELECT var_samp(value) FROM a) AS va, (SELECT var_samp(value) FROM b) AS vb),
d AS (SELECT avg(sign(a.value - b.value)) AS delta FROM a, b)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d, round(delta, 6) AS cliffs_delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS band FROM m, d""")
def _effects(spark, sf):
    v = read(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.when(F.col("c_mktsegment") == "BUILDING", "a").otherwise("b").alias("side"), F.col("c_acctbal").alias("value"))
    return rounded(ev.effect_sizes(v), "band")


PVALUES = "v AS (SELECT p_brand AS id, 1.0 / (1 + sum(p_size) % 97) AS p FROM part GROUP BY 1)"


@query("multiple_comparison", f"""WITH {PVALUES}, i AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM v)
SELECT id, round(p, 6) AS p, round(least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)), 6) AS holm, round(least(1.0, min(m * p / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM i""")
def _multiple(spark, sf):
    p = read(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg((1.0 / (1 + F.sum("p_size") % 97)).alias("p"))
    return rounded(ev.adjusted(p), "id")


@query("pareto_frontier", """SELECT a.p_partkey AS id, a.p_retailprice AS cost, a.p_size AS quality FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""")
def _pareto(spark, sf):
    return ev.pareto(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("cost"), F.col("p_size").alias("quality")))


@query("win_rate_matrix", """WITH s AS (SELECT event_type AS system, user_id AS item, round(avg(value), 1) AS score FROM events GROUP BY 1, 2)
SELECT a.system, b.system AS opponent, count(*) AS n, round(avg(CASE WHEN a.score > b.score THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) FILTER (a.score = b.score) AS ties FROM s a JOIN s b ON a.item = b.item AND a.system <> b.system GROUP BY 1, 2""")
def _wins(spark, sf):
    rows = placed(spark, sf, "events").select(F.col("event_type").alias("system"), F.col("user_id").alias("item"), "value", *PLACE)
    s = sums_in_order(rows, ["system", "item"], "value", PLACE).select("system", "item", half_up(F.col("total") / F.col("n"), 1).alias("score"))
    return rounded(ev.win_rates(s), "system", "opponent", "n", "ties")


@query("bland_altman", """WITH d AS (SELECT l_extendedprice - l_quantity * p_retailprice AS d FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT count(*) AS n, round(avg(d), 3) AS bias, round(coalesce(stddev_samp(d), 0), 3) AS sd, round(avg(abs(d)), 3) AS mae, round(avg(CASE WHEN abs(d) <= 1000 THEN 1.0 ELSE 0.0 END), 3) AS within, round(avg(d) - 1.96 * stddev_samp(d), 3) AS low, round(avg(d) + 1.96 * stddev_samp(d), 3) AS high FROM d""")
def _bland(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    got = ev.bland_altman(both.select(F.col("l_extendedprice").alias("pred"), (F.col("l_quantity") * F.col("p_retailprice")).alias("gold")), 1000.0)
    return got.select("n", *(F.round(c, 3).alias(c) for c in got.columns if c != "n"))


@query("cluster_quality", """WITH k AS (SELECT c_custkey AS id, c_nationkey AS pred, c_mktsegment AS gold FROM customer), c AS (SELECT pred, gold, count(*) AS n FROM k GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER (PARTITION BY gold) AS g, max(n) OVER (PARTITION BY pred) AS top FROM c),
s AS (SELECT sum(n * n::DOUBLE / p) / sum(n) AS precision, sum(n * n::DOUBLE / g) / sum(n) AS recall, sum(top * n::DOUBLE / p) / sum(n) AS purity, sum(n * (n - 1) / 2.0) AS b FROM w),
x AS (SELECT sum(n * (n - 1) / 2.0) AS x FROM (SELECT count(*) AS n FROM k GROUP BY pred)), y AS (SELECT sum(n * (n - 1) / 2.0) AS y FROM (SELECT count(*) AS n FROM k GROUP BY gold))
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round(purity, 6) AS purity, round(b / x, 6) AS pair_precision, round(b / y, 6) AS pair_recall FROM s, x, y""")
def _clusters(spark, sf):
    k = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pred"), F.col("c_mktsegment").alias("gold"))
    return rounded(ev.b_cubed(k))
