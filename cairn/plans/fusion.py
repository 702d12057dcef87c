"""Queries of rank fusion, over parts ranked within their brand by revenue, quantity and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import fusion
from ..registry import query
from ..sources.tables import RANKED_PARTS_SQL, ranked_parts, read

WITH = f"WITH {RANKED_PARTS_SQL}"
WEIGHTS = {"revenue": 0.5, "quantity": 0.3, "orders": 0.2}
WEIGHT_SQL = "CASE source WHEN 'revenue' THEN 0.5 WHEN 'quantity' THEN 0.3 ELSE 0.2 END"
MINMAX_SQL = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END"
SCALED = f"{WITH}, scaled AS (SELECT *, {MINMAX_SQL} AS x FROM runs WINDOW w AS (PARTITION BY query, source))"


@query("rrf_fuse_1based", f"{WITH} SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank1)), 6) AS fused FROM ranked GROUP BY query, id")
def _rrf(spark, sf):
    return fusion.rrf(ranked_parts(spark, sf)).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("hybrid_rrf_0based", f"{WITH} SELECT query, id, round(sum(1.0::DOUBLE / (59 + rank1)), 6) AS fused FROM ranked WHERE source <> 'orders' GROUP BY query, id")
def _hybrid(spark, sf):
    return fusion.rrf(ranked_parts(spark, sf).where("source <> 'orders'"), base=0).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("weighted_rrf", f"{WITH} SELECT query, id, round(sum(({WEIGHT_SQL})::DOUBLE / (59 + rank1)), 6) AS fused FROM ranked GROUP BY query, id")
def _weighted(spark, sf):
    return fusion.rrf(ranked_parts(spark, sf), base=0, weights=WEIGHTS).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("borda", f"{WITH}, p AS (SELECT *, count(*) OVER (PARTITION BY query, source) - rank1 + 1 AS points FROM ranked) SELECT query, id, round(sum(points)::DOUBLE, 6) AS fused FROM p GROUP BY query, id")
def _borda(spark, sf):
    return fusion.borda(ranked_parts(spark, sf)).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("weighted_borda", f"{WITH}, p AS (SELECT *, (count(*) OVER (PARTITION BY query, source) - rank1 + 1) * ({WEIGHT_SQL})::DOUBLE AS points FROM ranked) SELECT query, id, round(sum(points), 6) AS fused FROM p GROUP BY query, id")
def _weighted_borda(spark, sf):
    return fusion.borda(ranked_parts(spark, sf), WEIGHTS).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("condorcet", f"""{WITH}, m AS (SELECT a.query, a.id, b.id AS other, sum(CASE WHEN a.rank1 < b.rank1 THEN 1 ELSE -1 END) AS margin
FROM ranked a JOIN ranked b ON a.query = b.query AND a.source = b.source AND a.id <> b.id GROUP BY 1, 2, 3)
SELECT query, id, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses FROM m GROUP BY query, id""")
def _condorcet(spark, sf):
    return fusion.condorcet(ranked_parts(spark, sf))


@query("comb_fuse", f"{SCALED} SELECT query, id, round(sum(x), 6) AS comb_sum, round(sum(x) * count(*), 6) AS comb_mnz, round(sum(x) / count(*), 6) AS comb_anz, round(median(x), 6) AS comb_med FROM scaled GROUP BY query, id")
def _comb(spark, sf):
    got = fusion.comb(ranked_parts(spark, sf))
    return got.select("query", "id", *(r6(F.col(c)).alias(c) for c in ("comb_sum", "comb_mnz", "comb_anz", "comb_med")))


@query("dbsf", f"""{WITH}, m AS (SELECT *, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM runs WINDOW w AS (PARTITION BY query, source))
SELECT query, id, round(sum(CASE WHEN sd > 0 THEN greatest(0.0, least(1.0, (score - mu + 3 * sd) / (6 * sd))) ELSE 0.5 END), 6) AS fused FROM m GROUP BY query, id""")
def _dbsf(spark, sf):
    return fusion.dbsf(ranked_parts(spark, sf)).select("query", "id", r6(F.col("fused")).alias("fused"))


@query("score_normalisation", f"""{WITH}, m AS (SELECT *, {MINMAX_SQL} AS mm, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd, exp((score - max(score) OVER w) / 100.0) AS e FROM runs WINDOW w AS (PARTITION BY query, source))
SELECT query, source, id, round(mm, 6) AS minmax, round(CASE WHEN sd > 0 THEN (score - mu) / sd ELSE 0.0 END, 6) AS z, round(e / sum(e) OVER (PARTITION BY query, source), 6) AS softmax FROM m""")
def _normalise(spark, sf):
    got = fusion.normalised(ranked_parts(spark, sf), temperature=100.0)
    return got.select("query", "source", "id", *(r6(F.col(c)).alias(c) for c in ("minmax", "z", "softmax")))


@query("fusion_contribution", f"""{WITH}, p AS (SELECT query, id, source, ({WEIGHT_SQL})::DOUBLE * score AS part FROM runs), f AS (SELECT *, sum(part) OVER (PARTITION BY query, id) AS fused FROM p)
SELECT query, id, source, round(part, 6) AS part, round(fused, 6) AS fused, round(CASE WHEN fused <> 0 THEN part / fused ELSE 0.0 END, 6) AS share FROM f""")
def _contribution(spark, sf):
    got = fusion.weighted_sum(ranked_parts(spark, sf), WEIGHTS)
    return got.select("query", "id", "source", *(r6(F.col(c)).alias(c) for c in ("part", "fused", "share")))


@query("autocut", f"""{WITH}, r AS (SELECT query, id, score, rank1, score - lead(score) OVER (PARTITION BY query ORDER BY score DESC, id) AS gap FROM ranked WHERE source = 'quantity'),
c AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, count(*) OVER (PARTITION BY query) AS n, max(CASE WHEN rank1 >= 3 THEN gap END) OVER (PARTITION BY query) AS top_gap FROM r),
d AS (SELECT *, coalesce(min(CASE WHEN gap = top_gap AND rank1 >= 3 THEN rank1 END) OVER (PARTITION BY query), n) AS cut FROM c)
SELECT query, id, score, rank1 AS rank, rank1 <= cut AS keep_gap, score >= 0.5 * top OR rank1 <= 3 AS keep_ratio FROM d""")
def _autocut(spark, sf):
    runs = ranked_parts(spark, sf).where("source = 'quantity'").select("query", "id", "score")
    return fusion.autocut(runs, min_keep=3).withColumn("rank", F.col("rank").cast("long"))


@query("round_robin", f"""{WITH}, f AS (SELECT query, id, min(rank1 * 10 + source_pos) AS spot FROM ranked GROUP BY query, id)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY spot, id) AS place FROM f""")
def _robin(spark, sf):
    return fusion.round_robin(ranked_parts(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("diversify", """WITH h AS (SELECT p_brand AS query, p_partkey AS id, p_retailprice AS score, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS kind FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS k FROM h),
p AS (SELECT query, id, score, kind, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM n WHERE kind IS NULL OR k <= 2) SELECT * FROM p WHERE place <= 20""")
def _diversify(spark, sf):
    hits = read(spark, sf, "part").select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.when(F.col("p_size") <= 40, F.col("p_type")).alias("kind"))
    return fusion.diversify(hits, "kind").withColumn("place", F.col("place").cast("long"))


@query("lost_in_middle", """WITH r AS (SELECT p_brand AS query, p_partkey AS id, p_retailprice AS score, row_number() OVER w AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))
SELECT query, id, score, rank, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END AS place FROM r""")
def _fold(spark, sf):
    hits = read(spark, sf, "part").select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return fusion.fold_order(hits).withColumn("rank", F.col("rank").cast("long"))


@query("mcda_score", """WITH m AS (SELECT s_suppkey AS alternative, s_acctbal AS a, count(*)::DOUBLE AS n, avg(l_discount) AS d FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),
x AS (SELECT alternative, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 0.5 + (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) * 0.3 + (max(d) OVER () - d) / (max(d) OVER () - min(d) OVER ()) * 0.2 AS score FROM m)
SELECT alternative, round(score, 6) AS score FROM x""")
def _mcda(spark, sf):
    sold = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("lines"), F.avg("l_discount").alias("discount"))
    wide = read(spark, sf, "supplier").join(sold, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("alternative"), F.col("s_acctbal").alias("balance"), "lines", "discount")
    long = wide.unpivot("alternative", ["balance", "lines", "discount"], "criterion", "value")
    got = fusion.mcda(long, {"balance": (0.5, True), "lines": (0.3, True), "discount": (0.2, False)})
    return got.select("alternative", r6(F.col("score")).alias("score"))


@query("team_draft", f"""WITH RECURSIVE {RANKED_PARTS_SQL}, l AS MATERIALIZED (SELECT query, source, id, rank1 FROM ranked WHERE source <> 'orders' AND rank1 <= 30),
d(query, turn, taken) AS (SELECT DISTINCT query, 0::BIGINT, []::BIGINT[] FROM l UNION ALL SELECT query, turn + 1, list_append(taken, (SELECT l.id FROM l WHERE l.query = d.query AND l.source = CASE WHEN d.turn % 2 = 0 THEN 'revenue' ELSE 'quantity' END AND NOT list_contains(d.taken, l.id) ORDER BY rank1 LIMIT 1))
FROM d WHERE turn < 120), e AS (SELECT query, list_last(taken) AS id, CASE WHEN turn % 2 = 1 THEN 'revenue' ELSE 'quantity' END AS source, turn FROM (SELECT query, turn, taken, taken[-1] AS x FROM d WHERE turn > 0) WHERE x IS NOT NULL)
SELECT query, id, source, row_number() OVER (PARTITION BY query ORDER BY turn) AS place FROM e""".replace("list_last(taken)", "taken[-1]"))
def _team(spark, sf):
    runs = fusion.with_rank(ranked_parts(spark, sf)).where("rank1 <= 30").drop("rank1")
    return fusion.team_draft(runs, "revenue", "quantity")
