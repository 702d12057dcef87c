"""Queries of blocks, betweenness, communities, chains, calibrators, resampling and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import r6
from ..operators import betweenness as bw
from ..operators import aliases, blocks, calibrators, clusters, flow, lineage, louvain, records, resampling
from ..registry import query
from ..sources.tables import GRAPH_SQL, graph, named, number, read, spelled
from .evaluation import PAIRS, pairs
from .graph import BOTH


@query("cut_points")
def _cut_points(spark, sf):
    return blocks.cut_points(graph(spark, sf, numbers=True, once=False)[1]).select(named("id"))


@query("bridges")
def _bridges(spark, sf):
    return blocks.bridges(graph(spark, sf, numbers=True, once=False)[1]).select(named("a"), named("b"))


def _betweenness_sql(depth: int) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS paths FROM nodes WHERE label = 'region')"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{i}" for i in range(max(0, k - 2), k))
        steps.append(f"l{k} AS MATERIALIZED (SELECT s, dst AS v, sum(paths) AS paths FROM l{k - 1} JOIN links ON src = v WHERE (s, dst) NOT IN (SELECT (s, v) FROM ({seen})) GROUP BY 1, 2)")
    steps.append(f"b{depth} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS share FROM l{depth})")
    for k in range(depth - 1, 0, -1):
        steps.append(f"b{k} AS MATERIALIZED (SELECT l.s, l.v, l.paths, l.paths * coalesce(each, 0) AS share FROM l{k} l LEFT JOIN (SELECT s, dst AS v, sum((1 + share) / paths) AS each FROM b{k + 1} JOIN links ON src = v GROUP BY 1, 2) g USING (s, v))")
    every = " UNION ALL ".join(f"SELECT v, share FROM b{k}" for k in range(1, depth + 1))
    return f"WITH {BOTH}, {', '.join(steps)} SELECT id, round(coalesce(sum(share), 0) * (SELECT count(*) FROM nodes) / 5 / 2, 3) AS betweenness FROM nodes LEFT JOIN ({every}) t ON v = id GROUP BY id"


@query("betweenness", _betweenness_sql(8))
def _betweenness(spark, sf):
    """Sampled: the five regions are the sources."""
    nodes, edges = graph(spark, sf, numbers=True, once=False)
    return bw.betweenness(nodes, edges, nodes.where("label = 'region'")).select(named("id"), F.round("betweenness", 3).alias("betweenness"))


@query("community_hierarchy")
def _hierarchy(spark, sf):
    return louvain.louvain(*graph(spark, sf, numbers=True), spell=spelled()).levels.select("level", named("id"), named("community"))


def _replaced(spark, sf):
    """An order is replaced by its customer's next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("superseded_by"), (F.col("o_orderstatus") == "F").alias("retracted"))


_CHAINS = "o AS (SELECT o_orderkey AS id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS hops, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM orders)"


@query("supersedence_places", f"WITH {_CHAINS} SELECT id, head, hops, false AS cycle FROM o")
def _places(spark, sf):
    return lineage.supersedence(_replaced(spark, sf))[0]


@query("supersedence_chains", f"WITH {_CHAINS} SELECT head, count(*) AS length, CASE WHEN bool_or(s = 'F' AND id = head) THEN NULL ELSE head END AS active_head, false AS cycle FROM o GROUP BY head")
def _chains(spark, sf):
    return lineage.supersedence(_replaced(spark, sf))[1]


@query("histogram_calibration", f"WITH {PAIRS} SELECT i / 10.0::DOUBLE AS low, coalesce(round(avg(label), 6), 0) AS value FROM range(10) r(i) LEFT JOIN pairs ON least(floor(confidence * 10), 9) = i GROUP BY i")
def _histogram(spark, sf):
    return calibrators.histogram_bins(pairs(spark, sf)).withColumn("value", r6(F.col("value")))


@query("isotonic_calibration", f"""WITH {PAIRS}, s AS (SELECT confidence AS x, sum(label) AS p, count(*) AS n, row_number() OVER (ORDER BY confidence) AS i FROM pairs GROUP BY 1), c AS MATERIALIZED (SELECT i, x, sum(p) OVER (ORDER BY i) AS p, sum(n) OVER (ORDER BY i) AS n, p AS p0, n AS n0 FROM s),
m AS MATERIALIZED (SELECT a.i AS a, b.i AS b, (b.p - a.p + a.p0)::DOUBLE / (b.n - a.n + a.n0) AS v FROM c a JOIN c b ON a.i <= b.i), g AS MATERIALIZED (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m), f AS (SELECT b AS i, max(v) AS v FROM g GROUP BY b)
SELECT min(x) AS low, max(x) AS high, sum(n0)::BIGINT AS n, round(v, 6) AS value FROM f JOIN c USING (i) GROUP BY v""")
def _isotonic(spark, sf):
    return calibrators.isotonic(pairs(spark, sf)).withColumn("value", r6(F.col("value")))


@query("platt_calibration")
def _platt(spark, sf):
    """Every labelled document's confidence through the sigmoid."""
    p = pairs(spark, sf)
    a, b = calibrators.platt(p)
    return p.select("doc_id", "confidence", r6(1 / (1 + F.exp(-(F.lit(a) * F.col("confidence") + b)))).alias("calibrated"))


@query("permutation_test")
def _permutation(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return resampling.permutation(line, ["l_orderkey", "l_linenumber"], replicates=1_000)


@query("bootstrap_interval")
def _bootstrap(spark, sf):
    return resampling.bootstrap(read(spark, sf, "orders"), ["o_orderkey"], "o_totalprice", replicates=500)


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("topic_map")
def _topics(spark, sf):
    rows = clusters.whole(_vectors(spark, sf), unit=True)
    centres, _ = clusters.kmeans(rows, 10)
    labels = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return clusters.topic_map(clusters.assigned(rows, centres).select("id", "list", "distance"), labels).withColumns({"share": r6(F.col("share")), "mean_distance": r6(F.col("mean_distance"))})


@query("inverted_file_topk")
def _inverted(spark, sf):
    """Every hundredth vector against all, by the lists that are nearest to it. These vectors are all but even in direction, so most lists are met for a recall of 0.9."""
    v = _vectors(spark, sf)
    got = clusters.inverted_file_search(v, v.where("id % 100 = 0").withColumnRenamed("id", "query"), lists=16, probes=13)
    return got.select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


_NAMES = """k AS (SELECT min(p_partkey) AS entity, key FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part) GROUP BY key),
q AS (SELECT p_partkey AS query, regexp_replace(regexp_replace(lower(substr(p_name, 1 + p_size % 3) || ' ' || p_brand), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS text FROM part WHERE p_partkey % 100 = 0)"""


def _names(spark, sf):
    """Parts' names with their brands, and every hundredth of them without its first letters."""
    part = read(spark, sf, "part")
    name = lambda n: F.concat(n, F.lit(" "), F.col("p_brand"))
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query"), name(F.expr("substr(p_name, 1 + p_size % 3)")).alias("text"))
    return aliases.index(part.select(F.col("p_partkey").alias("entity"), name(F.col("p_name")).alias("surface"))), asked


@query("alias_within", f"WITH {_NAMES} SELECT query, key, entity, levenshtein(text, key) AS distance FROM q JOIN k ON levenshtein(text, key) <= 2")
def _within(spark, sf):
    return aliases.within(*_names(spark, sf))


@query("alias_resolved", f"WITH {_NAMES} SELECT query, key, entity, levenshtein(text, key) AS distance FROM q JOIN k ON levenshtein(text, key) <= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY levenshtein(text, key), key) = 1")
def _resolved(spark, sf):
    return aliases.resolved(*_names(spark, sf))


@query("alias_prefix", f"WITH {_NAMES} SELECT query, key, entity FROM (SELECT query, substr(text, 1, 1 + query % 6) AS text FROM q) JOIN k ON starts_with(key, text)")
def _prefix(spark, sf):
    known, asked = _names(spark, sf)
    short = F.substring(aliases.canonical_key(F.col("text")), F.lit(1), (1 + F.col("query") % 6).cast("int"))
    return aliases.beginning_with(known, asked.withColumn("text", short))


@query("token_bucket", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r(user_id, k, event_id, t, has) AS (SELECT user_id, k, event_id, t, 2.0::DOUBLE FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.k, e.event_id, e.t, least(2.0, r.has - CASE WHEN r.has >= 1 THEN 1 ELSE 0 END + (e.t - r.t) / 1000000.0::DOUBLE * 0.00001::DOUBLE) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, has >= 1 AS admitted, round(has - CASE WHEN has >= 1 THEN 1 ELSE 0 END, 6) AS "left" FROM r""")
def _bucket(spark, sf):
    return records.token_bucket(read(spark, sf, "events"), "user_id", "ts", "event_id", 2.0, 0.00001).withColumn("left", r6(F.col("left")))


@query("path_flow", f"""WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT src, dst, type, CASE WHEN type = 'contains' THEN 0.5::DOUBLE ELSE 0.8 END * 0.8 AS w FROM edges), p(source, nodes, types, flow) AS (SELECT id, [id], CAST([] AS VARCHAR[]), 1.0::DOUBLE FROM nodes WHERE id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0) UNION ALL
SELECT source, list_append(nodes, dst), list_append(types, type), flow * w FROM p JOIN e ON src = nodes[-1] WHERE len(types) < 4 AND NOT list_contains(nodes, dst)), k AS (SELECT p.*, h.target, row_number() OVER (PARTITION BY source, h.target ORDER BY round(flow, 12) DESC, len(nodes), nodes, types) AS rank FROM p JOIN (SELECT 'o' || o_orderkey AS source, 'r' || n_regionkey AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) h USING (source) WHERE nodes[-1] = h.target)
SELECT source, target, rank, nodes[1] || array_to_string(list_transform(range(1, len(types) + 1), lambda i: ' -[' || types[i] || ']-> ' || nodes[i + 1]), '') AS path, round(flow, 6) AS flow FROM k WHERE rank <= 3""")
def _flow(spark, sf):
    """The three best paths from every hundredth order to its customer's region."""
    _, edges = graph(spark, sf, numbers=True)
    rated = edges.withColumn("confidence", F.when(F.col("type") == "contains", 0.5))
    home = read(spark, sf, "orders").where("o_orderkey % 100 = 0").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs_ = home.select(number("o", "o_orderkey").alias("source"), number("r", "n_regionkey").alias("target"))
    got = flow.best_paths(rated, pairs_, most=4, top=3).withColumn("nodes", F.transform("nodes", named))
    return got.select(named("source"), named("target"), F.col("rank").cast("long").alias("rank"), flow.linear(F.col("nodes"), F.col("types")).alias("path"), r6(F.col("flow")).alias("flow"))
