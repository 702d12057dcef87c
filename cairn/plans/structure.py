"""Queries of graph structure: audits, projections, communities, merges, deletions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import r6
from ..operators import graph as g
from ..operators import structure as st
from ..registry import query
from ..sources.tables import GRAPH_SQL, _name, graph, named, number, read
from .graph import BOTH

HOME = "member AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
TRADE = "trade AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
PAIRS = f"{HOME}, {TRADE}, p AS (SELECT src, dst, a.community AS x, b.community AS y FROM trade JOIN member a ON a.id = src JOIN member b ON b.id = dst)"


def home(spark, sf, key=_name):
    """Customers and suppliers in the community of their nation."""
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    one = lambda t, p, k, n: t.select(key(p, k).alias("id"), F.concat(F.lit("n"), n).alias("community"))
    return one(c, "c", "c_custkey", "c_nationkey").unionByName(one(s, "s", "s_suppkey", "s_nationkey"))


def trade(spark, sf, key=_name):
    """Who buys from whom, with the quantity."""
    both = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(key("c", "o_custkey").alias("src"), key("s", "l_suppkey").alias("dst"), "l_quantity")


@query("graph_stats", f"WITH {GRAPH_SQL}, n AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges) SELECT nodes, edges, round(2.0 * edges / nodes, 6) AS mean_degree, round(edges::DOUBLE / (nodes * (nodes - 1)), 8) AS density FROM n")
def _stats(spark, sf):
    return st.graph_stats(*graph(spark, sf)).select("nodes", "edges", r6(F.col("mean_degree")).alias("mean_degree"), F.round("density", 8).alias("density"))


@query("rel_type_stats", f"WITH {GRAPH_SQL} SELECT type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY 1")
def _types(spark, sf):
    return st.shares(graph(spark, sf)[1], "type").withColumn("share", r6(F.col("share")))


@query("edge_signature_audit", f"WITH {GRAPH_SQL} SELECT a.label AS src_label, type, b.label AS dst_label, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE (a.label, type, b.label) NOT IN (('orders', 'placed_by', 'customer'), ('part', 'supplied_by', 'supplier'), ('customer', 'in_nation', 'nation')) GROUP BY 1, 2, 3")
def _signatures(spark, sf):
    nodes, edges = graph(spark, sf)
    allowed = spark.createDataFrame([("orders", "placed_by", "customer"), ("part", "supplied_by", "supplier"), ("customer", "in_nation", "nation")], "src_label string, type string, dst_label string")
    return st.off_schema(nodes, edges, allowed)


@query("cardinality_audit", f"""WITH {GRAPH_SQL}, c AS (SELECT id, label, 'contains' AS type, (SELECT count(*) FROM edges e WHERE e.src = id AND e.type = 'contains') AS n FROM nodes WHERE label = 'orders' UNION ALL
SELECT id, label, 'supplied_by', (SELECT count(*) FROM edges e WHERE e.src = id AND e.type = 'supplied_by') FROM nodes WHERE label = 'part') SELECT * FROM c WHERE label = 'orders' AND (n < 2 OR n > 5) OR label = 'part' AND n < 3""")
def _cardinality(spark, sf):
    rules = spark.createDataFrame([("orders", "contains", 2, 5), ("part", "supplied_by", 3, None)], "label string, type string, low long, high long")
    return st.cardinality(*graph(spark, sf), rules)


PROJECTED = "w AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, sum(l_quantity) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("weighted_projection", f"WITH {PROJECTED} SELECT a, b, round(weight, 4) AS weight FROM w")
def _projection(spark, sf):
    return st.weighted_projection(trade(spark, sf), "l_quantity").withColumn("weight", F.round("weight", 4))


@query("node_strength", f"WITH {PROJECTED} SELECT id, round(sum(weight), 4) AS strength, count(*) AS neighbours FROM (SELECT a AS id, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY 1")
def _strength(spark, sf):
    return st.strength(st.weighted_projection(trade(spark, sf), "l_quantity")).withColumn("strength", F.round("strength", 4))


@query("community_boundary", f"""WITH {PAIRS}, d AS (SELECT src AS id, x AS own, y AS other FROM p UNION ALL SELECT dst, y, x FROM p)
SELECT id, own, count(*) FILTER (own = other) AS inside, count(*) FILTER (own <> other) AS outside, array_to_string(list_sort(list_distinct(list(other) FILTER (own <> other))), ',') AS others FROM d GROUP BY 1, 2 HAVING count(*) FILTER (own <> other) > 0""")
def _boundary(spark, sf):
    return st.boundary(trade(spark, sf, number), home(spark, sf, number)).select(named("id"), "own", "inside", "outside", "others")


@query("community_merge_candidates", f"""WITH {PAIRS}, c AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p GROUP BY 1, 2), i AS (SELECT a AS c, n FROM c WHERE a = b),
k AS (SELECT c.a, c.b, c.n AS "cross", c.n::DOUBLE / (c.n + coalesce(u.n, 0) + coalesce(v.n, 0)) AS cohesion FROM c LEFT JOIN i u ON u.c = c.a LEFT JOIN i v ON v.c = c.b WHERE c.a <> c.b) SELECT a, b, "cross", round(cohesion, 6) AS cohesion FROM k WHERE cohesion >= 0.5""")
def _candidates(spark, sf):
    return st.merge_candidates(trade(spark, sf), home(spark, sf)).withColumn("cohesion", r6(F.col("cohesion")))


@query("community_metrics", f"WITH {HOME}, s AS (SELECT count(*) AS n FROM member GROUP BY community) SELECT count(*) AS communities, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, round(sum((n::DOUBLE / (SELECT sum(n) FROM s)) ** 2), 6) AS concentration FROM s")
def _metrics(spark, sf):
    return st.community_metrics(home(spark, sf)).withColumn("concentration", r6(F.col("concentration")))


@query("community_labels", f"""WITH {HOME}, {TRADE}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1),
k AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM member JOIN d USING (id)) SELECT community, string_agg(id, ', ' ORDER BY k) AS names FROM k WHERE k <= 3 GROUP BY 1""")
def _names(spark, sf):
    member, edges = home(spark, sf), trade(spark, sf)
    return st.top_members(member, g.degrees(member, edges))


@query("detach_delete", f"WITH {GRAPH_SQL}, gone AS (SELECT id FROM nodes WHERE label = 'supplier' AND id LIKE '%1') SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def _detach(spark, sf):
    nodes, edges = graph(spark, sf)
    return st.detach(nodes, edges, nodes.where("label = 'supplier' AND id LIKE '%1'"))[1]


@query("merge_relink", f"""WITH {GRAPH_SQL}, m AS (SELECT 'c' || c_custkey AS id, 'c' || (c_custkey - c_custkey % 3) AS canonical FROM customer WHERE c_custkey % 3 > 0)
SELECT DISTINCT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, type FROM edges LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE coalesce(a.canonical, src) <> coalesce(b.canonical, dst)""")
def _relink(spark, sf):
    merged = read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical"))
    return st.relink(graph(spark, sf)[1], merged)


@query("symmetric_edges", f"WITH {GRAPH_SQL} SELECT DISTINCT CASE WHEN type = 'contains' THEN least(src, dst) ELSE src END AS src, CASE WHEN type = 'contains' THEN greatest(src, dst) ELSE dst END AS dst, type FROM (SELECT * FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE type = 'contains')")
def _symmetric(spark, sf):
    _, e = graph(spark, sf)
    return st.symmetric(e.unionByName(e.where("type = 'contains'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")), ["contains"])


@query("degree_distribution", f"WITH {BOTH}, d AS (SELECT id, count(l.src) AS degree FROM nodes LEFT JOIN links l ON l.src = id GROUP BY 1) SELECT degree, count(*) AS nodes FROM d GROUP BY 1")
def _distribution(spark, sf):
    return st.histogram_of_degrees(g.degrees(*graph(spark, sf)))


@query("minimap", """WITH b AS (SELECT min(o_totalprice) AS x0, max(o_totalprice) AS x1, min(o_custkey) AS y0, max(o_custkey) AS y1 FROM orders)
SELECT least(9, floor((o_totalprice - x0) / (x1 - x0) * 10))::BIGINT AS "column", least(9, floor((o_custkey - y0)::DOUBLE / (y1 - y0) * 10))::BIGINT AS "row", count(*) AS n FROM orders, b GROUP BY 1, 2""")
def _minimap(spark, sf):
    return st.minimap(read(spark, sf, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y")))


@query("ego_subgraph", f"""WITH {BOTH}, k AS (SELECT 's1' AS id UNION SELECT dst FROM links WHERE src = 's1' UNION SELECT b.dst FROM links a JOIN links b ON b.src = a.dst WHERE a.src = 's1') SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def _ego(spark, sf):
    nodes, edges = graph(spark, sf)
    return st.induced(edges, g.k_hop(edges, nodes.where("id = 's1'"), 2)).select("src", "dst", "type")


@query("expand_merge", "WITH a AS (SELECT c_custkey AS id, c_name AS name, 'kept' AS origin FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, upper(c_name) AS name, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def _expand(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return st.first_wins(c.where("id % 2 = 0").withColumn("origin", F.lit("kept")), c.where("id % 3 = 0").select("id", F.upper("name").alias("name"), F.lit("new").alias("origin")))


@query("centrality_ensemble", f"""WITH {PROJECTED}, s AS (SELECT id, count(*) AS degree, sum(weight) AS strength FROM (SELECT a AS id, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY 1)
SELECT id, round(((degree - min(degree) OVER ())::DOUBLE / (max(degree) OVER () - min(degree) OVER ()) + (strength - min(strength) OVER ()) / (max(strength) OVER () - min(strength) OVER ())) / 2, 6) AS centrality FROM s""")
def _ensemble(spark, sf):
    s = st.strength(st.weighted_projection(trade(spark, sf), "l_quantity"))
    return st.ensemble(s, ["neighbours", "strength"]).withColumn("centrality", r6(F.col("centrality")))


@query("path_ranking", """WITH p AS (SELECT o_orderkey AS id, count(*) AS hops, sum(l_linenumber % 3) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT id, hops, evidence, round(0.5 / (1 + hops) + 0.5 * evidence / (1 + evidence), 6) AS score FROM p) SELECT *, row_number() OVER (ORDER BY score DESC, hops, evidence DESC, id) AS place FROM s ORDER BY place LIMIT 100""")
def _ranking(spark, sf):
    p = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("hops"), F.sum(F.col("l_linenumber") % 3).alias("evidence"))
    top = p.withColumn("score", r6(st.path_score(F.col("hops"), F.col("evidence")))).orderBy(F.desc("score"), "hops", F.desc("evidence"), "id").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "hops", F.desc("evidence"), "id"))
    return top.withColumn("place", place.cast("long"))


@query("ancestors", """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1), a(id, ancestor, hops) AS (SELECT id, parent, 1::BIGINT FROM p UNION ALL SELECT a.id, p.parent, a.hops + 1 FROM a JOIN p ON p.id = a.ancestor) SELECT id, ancestor, hops FROM a""")
def _ancestors(spark, sf):
    """A binary tree over customers: everything above each."""
    return st.closure(read(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("parent")))
