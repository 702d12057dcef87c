"""Queries of graph patterns and algorithms over the trade tables as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..functions.storage import spread
from ..operators import graph as g
from ..registry import query
from ..sources.tables import GRAPH_SQL, graph, named, number, read

BOTH = f"{GRAPH_SQL}, links AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"


def unrolled(first: str, step, rounds: int) -> str:
    """CTEs t0, t1, ... of a table and what each round makes of the one before."""
    return ", ".join([f"t0 AS MATERIALIZED ({first})", *(f"t{i + 1} AS MATERIALIZED ({step(f't{i}')})" for i in range(rounds))])


@query("degree", f"WITH {BOTH}, d AS (SELECT src AS id, count(*) AS degree FROM links GROUP BY 1) SELECT id, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (id)")
def _degree(spark, sf):
    return g.degrees(*graph(spark, sf))


KINDS = ["contains", "in_nation", "in_region", "placed_by", "supplied_by"]
_COUNTS = ", ".join(f"count(*) FILTER (way = '{w}' AND type = '{k}') AS {w}_{k}" for w in ("out", "in") for k in KINDS)


@query("typed_degree", f"WITH {GRAPH_SQL}, ends AS (SELECT src AS id, 'out' AS way, type FROM edges UNION ALL SELECT dst, 'in', type FROM edges) SELECT id, {_COUNTS}, count(*) FILTER (way = 'out') AS total_out, count(*) FILTER (way = 'in') AS total_in FROM ends GROUP BY 1")
def _typed(spark, sf):
    got = g.typed_degrees(graph(spark, sf, numbers=True)[1], KINDS)
    return got.select(named("id"), *(c for c in got.columns if c != "id"))


@query("k_hop", f"""WITH {BOTH}, h1 AS (SELECT DISTINCT dst AS id FROM links WHERE src = 'n1'), h2 AS (SELECT DISTINCT l.dst AS id FROM h1 JOIN links l ON l.src = h1.id WHERE l.dst <> 'n1' AND l.dst NOT IN (SELECT id FROM h1))
SELECT 'n1' AS seed, 'n1' AS id, 0 AS hops UNION ALL SELECT 'n1', id, 1 FROM h1 UNION ALL SELECT 'n1', id, 2 FROM h2""")
def _hops(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.k_hop(edges, nodes.where("id = 'n1'"), 2)


@query("two_hop_pattern", f"""WITH {GRAPH_SQL} SELECT c.dst AS nation, p.dst AS supplier, count(*) AS paths FROM edges o JOIN edges c ON c.src = o.dst AND c.type = 'in_nation' JOIN edges k ON k.src = o.src AND k.type = 'contains' JOIN edges p ON p.src = k.dst AND p.type = 'supplied_by' WHERE o.type = 'placed_by' GROUP BY 1, 2""")
def _pattern(spark, sf):
    """Nation of the customer and supplier of a part, through each order."""
    _, e = graph(spark, sf)
    of = lambda kind, a, b: e.where(F.col("type") == kind).select(F.col("src").alias(a), F.col("dst").alias(b))
    placed, home, holds, made = of("placed_by", "o", "c"), of("in_nation", "c", "nation"), of("contains", "o", "p"), of("supplied_by", "p", "supplier")
    nations = placed.join(home, "c").groupBy("o", "nation").agg(F.count("*").alias("k"))
    sold = holds.join(nations, "o").groupBy("p", "nation").agg(F.sum("k").alias("k"))  # a part has many orders and few nations
    return sold.join(made, "p").groupBy("nation", "supplier").agg(F.sum("k").alias("paths"))


_NEAREST = unrolled("SELECT id, id AS c FROM nodes", lambda t: f"SELECT n.id, least(n.c, coalesce(m.c, n.c)) AS c FROM {t} n LEFT JOIN (SELECT src, min(c) AS c FROM links JOIN {t} ON id = dst GROUP BY 1) m ON m.src = n.id", 14)


@query("components", f"WITH {BOTH}, {_NEAREST} SELECT id, c AS component FROM t14")
def _components(spark, sf):
    return g.components(*graph(spark, sf, numbers=True, once=False)).select(named("id"), named("component"))


def _pagerank_sql(start: str, rounds: int) -> str:
    """The first of so many rounds that changes the ranks by less than a millionth for each node."""
    step = lambda t: f"""SELECT b.id, 0.15 * b.weight + 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(r.rank), 0) FROM {t} r WHERE r.id NOT IN (SELECT src FROM o)) * b.weight) AS rank
FROM base b LEFT JOIN (SELECT l.dst, sum(r.rank / o.n) AS got FROM edges l JOIN o USING (src) JOIN {t} r ON r.id = l.src GROUP BY 1) s ON s.dst = b.id"""  # noqa: E731
    ends = " UNION ALL ".join(f"SELECT {i} AS k, (SELECT sum(abs(a.rank - b.rank)) FROM t{i} a JOIN t{i - 1} b USING (id)) AS err" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT id, round(rank, 8) AS rank FROM t{i}, k WHERE k.k = {i}" for i in range(1, rounds + 1))
    return f"WITH {GRAPH_SQL}, o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), base AS (SELECT id, {start} AS weight FROM nodes), {unrolled('SELECT id, weight AS rank FROM base', step, rounds)}, k AS (SELECT min(k) AS k FROM ({ends}) WHERE err < (SELECT count(*) FROM nodes) * 1e-6) {every}"


def _pagerank_limit_sql(rounds: int) -> str:
    """What walks of each length bring, up to so many steps, scaled to 1: the limit of PageRank's rounds. 0.85 to the 142nd is 1e-10."""
    step = lambda t: f"SELECT s.dst AS id, sum(0.85 * s.share * r.rank) AS rank FROM share s JOIN {t} r ON r.id = s.src GROUP BY 1"
    every = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(rounds + 1))
    return f"""WITH {GRAPH_SQL}, o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / n AS share FROM edges JOIN o USING (src) WHERE dst IN (SELECT id FROM nodes)),
{unrolled("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes", step, rounds)}, y AS MATERIALIZED ({every}) SELECT id, round(sum(rank) / (SELECT sum(rank) FROM y), 8) AS rank FROM y GROUP BY 1"""


@query("pagerank", _pagerank_limit_sql(142))
def _pagerank(spark, sf):
    """Ranks sum to 1, so a tolerance for each node would end after fewer rounds the larger the graph is, and after one from two million nodes on."""
    return g.pagerank_limit(*graph(spark, sf)).select("id", F.round("rank", 8).alias("rank"))


@query("personalised_pagerank", _pagerank_sql("CASE WHEN id = 'c1' THEN 1.0::DOUBLE ELSE 0 END", 60))
def _ppr(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.pagerank(nodes, edges, start=nodes.where("id = 'c1'").select("id", F.lit(1.0).alias("weight"))).select("id", F.round("rank", 8).alias("rank"))


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS hub FROM nodes)"]
    for i in range(1, rounds + 1):
        steps += [
            f"x{i} AS MATERIALIZED (SELECT n.id, coalesce(v, 0) AS v FROM nodes n LEFT JOIN (SELECT dst, sum(hub) AS v FROM edges JOIN h{i - 1} ON id = src GROUP BY 1) s ON s.dst = n.id)", f"a{i} AS MATERIALIZED (SELECT id, v / (SELECT sum(v) FROM x{i}) AS authority FROM x{i})",
            f"y{i} AS MATERIALIZED (SELECT n.id, coalesce(v, 0) AS v FROM nodes n LEFT JOIN (SELECT src, sum(authority) AS v FROM edges JOIN a{i} ON id = dst GROUP BY 1) s ON s.src = n.id)", f"h{i} AS MATERIALIZED (SELECT id, v / (SELECT sum(v) FROM y{i}) AS hub FROM y{i})",
        ]
    return f"WITH {GRAPH_SQL}, {', '.join(steps)} SELECT id, round(hub, 8) AS hub, round(authority, 8) AS authority FROM h{rounds} JOIN a{rounds} USING (id)"


@query("hits", _hits_sql(6))
def _hits(spark, sf):
    return g.hits(*graph(spark, sf, numbers=True, once=False), rounds=6, tolerance=0).select(named("id"), F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


_VOTES = unrolled("SELECT id, id AS label FROM nodes", lambda t: f"SELECT p.id, coalesce(v.label, p.label) AS label FROM {t} p LEFT JOIN (SELECT l.src AS id, t.label, count(*) AS n FROM links l JOIN {t} t ON t.id = l.dst GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l.src ORDER BY count(*) DESC, t.label) = 1) v ON v.id = p.id", 5)


@query("label_propagation", f"WITH {BOTH}, {_VOTES} SELECT id, label FROM t5")
def _labels(spark, sf):
    return g.label_propagation(*graph(spark, sf, numbers=True, once=False), rounds=5).select(named("id"), named("label"))


NATIONS = "q AS (SELECT DISTINCT s_nationkey AS l, l_partkey AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


def supplied(spark, sf):
    lines, s = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), read(spark, sf, "supplier")
    return lines.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("left"), F.col("l_partkey").alias("right"))


@query("link_prediction", f"""WITH {NATIONS}, f AS (SELECT r, count(*) AS f FROM q GROUP BY 1), n AS (SELECT l, count(*) AS n FROM q GROUP BY 1),
m AS (SELECT a.l AS a, b.l AS b, count(*) AS common, sum(1 / ln(f)) AS aa FROM q a JOIN q b ON a.r = b.r AND a.l < b.l JOIN f ON f.r = a.r GROUP BY 1, 2)
SELECT a, b, common, round(common::DOUBLE / (x.n + y.n - common), 6) AS jaccard, round(aa, 4) AS adamic_adar FROM m JOIN n x ON x.l = a JOIN n y ON y.l = b""")
def _links(spark, sf):
    """Nations that supply the same parts."""
    got = g.shared_neighbours(supplied(spark, sf))
    return got.select("a", "b", "common", r6(F.col("jaccard")).alias("jaccard"), F.round("adamic_adar", 4).alias("adamic_adar"))


TOGETHER = "e AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), b AS (SELECT x AS src, y AS dst FROM e UNION ALL SELECT y, x FROM e)"
TRI = "t AS (SELECT p.src AS id, count(*) AS links FROM b p JOIN b q ON q.src = p.src AND q.dst > p.dst JOIN e ON x = p.dst AND y = q.dst GROUP BY 1)"


def together(spark, sf, once=True):
    """Parts of one order, in pairs: an order has a handful of lines. Without once, a pair stands as often as orders have it."""
    lines = spread(read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    every = a.join(b, "l_orderkey").where("src < dst").select("src", "dst")
    return every.distinct() if once else every


@query("triangles", f"WITH {TOGETHER}, {TRI} SELECT id, links AS triangles FROM t")
def _triangles(spark, sf):
    return g.triangles(together(spark, sf))


@query("clustering_coefficient", f"WITH {TOGETHER}, {TRI}, d AS (SELECT src AS id, count(*) AS neighbours FROM b GROUP BY 1) SELECT id, neighbours, coalesce(links, 0) AS links, round(CASE WHEN neighbours > 1 THEN coalesce(links, 0) / (neighbours * (neighbours - 1) / 2.0) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (id)")
def _clustering(spark, sf):
    got = g.clustering(together(spark, sf))
    return got.select("id", "neighbours", "links", r6(F.col("coefficient")).alias("coefficient"))


@query("k_core")
def _core(spark, sf):
    """Core numbers of parts bought together; tests compare them with peeling on small graphs."""
    return g.core_numbers(None, together(spark, sf, once=False))


WALK = "r(seed, id, hops) AS (SELECT id, id, 0::BIGINT FROM nodes WHERE {seeds} UNION SELECT r.seed, l.dst, r.hops + 1 FROM r JOIN links l ON l.src = r.id WHERE r.hops < {most})"


@query("shortest_path", f"WITH RECURSIVE {BOTH}, {WALK.format(seeds="id = 'c1'", most=4)} SELECT id, min(hops) AS hops FROM r GROUP BY id")
def _paths(spark, sf):
    nodes, edges = graph(spark, sf, numbers=True, once=False)
    return g.distances(edges, nodes.where(named("id") == "c1"), 4).select(named("id"), "hops")


@query("path_of_ids", f"""WITH RECURSIVE {BOTH}, {WALK.format(seeds="id = 'c1'", most=6)}, d AS (SELECT id, min(hops) AS hops FROM r GROUP BY id),
p(id, place) AS (SELECT id, hops FROM d WHERE id = 's1' UNION ALL SELECT (SELECT min(d.id) FROM d JOIN links l ON l.dst = d.id WHERE l.src = p.id AND d.hops = p.place - 1), p.place - 1 FROM p WHERE p.place > 0) SELECT place, id FROM p""")
def _path(spark, sf):
    one = lambda letter: spark.range(1, 2).select(number(letter, "id")).first()[0]
    return g.shortest_path(graph(spark, sf, numbers=True, once=False)[1], one("c"), one("s")).select("place", named("id"))


@query("closeness", f"""WITH RECURSIVE {BOTH}, {WALK.format(seeds="label = 'region'", most=9)}, d AS (SELECT seed, id, min(hops) AS hops FROM r GROUP BY 1, 2), n AS (SELECT count(*) - 1.0::DOUBLE AS n FROM nodes)
SELECT seed, count(*) AS reached, round(count(*) / sum(hops) * (count(*) / any_value(n)), 6) AS closeness, round(sum(1.0 / hops) / any_value(n), 6) AS harmonic, max(hops) AS eccentricity FROM d, n WHERE hops > 0 GROUP BY seed""")
def _closeness(spark, sf):
    nodes, edges = graph(spark, sf, numbers=True, once=False)
    got = g.closeness(g.distances(edges, nodes.where("label = 'region'")), nodes.count())
    return got.select(named("seed"), "reached", r6(F.col("closeness")).alias("closeness"), r6(F.col("harmonic")).alias("harmonic"), "eccentricity")


@query("path_reliability", f"""WITH RECURSIVE {GRAPH_SQL}, p(nodes, hops, product) AS (SELECT [id], 0::BIGINT, 1.0::DOUBLE FROM nodes WHERE label = 'orders' AND id LIKE '%00' UNION ALL
SELECT list_append(p.nodes, e.dst), p.hops + 1, p.product * CASE WHEN e.type = 'contains' THEN 0.5 ELSE 0.8 END FROM p JOIN edges e ON e.src = p.nodes[-1] WHERE p.hops < 4 AND NOT list_contains(p.nodes, e.dst))
SELECT array_to_string(nodes, '>') AS path, hops, round(product, 6) AS reliability FROM p WHERE hops > 0""")
def _reliability(spark, sf):
    """Directed paths of at most four steps from some orders, each step as sure as its kind."""
    nodes, edges = graph(spark, sf)
    rated = edges.withColumn("v", F.when(F.col("type") == "contains", 0.5))
    got = g.simple_paths(rated, nodes.where("label = 'orders' AND id LIKE '%00'"), 4, "v", 0.8)
    return got.select(F.array_join("nodes", ">").alias("path"), "hops", r6(F.col("product")).alias("reliability"))


@query("orphan_nodes", f"WITH {GRAPH_SQL} SELECT id, label FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE type <> 'in_nation' UNION SELECT dst FROM edges WHERE type <> 'in_nation')")
def _orphans(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.orphans(nodes, edges.where("type <> 'in_nation'"))


@query("modularity", f"""WITH {BOTH}, t AS (SELECT count(*)::DOUBLE AS t FROM links), m AS (SELECT x.label AS a, y.label AS b FROM links JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst),
c AS (SELECT a AS community, count(*) FILTER (a = b) AS i, count(*) AS v FROM m GROUP BY 1), p AS (SELECT *, i / t - (v / t) ** 2 AS part FROM c, t)
SELECT community, i // 2 AS inside, v - i AS cut, round(coalesce((v - i) / nullif(least(v, t - v), 0), 0), 6) AS conductance, round(part, 6) AS part, round(sum(part) OVER (), 6) AS modularity FROM p""")
def _modularity(spark, sf):
    nodes, edges = graph(spark, sf, numbers=True, once=False)
    got = g.modularity(edges, nodes.select("id", F.col("label").alias("community")))
    return got.select("community", "inside", "cut", *(r6(F.col(c)).alias(c) for c in ("conductance", "part", "modularity")))


@query("partition_agreement", """WITH c AS (SELECT c_nationkey % 5 AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS y FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS nn, (SELECT sum(x * (x - 1) / 2.0) FROM x) AS xx, (SELECT sum(y * (y - 1) / 2.0) FROM y) AS yy, (SELECT sum(n / t * ln(n * t / (x * y))) FROM c JOIN x USING (a) JOIN y USING (b), t) AS mi,
(SELECT -sum(x / t * ln(x / t)) FROM x, t) AS hx, (SELECT -sum(y / t * ln(y / t)) FROM y, t) AS hy, t FROM t), k AS (SELECT *, xx * yy / (t * (t - 1) / 2) AS chance FROM s) SELECT round((nn - chance) / ((xx + yy) / 2 - chance), 6) AS ari, round(2 * mi / (hx + hy), 6) AS nmi FROM k""")
def _agreement(spark, sf):
    got = g.partitions_agreement(read(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("a"), F.col("c_mktsegment").alias("b")))
    return got.select(r6(F.col("ari")).alias("ari"), r6(F.col("nmi")).alias("nmi"))


@query("snapshot_diff", """WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, CASE WHEN o.o_orderstatus IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' ELSE 'changed' END AS change, o_orderstatus AS old, s AS new FROM o FULL JOIN n USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM s""")
def _diff(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return g.diff(o.where("o_orderkey % 7 <> 0"), new, ["o_orderkey"], "o_orderstatus")
