"""Queries of sentences, chunks, units, redaction, greedy selections, and more of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import graph as g
from ..operators import rerank, text
from ..operators.retrieval import nearest
from ..registry import query
from ..sources.tables import GRAPH_SQL, graph, read

WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')"


@query("sentence_split", "WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT id, (unnest(range(len(s))))::BIGINT AS place, unnest(s) AS sentence FROM s")
def _sentences(spark, sf):
    return text.sentences(read(spark, sf, "documents"), "doc_id", "text")


@query("chunker", f"""WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), c AS (SELECT id, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 150.0))::BIGINT + 1)) AS chunk FROM d WHERE len(w) > 0), b AS (SELECT id, chunk, w[chunk * 150 + 1:chunk * 150 + 200] AS b FROM c)
SELECT id, chunk, len(b) AS words, array_to_string(b, ' ') AS body FROM b""")
def _chunks(spark, sf):
    return text.chunks(read(spark, sf, "documents"), "doc_id", "text")


@query("next_chunk_edges", f"""WITH d AS (SELECT doc_id AS id, len({WORDS}) AS n FROM documents), c AS (SELECT id, unnest(range(0, greatest(0, ceil((n - 200) / 150.0))::BIGINT)) AS chunk FROM d WHERE n > 0) SELECT id, chunk, chunk + 1 AS next FROM c""")
def _next(spark, sf):
    return text.next_chunks(text.chunks(read(spark, sf, "documents"), "doc_id", "text"))


@query("unit_convert", """WITH u(unit, family, factor) AS (VALUES ('g', 'mass', 0.001::DOUBLE), ('mm', 'length', 0.001), ('h', 'time', 3600.0), ('MPa', 'pressure', 1000000.0)), m AS (SELECT p_partkey, p_size, ['g', 'mm', 'h', 'MPa', 'furlong'][p_size % 5 + 1] AS unit FROM part)
SELECT p_partkey, m.unit, round(p_size * factor, 6) AS value, family FROM m LEFT JOIN u USING (unit)""")
def _units(spark, sf):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("g", "mm", "h", "MPa", "furlong"))), F.col("p_size") % 5 + 1)
    m = read(spark, sf, "part").select("p_partkey", "p_size", unit.alias("unit"))
    value, family = text.to_base(F.col("p_size").cast("double"), F.col("unit"))
    return m.select("p_partkey", "unit", r6(value).alias("value"), family.alias("family"))


@query("redact", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-zA-Z._%+-]+@[0-9a-zA-Z-]+(?:\\.[0-9a-zA-Z-]+)+', '[MAIL]', 'g'), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[IP]', 'g'), '[0-9]{9,}', '[NUMBER]', 'g') AS text FROM documents")
def _redact(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("snippet", "WITH a AS (SELECT doc_id, text, instr(lower(text), 'token') AS at_ FROM documents) SELECT doc_id, CASE WHEN at_ > 0 THEN substr(text, greatest(1, at_ - 40), least(at_ - 1, 40) + 5 + 40) END AS snippet FROM a")
def _snippet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("token")).alias("snippet"))


@query("mmr", """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query, v AS qv FROM v WHERE id % 100 = 0),
s AS (SELECT query, id, v, list_cosine_similarity(v, qv) AS score FROM v, q WHERE id <> query QUALIFY row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(v, qv) DESC, id) <= 30),
p(query, place, taken) AS (SELECT query, 0::BIGINT, []::BIGINT[] FROM q UNION ALL
SELECT query, place + 1, list_append(taken, (SELECT s.id FROM s WHERE s.query = p.query AND NOT list_contains(p.taken, s.id) ORDER BY round(0.7 * s.score - 0.3 * coalesce((SELECT max(greatest(0, list_cosine_similarity(s.v, t.v))) FROM s t WHERE t.query = p.query AND list_contains(p.taken, t.id)), 0), 9) DESC, s.score DESC, s.id LIMIT 1)) FROM p WHERE place < 5)
SELECT query, taken[place] AS id, place FROM p WHERE place > 0""")
def _mmr(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("query"), "v")
    hits = nearest(v, q, top=30, digits=12).select("query", "id", "score").join(v, "id")
    return rerank.mmr(hits, k=5, candidates=30)


CLOSE = """o AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey AS candidate, 1.0::DOUBLE + l_suppkey % 3 AS cost, p_brand || '/' || p_size AS gap, 1.0::DOUBLE + p_size % 2 AS weight FROM lineitem JOIN part ON p_partkey = l_partkey),
p(place, taken) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT place + 1, list_append(taken, (SELECT candidate FROM o WHERE gap NOT IN (SELECT gap FROM o d WHERE list_contains(p.taken, d.candidate)) GROUP BY candidate, cost ORDER BY sum(weight) / cost DESC, cost, candidate LIMIT 1)) FROM p WHERE place = 0 OR taken[-1] IS NOT NULL),
k AS (SELECT place, taken[-1] AS candidate FROM p WHERE place > 0 AND taken[-1] IS NOT NULL), f AS (SELECT gap, any_value(weight) AS weight, min(place) AS place FROM o JOIN k USING (candidate) GROUP BY gap)"""


def offers(spark, sf):
    sold = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.select(F.concat(F.lit("s"), "l_suppkey").alias("candidate"), (1.0 + F.col("l_suppkey") % 3).alias("cost"), F.concat_ws("/", "p_brand", "p_size").alias("gap"), (1.0 + F.col("p_size") % 2).alias("weight"))


@query("gap_closure_plan", f"""WITH RECURSIVE {CLOSE} SELECT k.place, k.candidate, round(sum(weight), 6) AS gained, round((SELECT sum(weight) FROM f g WHERE g.place <= k.place) / (SELECT sum(weight) FROM f), 6) AS covered FROM k JOIN f USING (place) GROUP BY 1, 2""")
def _cover(spark, sf):
    """Suppliers that together supply every brand and size, chosen one after the other by what they add for their cost."""
    got = rerank.set_cover(offers(spark, sf))
    return got.select("place", "candidate", r6(F.col("gained")).alias("gained"), r6(F.col("covered")).alias("covered"))


@query("export_sif", f"""WITH {GRAPH_SQL} SELECT 1 AS part, src || chr(9) || type || chr(9) || dst AS line FROM edges""")
def _sif(spark, sf):
    return g.lines(*graph(spark, sf), "sif")


@query("export_tgf", f"""WITH {GRAPH_SQL} SELECT 1 AS part, id || ' ' || label AS line FROM nodes UNION ALL SELECT 2, '#' UNION ALL SELECT 3, src || ' ' || dst || ' ' || type FROM edges""")
def _tgf(spark, sf):
    return g.lines(*graph(spark, sf), "tgf")


@query("export_dot", f"""WITH {GRAPH_SQL} SELECT 0 AS part, 'digraph G {{' AS line UNION ALL SELECT 1, '  "' || id || '" [label="' || label || '"];' FROM nodes UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label="' || type || '"];' FROM edges UNION ALL SELECT 3, '}}'""")
def _dot(spark, sf):
    return g.lines(*graph(spark, sf), "dot")


@query("export_ndjson", f"""WITH {GRAPH_SQL} SELECT 1 AS part, '{{"src":"' || src || '","dst":"' || dst || '","type":"' || type || '"}}' AS line FROM edges""")
def _ndjson(spark, sf):
    return g.lines(*graph(spark, sf), "ndjson")


@query("export_graphml", f"""WITH {GRAPH_SQL} SELECT 0 AS part, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">' AS line UNION ALL SELECT 1, '<node id="' || id || '"><data key="label">' || label || '</data></node>' FROM nodes UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"><data key="type">' || type || '</data></edge>' FROM edges UNION ALL SELECT 3, '</graph></graphml>'""")
def _graphml(spark, sf):
    return g.lines(*graph(spark, sf), "graphml")


@query("export_nt", f"""WITH {GRAPH_SQL} SELECT 1 AS part, '<urn:node:' || id || '> <urn:label> "' || label || '" .' AS line FROM nodes UNION ALL SELECT 2, '<urn:node:' || src || '> <urn:type:' || type || '> <urn:node:' || dst || '> .' FROM edges""")
def _nt(spark, sf):
    return g.lines(*graph(spark, sf), "nt")


@query("export_csv", f"""WITH {GRAPH_SQL} SELECT 0 AS part, 'src,dst,type' AS line UNION ALL SELECT 1, src || ',' || dst || ',' || type FROM edges""")
def _csv(spark, sf):
    return g.lines(*graph(spark, sf), "csv")


@query("export_cypher", f"""WITH {GRAPH_SQL} SELECT 1 AS part, 'MERGE (n {{id: "' || id || '"}}) SET n:' || label || ';' AS line FROM nodes UNION ALL SELECT 2, 'MATCH (a {{id: "' || src || '"}}), (b {{id: "' || dst || '"}}) MERGE (a)-[:' || upper(type) || ']->(b);' FROM edges""")
def _cypher(spark, sf):
    return g.lines(*graph(spark, sf), "cypher")
