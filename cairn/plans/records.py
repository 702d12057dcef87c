"""Queries of versions, merges, chains, decisions, pages and facets over orders, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as rec
from ..registry import query
from ..sources.tables import read


def events(spark, sf):
    return read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("fact_as_of", "SELECT user_id, event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _as_of(spark, sf):
    return rec.as_of(events(spark, sf).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query("as_of_join", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, user_id, round(v.value, 4) AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""".replace("event_id, user_id, round", "event_id, p.user_id, round"))
def _as_of_join(spark, sf):
    e = events(spark, sf)
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    got = rec.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "last_view")
    return got.select("event_id", "user_id", F.round("last_view", 4).alias("last_view"))


@query("scd2_versions", """WITH e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT * FROM e WHERE n = 1 OR event_type IS DISTINCT FROM p) SELECT user_id, event_type, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS valid_to FROM c""")
def _versions(spark, sf):
    first = events(spark, sf).groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"))
    got = rec.versions(first, ["user_id"], "ts", "event_type")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return got.select("user_id", "event_type", us("valid_from"), us("valid_to"))


@query("keyed_upsert", """WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, coalesce(c.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(c.o_orderpriority, b.o_orderpriority) AS o_orderpriority FROM b FULL JOIN c USING (o_orderkey)""")
def _upsert(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "X"))
    return rec.upsert(o.where("o_orderkey % 3 <> 0"), changes, ["o_orderkey"])


CHAIN = """e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS payload FROM events),
c(user_id, event_id, place, hash) AS (SELECT user_id, event_id, place, sha256(repeat('0', 64) || payload) FROM e WHERE place = 1 UNION ALL SELECT e.user_id, e.event_id, e.place, sha256(c.hash || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.place = c.place + 1)"""


def payload():
    """A row as JSON, keys in order."""
    return F.to_json(F.struct("event_id", "event_type", "user_id"))


@query("audit_hash_chain", f"WITH RECURSIVE {CHAIN} SELECT user_id, event_id, place, hash FROM c")
def _chain(spark, sf):
    return rec.hash_chain(events(spark, sf), "user_id", "event_id", payload())


@query("audit_chain_verify", f"WITH RECURSIVE {CHAIN} SELECT user_id, place FROM c WHERE event_id % 97 = 0")
def _verify(spark, sf):
    """Rows of the chain that were changed after it was made."""
    chain = rec.hash_chain(events(spark, sf), "user_id", "event_id", payload()).join(events(spark, sf).select("event_id", payload().alias("payload")), "event_id")
    changed = chain.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return rec.broken_links(changed, "user_id", "payload").select("user_id", "place")


@query("decision_groups", """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g(user_id, k, event_id, event_type, first, t0) AS (SELECT user_id, k, event_id, event_type, event_id, t FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, e.event_type, CASE WHEN e.event_type = g.event_type AND e.t - g.t0 <= 86400000000 THEN g.first ELSE e.event_id END,
CASE WHEN e.event_type = g.event_type AND e.t - g.t0 <= 86400000000 THEN g.t0 ELSE e.t END FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1) SELECT user_id, event_id, first AS group_first FROM g""")
def _decisions(spark, sf):
    return rec.decision_groups(events(spark, sf), "user_id", "ts", "event_id", "event_type", 86_400)


@query("cursor_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _page(spark, sf):
    return rec.page(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("facets", """SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2""")
def _facets(spark, sf):
    long = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size")).unpivot([], ["brand", "type", "size"], "facet", "value")
    return long.groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("context_packing", """WITH RECURSIVE h AS (SELECT source AS query, doc_id AS id, n_chars // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY n_chars % 997 DESC, doc_id) AS k FROM documents),
p(query, k, used, id, kept) AS (SELECT DISTINCT query, 0::BIGINT, 0::BIGINT, -1::BIGINT, false FROM h UNION ALL SELECT h.query, h.k, CASE WHEN p.used + h.tokens <= 4000 THEN p.used + h.tokens ELSE p.used END, h.id, p.used + h.tokens <= 4000 FROM p JOIN h ON h.query = p.query AND h.k = p.k + 1)
SELECT query, (max(used) OVER (PARTITION BY query))::BIGINT AS used, row_number() OVER (PARTITION BY query ORDER BY k) - 1 AS place, id FROM p WHERE kept""")
def _pack(spark, sf):
    hits = read(spark, sf, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), (F.col("n_chars") % 997).alias("score"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return rec.pack(hits, 4000).select("query", "used", "place", "id")


@query("rate_summary", "SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _rates(spark, sf):
    return events(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
