"""Queries that run a stream over all events and give its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import events as ev


def stream(spark, sf):
    return ev.source(spark, f"{sf}/events.parquet")


def bounds(df, *rest):
    us = lambda c: F.unix_micros(F.col(f"w.{c}")).alias(f"w_{c}")
    return df.select(us("start"), us("end"), *rest)


@query("tumbling_window", "SELECT epoch_us(date_trunc('day', ts)) AS w_start, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS w_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def _tumbling(spark, sf):
    return bounds(ev.settle(ev.tumbling(stream(spark, sf))), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_window", """WITH s AS (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s, event_type FROM events) SELECT epoch_us(s) AS w_start, epoch_us(s + INTERVAL 2 DAY) AS w_end, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def _sliding(spark, sf):
    return bounds(ev.settle(ev.sliding(stream(spark, sf))), "event_type", "n")


@query("session_window", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS starts FROM events),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT min(t) AS w_start, max(t) + 21600000000 AS w_end, user_id, count(*) AS n FROM g GROUP BY user_id, g""")
def _sessions(spark, sf):
    return bounds(ev.settle(ev.sessions(stream(spark, sf))), "user_id", "n")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type, epoch_us(ts) AS t FROM events")
def _first(spark, sf):
    got = ev.settle(ev.first_seen(stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"]), "append")
    return got.select("user_id", "event_type", F.unix_micros("ts").alias("t"))


@query("rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, event_id, admitted, times) AS (SELECT user_id, k, event_id, true, [t] FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.k, e.event_id, len(list_filter(r.times, lambda x: e.t - x < 86400000000)) < 3, CASE WHEN len(list_filter(r.times, lambda x: e.t - x < 86400000000)) < 3 THEN list_append(list_filter(r.times, lambda x: e.t - x < 86400000000), e.t) ELSE list_filter(r.times, lambda x: e.t - x < 86400000000) END
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id, admitted FROM r""")
def _limit(spark, sf):
    return ev.rate_limited(stream(spark, sf))
