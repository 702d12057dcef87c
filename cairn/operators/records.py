"""Versions, upserts, audit chains and decisions: what happens to rows over time."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import folded
from ..functions.storage import cut


def as_of(facts: DataFrame, key: list[str], time: str, at: Column) -> DataFrame:
    """The last version of every key up to a moment, by one aggregation."""
    rest = [c for c in facts.columns if c not in key]
    last = facts.where(F.col(time) <= at).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, *(c for c in rest if c != time))).alias("v"))
    return last.select(*key, *(F.col(f"v.{c}").alias(c) for c in rest))


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Every left row with the right value of its key that is last up to the left row's time: one sort by key and time."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*key, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = b.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def versions(facts: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Validity intervals: runs of one value, from its first time to the next run's."""
    w = Window.partitionBy(*key).orderBy(time)
    changed = facts.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
    return changed.select(*key, value, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge: a change's values win where they are not null; new keys are added."""
    rest = [c for c in base.columns if c not in key]
    b, c = base.select(*key, *(F.col(x).alias(f"_b_{x}") for x in rest)), changes.select(*key, *(F.col(x).alias(f"_c_{x}") for x in rest))
    return b.join(c, key, "full").select(*key, *(F.coalesce(f"_c_{x}", f"_b_{x}").alias(x) for x in rest))


def hash_chain(events: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """(key, order, place, hash): each hash covers the one before it and the row's payload. Rows go one by one, whatever a key has."""

    def step(state: tuple[int, str], row: tuple) -> tuple[tuple[int, str], tuple]:
        place, last = state
        made = hashlib.sha256((last + row[2]).encode()).hexdigest()
        return (place + 1, made), (row[0], row[1], place + 1, made)

    rows = events.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), payload.alias("payload"))
    return folded(rows, [key], [order], f"{key} long, {order} long, place long, hash string", lambda: (0, "0" * 64), step)


def broken_links(chain: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of a chain (key, place, payload, hash) whose hash is not that of the one before and the payload, or whose place is not the next."""
    w = Window.partitionBy(key).orderBy("place")
    before, place = F.coalesce(F.lag("hash").over(w), F.lit("0" * 64)), F.row_number().over(w)
    own = F.sha2(F.concat(before, F.col(payload)).cast("binary"), 256)
    return chain.withColumn("_ok", (own == F.col("hash")) & (place == F.col("place"))).where("NOT _ok").drop("_ok")


def decision_groups(events: DataFrame, key: str, time: str, order: str, action: str, seconds: int) -> DataFrame:
    """(key, order, group_first): events of a key with the first of their group: consecutive events of one action within a span of its first.

    The span is that of the group's first event, so groups follow from each other and a session window would not
    do; each key's sorted log is gone through once.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        _, t, number, kind = row
        same = state is not None and state[2] == kind and t - state[0] <= seconds * 1_000_000
        state = state if same else (t, number, kind)
        return state, (row[0], number, state[1])

    rows = events.select(F.col(key).cast("long").alias(key), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).cast("long").alias(order), F.col(action).alias("action"))
    return folded(rows, [key], ["t", order], f"{key} long, {order} long, group_first long", lambda: None, step)


def token_bucket(events: DataFrame, key: str, time: str, order: str, capacity: float, per_second: float) -> DataFrame:
    """(key, order, admitted, left): each key has a bucket that begins full and fills with time; an event takes a token, or is turned away if there is less than one.

    Events go by their time and then by order; events without a time are left out, those without a key share a bucket.
    """
    if capacity <= 0 or per_second < 0:
        raise ValueError("a bucket holds something and doesn't leak")

    def step(state: tuple[float, int] | None, row: tuple) -> tuple[tuple[float, int], tuple]:
        own, t, number = row
        tokens, before = state or (capacity, t)
        tokens = min(capacity, tokens + (t - before) / 1_000_000 * per_second)
        ok = tokens >= 1.0
        tokens = tokens - 1.0 if ok else tokens
        return (tokens, t), (own, number, ok, tokens)

    rows = events.select(F.col(key).cast("long").alias(key), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).cast("long").alias(order)).where("t IS NOT NULL")
    return folded(rows, [key], ["t", order], f"{key} long, {order} long, admitted boolean, left double", lambda: None, step)


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def pack(hits: DataFrame, budget: int) -> DataFrame:
    """hits (query, id, score, tokens): best first, each taken if it still fits; one that does not is passed over: query, id, tokens, place, used.

    What is over the whole budget never fits and goes first; a query's other hits are gone through one by one.
    """

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], tuple | None]:
        used, place = state
        if used + row[3] > budget:
            return state, None
        return (used + row[3], place + 1), (row[0], row[1], row[3], place)

    rows = hits.where(F.col("tokens") <= budget).select("query", F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.col("tokens").cast("long").alias("tokens"))
    kind = rows.schema["query"].dataType.simpleString()
    kept = folded(rows, ["query"], [F.desc("score"), "id"], f"query {kind}, id long, tokens long, place long", lambda: (0, 0), step)
    kept = cut(kept)
    return kept.join(kept.groupBy("query").agg(F.sum("tokens").alias("used")), "query")
