"""Queries of entity resolution: documents as records of a head, a tail, a length, a source and a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import linkage as link
from ..registry import query
from ..sources.tables import read

MODEL = link.Model(
    comparisons=(link.jaro_winkler_at("head"), link.jaro_winkler_at("tail"), link.within("n_words", (0.02, 0.1)), link.exact("source", tf=True), link.exact("lang", tf=True)),
    rules=(("head", "tail"), ("head", "n_words"), ("tail", "n_words")),
    deterministic=(("head", "tail", "n_words"),),
    training=(("head", "tail"), ("head", "n_words"), ("tail", "n_words")),
)


def records(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = read(spark, sf, "documents").select("doc_id", "source", "lang", words.alias("w"))
    n = F.size("w")
    return some.select(
        "doc_id", "source", "lang", n.cast("long").alias("n_words"), F.array_join(F.slice("w", 1, 6), " ").alias("head"),
        F.array_join(F.slice("w", F.greatest(n - 5, F.lit(1)), F.lit(6)), " ").alias("tail"),
    )


RECORDS_SQL = """w AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
r AS MATERIALIZED (SELECT doc_id AS id, source, lang, len(w) AS n_words, array_to_string(w[1:6], ' ') AS head, array_to_string(w[greatest(len(w) - 5, 1):], ' ') AS tail FROM w)"""


def _jw(c: str) -> str:
    return f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN -1 WHEN a.{c} = b.{c} THEN 3 WHEN jaro_winkler_similarity(a.{c}, b.{c}) >= 0.92 THEN 2 WHEN jaro_winkler_similarity(a.{c}, b.{c}) >= 0.85 THEN 1 ELSE 0 END AS g_{c}"


def _same(c: str) -> str:
    return f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN -1 WHEN a.{c} = b.{c} THEN 1 ELSE 0 END AS g_{c}"


_WITHIN = "CASE WHEN a.n_words IS NULL OR b.n_words IS NULL THEN -1 WHEN a.n_words = b.n_words THEN 3 WHEN abs(a.n_words - b.n_words) <= 0.02 * greatest(a.n_words, b.n_words) THEN 2 WHEN abs(a.n_words - b.n_words) <= 0.1 * greatest(a.n_words, b.n_words) THEN 1 ELSE 0 END AS g_n_words"
_ANY_RULE = " OR ".join("(" + " AND ".join(f"a.{c} = b.{c}" for c in rule) + ")" for rule in MODEL.rules)


@query("linkage_blocking", f"""WITH {RECORDS_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM r), b AS (""" + " UNION ALL ".join(f"SELECT {i} AS \"at\", '{'+'.join(rule)}' AS rule, count(*) AS k FROM r WHERE {' AND '.join(f'{c} IS NOT NULL' for c in rule)} GROUP BY {', '.join(rule)}" for i, rule in enumerate(MODEL.rules)) + """)
SELECT "at", rule, count(*) AS blocks, max(k) AS largest, sum(k * (k - 1) // 2)::BIGINT AS pairs, round(1 - sum(k * (k - 1) // 2) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS reduction FROM b, n GROUP BY "at", rule""")
def _blocking(spark, sf):
    one, _ = link.classes(records(spark, sf), MODEL, "doc_id")
    return link.blocking_stats(one, MODEL.rules).withColumn("reduction", r6(F.col("reduction")))


@query("linkage_patterns", f"""WITH {RECORDS_SQL}, p AS (SELECT {_jw('head')}, {_jw('tail')}, {_WITHIN}, {_same('source')}, {_same('lang')} FROM r a JOIN r b ON a.id < b.id AND ({_ANY_RULE}))
SELECT *, count(*) AS pairs FROM p GROUP BY ALL""")
def _patterns(spark, sf):
    one, _ = link.classes(records(spark, sf), MODEL, "doc_id")
    return link.patterns(one, MODEL.comparisons, MODEL.rules)


@query("linkage_matches")
def _matches(spark, sf):
    pairs, _, _ = link.link(records(spark, sf), MODEL, "doc_id")
    return pairs.select("left_id", "right_id", r6(F.col("weight")).alias("weight"), r6(F.col("probability")).alias("probability"))


@query("linkage_clusters")
def _clusters(spark, sf):
    _, found, _ = link.link(records(spark, sf), MODEL, "doc_id")
    return found.select("id", "cluster", r6(F.col("probability")).alias("probability"))


@query("linkage_proposals")
def _proposals(spark, sf):
    _, found, _ = link.link(records(spark, sf), MODEL, "doc_id")
    reviewed = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return link.proposals(found, reviewed).withColumn("probability", r6(F.col("probability")))
