"""Queries of gaps, absence verdicts, priors, contradictions and retractions.

A part's type is a material, its size a property; a returned line is a retracted measurement of what was sold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import gaps as gp
from ..registry import query
from ..sources.tables import read
from .absence import GRID, cells

MEAS = """meas AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS doc, p_type AS material, 'size ' || p_size AS property, l_linestatus AS regime, 'u' || l_linenumber % 2 AS unit, l_extendedprice AS value, l_returnflag = 'R' AS retracted, l_quantity AS quantity, l_suppkey AS source
FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def measurements(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc"), F.col("p_type").alias("material"), F.concat(F.lit("size "), "p_size").alias("property"),
        F.col("l_linestatus").alias("regime"), F.concat(F.lit("u"), F.col("l_linenumber") % 2).alias("unit"), F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") == "R").alias("retracted"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("source"),
    )


MISSED = "round(1 - {q} / ({q} + {p} * 0.3), 4)"


@query("absence_signals", f"""WITH {MEAS}, m AS (SELECT DISTINCT p_type AS material FROM part), k AS (SELECT DISTINCT 'size ' || p_size AS property FROM part), c AS (SELECT material, property, count(*) FILTER (NOT retracted) AS active, count(*) FILTER (NOT retracted AND quantity > 10) AS valued, count(*) FILTER (retracted) AS retracted FROM meas GROUP BY 1, 2),
g AS (SELECT material, property, coalesce(active, 0) AS active, coalesce(valued, 0) AS valued, coalesce(retracted, 0) AS retracted, EXISTS (SELECT 1 FROM part WHERE p_type = m.material AND 'size ' || p_size = k.property) AS mentioned FROM m CROSS JOIN k LEFT JOIN c USING (material, property))
SELECT material, property, CASE WHEN active > 0 THEN CASE WHEN valued > 0 THEN 'present' ELSE 'covered' END WHEN retracted > 0 THEN 'retracted' WHEN mentioned THEN 'possible_miss' ELSE 'abstain' END AS verdict,
CASE WHEN active > 0 OR retracted > 0 THEN 0.0 WHEN mentioned THEN {MISSED.format(q='0.1::DOUBLE', p='0.9')} ELSE {MISSED.format(q='0.45::DOUBLE', p='0.55')} END AS p_missed FROM g""")
def _signals(spark, sf):
    part, m = read(spark, sf, "part"), measurements(spark, sf)
    named = part.select(F.col("p_type").alias("material"), F.concat(F.lit("size "), "p_size").alias("property")).distinct()
    c = m.groupBy("material", "property").agg(F.count_if(~F.col("retracted")).alias("active"), F.count_if(~F.col("retracted") & (F.col("quantity") > 10)).alias("valued"), F.count_if("retracted").alias("retracted"))
    grid = named.select("material").distinct().crossJoin(named.select("property").distinct())  # two small vocabularies: the grid is the feature
    grid = grid.join(c, ["material", "property"], "left").na.fill(0).join(named.withColumn("mentioned", F.lit(True)), ["material", "property"], "left").na.fill(False, ["mentioned"])
    return gp.verdicts(grid).select("material", "property", "verdict", "p_missed")


@query("absence_multidoc", f"""WITH {MEAS}, g AS (SELECT material, property, count(*) AS documents, product(1 - least(1, greatest(0, quantity / 60))) AS missed_by_all FROM meas GROUP BY 1, 2)
SELECT material, property, documents, round(missed_by_all, 6) AS missed_by_all, round(0.45 / (0.45 + 0.55 * missed_by_all), 6) AS p_absent FROM g""")
def _multidoc(spark, sf):
    got = gp.multidoc(measurements(spark, sf).withColumn("recall", F.col("quantity") / 60), ["material", "property"])
    return got.select("material", "property", "documents", r6(F.col("missed_by_all")).alias("missed_by_all"), r6(F.col("p_absent")).alias("p_absent"))


@query("absence_bands", f"WITH {GRID} SELECT CASE WHEN confidence IS NULL THEN 'UNKNOWN' WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence < 0.25 THEN 'LOW' ELSE 'MID' END AS band, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM cells GROUP BY 1")
def _bands(spark, sf):
    from ..operators.structure import shares

    return shares(cells(spark, sf).withColumn("band", gp.bands(F.col("confidence"))), "band").withColumn("share", r6(F.col("share")))


LATER = "later AS (SELECT material, property, CASE WHEN length(property) % 3 = 0 THEN 'Covered' ELSE upper(status) END AS status FROM cells WHERE length(property) % 7 <> 0)"


@query("absence_map_delta", f"""WITH {GRID}, {LATER}, d AS (SELECT material, property, upper(a.status) AS before, upper(b.status) AS after FROM cells a FULL JOIN later b USING (material, property)),
k AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN after = 'COVERED' AND before <> 'COVERED' THEN 'closed' WHEN before = 'COVERED' AND after <> 'COVERED' THEN 'opened' WHEN before <> after THEN 'changed' END AS change FROM d) SELECT * FROM k WHERE change IS NOT NULL""")
def _delta(spark, sf):
    now = cells(spark, sf).select("material", "property", "status")
    later = now.where(F.length("property") % 7 != 0).withColumn("status", F.when(F.length("property") % 3 == 0, "Covered").otherwise(F.upper("status")))
    return gp.map_delta(now, later, ["material", "property"])


_ACTION = "CASE upper(status) WHEN 'CONFIDENT_ABSENCE' THEN 'INVESTIGATE' WHEN 'POSSIBLE_ABSENCE' THEN 'EXTRACT_MORE' WHEN 'RETRACTED' THEN 'REVIEW_RETRACTION' ELSE 'SKIP' END"


@query("absence_triage", f"WITH {GRID} SELECT action, count(status) AS n FROM (VALUES ('INVESTIGATE'), ('EXTRACT_MORE'), ('REVIEW_RETRACTION'), ('SKIP')) v(action) LEFT JOIN (SELECT status, {_ACTION} AS action FROM cells) c USING (action) GROUP BY 1")
def _triage(spark, sf):
    return gp.triage_board(cells(spark, sf))


@query("triage_shortlist", f"WITH {GRID} SELECT material, property, status, {_ACTION} AS action FROM cells WHERE {_ACTION} IN ('INVESTIGATE', 'EXTRACT_MORE') ORDER BY {_ACTION} <> 'INVESTIGATE', material, property LIMIT 5")
def _shortlist(spark, sf):
    return gp.triage_shortlist(cells(spark, sf), ["material", "property"]).select("material", "property", "status", "action")


@query("expected_missed_facts", f"WITH {GRID} SELECT material, round(sum(1 - confidence), 6) AS expected, count(*) AS cells FROM cells WHERE status LIKE '%absence' GROUP BY 1")
def _missed(spark, sf):
    return gp.expected_missed(cells(spark, sf), "material").withColumn("expected", r6(F.col("expected")))


PRIORS = "pri AS (SELECT o_custkey % 97 AS context, o_totalprice % 1000 / 1000 AS recall, ['gold_calibrated', 'heuristic_modality_prior_derived', 'heuristic', 'other'][o_orderkey % 4 + 1] AS method, o_orderkey % 5 = 0 AS calibrated, o_orderkey AS arrived FROM orders)"


@query("recall_prior_fusion", f"""WITH {PRIORS}, r AS (SELECT *, CASE method WHEN 'gold_calibrated' THEN 3 WHEN 'heuristic_modality_prior_derived' THEN 2 WHEN 'heuristic' THEN 1 ELSE 0 END + CASE WHEN calibrated THEN 10 ELSE 0 END AS rank FROM pri)
SELECT context, rank, max(recall) OVER w - min(recall) OVER w > 0.2 AS conflict, method AS source, calibrated, round(recall, 6) AS recall FROM r WINDOW w AS (PARTITION BY context) QUALIFY row_number() OVER (PARTITION BY context ORDER BY rank DESC, arrived) = 1""")
def _priors(spark, sf):
    o = read(spark, sf, "orders")
    method = F.element_at(F.array(*(F.lit(m) for m in ("gold_calibrated", "heuristic_modality_prior_derived", "heuristic", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select((F.col("o_custkey") % 97).alias("context"), (F.col("o_totalprice") % 1000 / 1000).alias("recall"), method.alias("method"), (F.col("o_orderkey") % 5 == 0).alias("calibrated"), F.col("o_orderkey").alias("at"))
    return gp.fuse_priors(rows).withColumn("recall", r6(F.col("recall")))


GAPS = "gap AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 > 1 THEN p_brand END AS material, CASE WHEN p_size % 8 = 2 THEN substr(p_name, 1, 5) ELSE ' ' END AS property, CASE WHEN p_size % 4 = 1 THEN substr(p_brand, 1, 7) END AS domain, CASE WHEN p_size % 3 > 0 THEN p_type END AS type, p_retailprice AS score FROM part)"


def gaps(spark, sf):
    at = F.col("p_size")
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(at % 4 > 1, F.col("p_brand")).alias("material"), F.when(at % 8 == 2, F.substring("p_name", 1, 5)).otherwise(" ").alias("property"),
        F.when(at % 4 == 1, F.substring("p_brand", 1, 7)).alias("domain"), F.when(at % 3 > 0, F.col("p_type")).alias("type"), F.col("p_retailprice").alias("score"),
    )


@query("gap_clusters", f"""WITH {GAPS}, k AS (SELECT id, coalesce(trim(type), '') AS type, CASE WHEN coalesce(trim(material), '') <> '' OR trim(property) <> '' THEN 'material=' || coalesce(trim(material), '') || '|property=' || trim(property) WHEN domain IS NOT NULL THEN 'domain=' || trim(domain) WHEN type IS NOT NULL THEN 'type=' || trim(type) ELSE 'unclustered' END AS key FROM gap),
t AS (SELECT key, type, count(*) AS n, min(id) AS first FROM k GROUP BY 1, 2), b AS (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN type <> '' THEN n ELSE 0 END DESC, first) AS r FROM t)
SELECT t.key, sum(n)::BIGINT AS size, any_value(nullif(b.type, '')) AS dominant_type, min(first) AS first FROM t JOIN b ON b.key = t.key AND r = 1 GROUP BY t.key""")
def _clusters(spark, sf):
    return gp.cluster_gaps(gaps(spark, sf))


@query("gap_dedup_key", """WITH g AS (SELECT l_orderkey AS id, max(l_returnflag) FILTER (l_linenumber = 1) AS kind, string_agg(DISTINCT l_partkey::VARCHAR, chr(0) ORDER BY l_partkey::VARCHAR) AS ids FROM lineitem GROUP BY 1) SELECT id, 'gap:' || coalesce(kind, 'none') || ':' || substr(sha1(ids), 1, 12) AS key FROM g""")
def _keys(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("kind"), F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return g.select("id", gp.dedup_key(F.coalesce("kind", F.lit("none")), F.col("ids")).alias("key"))


@query("gap_best_per_key", f"WITH {GAPS} SELECT coalesce(type, 'none') AS key, arg_max(id, (score, -id)) AS id, max(score) AS score FROM gap GROUP BY 1")
def _best(spark, sf):
    g = gaps(spark, sf).select(F.coalesce("type", F.lit("none")).alias("key"), "id", "score")
    return gp.best_per_key(g, "key", "score", "id")


@query("gap_reconcile", """WITH k AS (SELECT o_orderkey AS key, ['open', 'resolved', 'acknowledged', 'dismissed'][o_orderkey % 4 + 1] AS status FROM orders WHERE o_orderkey % 5 > 0), f AS (SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey % 3 > 0),
c AS (SELECT key, CASE WHEN status IS NULL THEN 'created' WHEN f.key IS NULL THEN CASE WHEN status = 'open' THEN 'auto_resolved' END WHEN status = 'resolved' THEN 'reopened' WHEN status = 'open' THEN 'still_open' END AS change FROM k FULL JOIN f USING (key)) SELECT key, change FROM c WHERE change IS NOT NULL""".replace("f.key IS NULL", "f.seen IS NULL").replace("SELECT DISTINCT o_orderkey AS key FROM", "SELECT DISTINCT o_orderkey AS key, 1 AS seen FROM"))
def _reconcile(spark, sf):
    o = read(spark, sf, "orders")
    status = F.element_at(F.array(*(F.lit(s) for s in ("open", "resolved", "acknowledged", "dismissed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    known = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("key"), status.alias("status"))
    return gp.reconcile(known, o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("key")), "key")


@query("missing_regime", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _regime(spark, sf):
    """Orders without a line that names a final regime."""
    lines = read(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return read(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


VALUES = f"{MEAS}, v AS (SELECT source AS subject, material, regime, unit, round(value, -4) AS value, round(value, -4) - 2000 AS low, round(value, -4) + 2000 AS high FROM meas GROUP BY ALL)"


@query("contradiction_regime", f"""WITH {VALUES}, p AS (SELECT a.subject, a.material, a.regime, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) AS d FROM v a JOIN v b ON a.subject = b.subject AND a.material = b.material AND a.regime = b.regime AND a.unit = b.unit AND a.value < b.value WHERE a.high < b.low OR b.high < a.low)
SELECT subject, material, regime, count(*) AS pairs, round(max(d), 6) AS largest FROM p WHERE d >= 0.3 GROUP BY 1, 2, 3""")
def _conflicts(spark, sf):
    """Suppliers' values for a material under one regime and in one unit, rounded to what counts as different."""
    v = F.round("value", -4)
    rows = measurements(spark, sf).select(F.col("source").alias("subject"), "material", "regime", "unit", v.alias("value"), (v - 2000).alias("low"), (v + 2000).alias("high")).distinct()
    got = gp.conflicting_values(rows, ["subject", "material", "regime"])
    return got.withColumn("largest", r6(F.col("largest")))


@query("retraction_impact", f"""WITH {MEAS}, c AS (SELECT material, property, count(*) FILTER (NOT retracted) AS active, count(*) FILTER (retracted) AS retracted FROM meas GROUP BY 1, 2) SELECT *, CASE WHEN retracted = 0 THEN 'intact' WHEN active = 0 THEN 'collapsed' ELSE 'partial' END AS state FROM c""")
def _impact(spark, sf):
    return gp.retraction_impact(measurements(spark, sf), ["material", "property"])


DAYS = "d AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) * 4 - 60 AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"


@query("retraction_latency", f"WITH {DAYS} SELECT count(*) AS n, min(days) AS least, median(days) AS median, round(avg(days), 6) AS mean, max(days) AS most, count(*) FILTER (days <= 30) AS d30, count(*) FILTER (days > 30 AND days <= 180) AS d180, count(*) FILTER (days > 180 AND days <= 365) AS d365, count(*) FILTER (days > 365) AS later FROM d WHERE days >= 0")
def _latency(spark, sf):
    both = read(spark, sf, "orders").join(read(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) * 4 - 60
    return gp.latency(both.select(days.alias("days"))).withColumn("mean", r6(F.col("mean")))


@query("retraction_rate_by_group", f"WITH {MEAS} SELECT material AS \"group\", count(*) AS n, round(avg(CASE WHEN retracted THEN 1.0 ELSE 0.0 END), 6) AS rate FROM meas GROUP BY 1 ORDER BY avg(CASE WHEN retracted THEN 1.0 ELSE 0.0 END) DESC, 1 LIMIT 5")
def _rate(spark, sf):
    return gp.rate_by_group(measurements(spark, sf), "material", F.col("retracted")).withColumn("rate", r6(F.col("rate")))


@query("solution_ranking", """SELECT p_partkey AS id, round(count(*) + 2 * any_value(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) + least(1, greatest(0, (max(year(CAST(l_shipdate AS DATE))) - 2000) / 25.0::DOUBLE)), 6) AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def _solutions(spark, sf):
    both = read(spark, sf, "part").join(read(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    g = both.groupBy(F.col("p_partkey").alias("id"), "p_size").agg(F.count("*").alias("n"), F.max(F.year(F.col("l_shipdate").cast("date"))).alias("y"))
    return g.select("id", gp.solution_score(F.col("n"), F.col("p_size") > 25, F.col("y")).alias("score"))


@query("synthesis_consensus", """WITH g AS (SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS sources, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT part, sources, low, high, CASE WHEN sources < 2 THEN 'single' WHEN (high - low) / high <= 0.5 THEN 'consensus' ELSE 'disagreement' END AS state FROM g""")
def _consensus(spark, sf):
    lines = read(spark, sf, "lineitem").where("l_linestatus = 'O'").withColumnRenamed("l_partkey", "part")
    return gp.agreement(lines, "part", "l_suppkey", "l_quantity", 0.5)


@query("slo_error_budget", """WITH g AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 95) AS bad FROM events GROUP BY 1), b AS (SELECT *, round(bad::DOUBLE / n / (1 - 0.99::DOUBLE), 9) AS burn FROM g) SELECT event_type, n, bad, round(burn, 6) AS burn, CASE WHEN burn >= 14.4 THEN 'critical' WHEN burn >= 1 THEN 'warning' ELSE 'ok' END AS alert FROM b""")
def _budget(spark, sf):
    return gp.error_budget(read(spark, sf, "events"), "event_type", F.col("value") > 95, 0.99).withColumn("burn", r6(F.col("burn")))


@query("property_completeness", f"WITH {GAPS}, c AS (SELECT coalesce(domain, 'none') AS g, avg(CASE WHEN material IS NULL THEN 0.0 ELSE 1.0 END) AS material, avg(CASE WHEN type IS NULL THEN 0.0 ELSE 1.0 END) AS type FROM gap GROUP BY 1) SELECT g, 'material' AS field, round(material, 6) AS share FROM c UNION ALL SELECT g, 'type', round(type, 6) FROM c")
def _complete(spark, sf):
    return gp.completeness(gaps(spark, sf).withColumn("g", F.coalesce("domain", F.lit("none"))), "g", ["material", "type"]).withColumn("share", r6(F.col("share")))


@query("partition_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _status(spark, sf):
    return gp.latest(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("coverage_delta", """WITH c AS (SELECT l_suppkey AS source, count(*) FILTER (l_linenumber <= 2) AS a, count(*) FILTER (l_linenumber > 2) AS b FROM lineitem GROUP BY 1) SELECT source, a AS before, b AS after, b - a AS net, CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0.0 ELSE 100.0 END ELSE round((b - a)::DOUBLE / a * 100, 2) END AS pct FROM c""")
def _coverage(spark, sf):
    c = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count_if(F.col("l_linenumber") <= 2).alias("before"), F.count_if(F.col("l_linenumber") > 2).alias("after"))
    return c.select("*", (F.col("after") - F.col("before")).alias("net"), gp.coverage_delta(F.col("before"), F.col("after")).alias("pct"))
