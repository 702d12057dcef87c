"""Gaps, absence verdicts, priors, contradictions and retractions, over tables of cells and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import clamp01, ratio

#: Recall of extraction, prior that a fact exists (of what is mentioned: the second), and the bands of the verdict.
RECALL, EXISTS, EXISTS_IF_MENTIONED, MISSED_FROM, GAP_UP_TO = 0.7, 0.55, 0.9, 0.6, 0.25
#: What to do about each status; about any other, SKIP.
ACTIONS = {
    "CONFIDENT_ABSENCE": "INVESTIGATE",
    "POSSIBLE_ABSENCE": "EXTRACT_MORE",
    "RETRACTED": "REVIEW_RETRACTION",
    "COVERED": "SKIP",
    "UNKNOWN": "SKIP",
}
#: The actions in order, and those that a shortlist is made of.
ACTION_ORDER = ("INVESTIGATE", "EXTRACT_MORE", "REVIEW_RETRACTION", "SKIP")
SHORTLISTED = ("INVESTIGATE", "EXTRACT_MORE")
#: How much a recall prior counts for by how it was found, and how much more if it is calibrated.
METHODS = {
    "gold_calibrated": 3,
    "heuristic_modality_prior_derived": 2,
    "heuristic": 1,
    "unknown": 0,
}
CALIBRATED = 10


def missed(prior: Column, recall: float = RECALL) -> Column:
    """P(the extractor missed it | nothing was found)."""
    return F.round(1 - (1 - prior) / ((1 - prior) + prior * (1 - recall)), 4)


def verdicts(cells: DataFrame, recall: float = RECALL, exists: float = EXISTS) -> DataFrame:
    """cells (active, valued, retracted, mentioned) with verdict and p_missed: what is there, then what was withdrawn, then what is mentioned, then the prior."""
    of = lambda p: missed(F.lit(p), recall)
    unseen = F.when(of(exists) >= MISSED_FROM, "possible_miss").when(of(exists) <= GAP_UP_TO, "genuine_gap").otherwise("abstain")
    verdict = F.when(F.col("active") > 0, F.when(F.col("valued") > 0, "present").otherwise("covered")).when(F.col("retracted") > 0, "retracted").when(F.col("mentioned"), "possible_miss").otherwise(unseen)
    p = F.when((F.col("active") > 0) | (F.col("retracted") > 0), 0.0).when(F.col("mentioned"), of(EXISTS_IF_MENTIONED)).otherwise(of(exists))
    return cells.withColumn("verdict", verdict).withColumn("p_missed", p)


def multidoc(looks: DataFrame, keys: list[str], prior: float = EXISTS) -> DataFrame:
    """looks (keys, recall), one for each document that was read: P(missed by all) and the posterior of absence."""
    missed_by_all = F.product(1 - clamp01(F.col("recall")))
    out = looks.groupBy(*keys).agg(F.count("*").alias("documents"), missed_by_all.alias("missed_by_all"))
    return out.withColumn("p_absent", (1 - prior) / ((1 - prior) + prior * F.col("missed_by_all")))


def bands(p: Column) -> Column:
    return F.when(p.isNull(), "UNKNOWN").when(p >= 0.6, "HIGH").when(p < 0.25, "LOW").otherwise("MID")


def map_delta(before: DataFrame, after: DataFrame, keys: list[str], covered: str = "COVERED") -> DataFrame:
    """Cells whose status (compared in upper case) changed: opened, closed, added, removed or changed."""
    a, b = before.select(*keys, F.upper("status").alias("before")), after.select(*keys, F.upper("status").alias("after"))
    was, is_ = F.col("before"), F.col("after")
    kind = F.when(was.isNull(), "added").when(is_.isNull(), "removed").when((is_ == covered) & (was != covered), "closed").when((was == covered) & (is_ != covered), "opened").when(was != is_, "changed")
    return a.join(b, keys, "full").withColumn("change", kind).where("change IS NOT NULL")


def triage(cells: DataFrame) -> DataFrame:
    """cells with the action for their status, or for their verdict where they have none, in any case and without blanks at the ends."""
    known = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    said = [F.nullif(F.col(c), F.lit("")) for c in ("status", "verdict") if c in cells.columns]
    return cells.withColumn("action", F.coalesce(known[F.upper(F.trim(F.coalesce(*said, F.lit(""))))], F.lit("SKIP")))


def triage_board(cells: DataFrame) -> DataFrame:
    """(action, n) of every action, those without a cell too."""
    every = cells.sparkSession.createDataFrame([(a,) for a in ACTION_ORDER], "action string")
    return every.join(triage(cells).groupBy("action").agg(F.count("*").alias("n")), "action", "left").na.fill(0, ["n"])


def triage_shortlist(cells: DataFrame, order: list[str], top: int = 5) -> DataFrame:
    """The first cells to look at: those to investigate, then those to extract again, each by order."""
    first = F.when(F.col("action") == SHORTLISTED[0], 0).otherwise(1)
    return triage(cells).where(F.col("action").isin(*SHORTLISTED)).orderBy(first, *order).limit(max(0, top))


def expected_missed(cells: DataFrame, key: str) -> DataFrame:
    """Sum of 1 - confidence over cells of an absence status, by key."""
    return cells.where(F.upper("status").like("%ABSENCE")).groupBy(key).agg(F.sum(1 - F.col("confidence")).alias("expected"), F.count("*").alias("cells"))


def fuse_priors(priors: DataFrame, delta: float = 0.2) -> DataFrame:
    """priors (context, recall, method, calibrated, at: order of arrival): for each context the prior of highest rank, of equals the one
    that came first, and whether recalls differ by more than delta. A method that is null is unknown, a null in calibrated is false."""
    known = F.create_map(*(F.lit(x) for kv in METHODS.items() for x in kv))
    rows = priors.select("context", "recall", F.coalesce("method", F.lit("unknown")).alias("source"), F.coalesce("calibrated", F.lit(False)).alias("calibrated"), "at")
    rows = rows.withColumn("rank", F.coalesce(known[F.col("source")], F.lit(METHODS["unknown"])) + F.when(F.col("calibrated"), CALIBRATED).otherwise(0))
    best = F.min_by(F.struct("recall", "source", "calibrated", "rank"), F.struct(-F.col("rank"), F.col("at")))
    out = rows.groupBy("context").agg(best.alias("b"), (F.max("recall") - F.min("recall") > delta).alias("conflict"))
    return out.select("context", "b.recall", "b.source", "b.calibrated", "conflict", "b.rank")


def cluster_gaps(gaps: DataFrame) -> DataFrame:
    """gaps (id, material, property, domain, type): (key, size, dominant_type, first); blank fields count as missing, ties of types go to the one seen first by id."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    both = F.concat(F.lit("material="), text("material"), F.lit("|property="), text("property"))
    key = F.when((text("material") != "") | (text("property") != ""), both).when(text("domain") != "", F.concat(F.lit("domain="), text("domain"))).when(text("type") != "", F.concat(F.lit("type="), text("type"))).otherwise("unclustered")
    rows = gaps.withColumn("key", key).withColumn("type", text("type"))
    kinds = rows.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    best = F.min_by("type", F.struct(-F.when(F.col("type") != "", F.col("n")).otherwise(0), F.col("first")))
    return kinds.groupBy("key").agg(F.sum("n").alias("size"), F.nullif(best, F.lit("")).alias("dominant_type"), F.min("first").alias("first"))


def dedup_key(kind: Column, ids: Column) -> Column:
    """'gap:' type ':' twelve digits of the SHA-1 of the different ids in order."""
    return F.concat(F.lit("gap:"), kind, F.lit(":"), F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(ids)), "\0").cast("binary")), 1, 12))


def best_per_key(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row of highest score for each key, of equals the first by order."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(score).isNull(), -F.col(score), F.col(order))).alias("v"))
    return best.select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def reconcile(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """known (key, status) and what a new scan found (key): created, reopened, still_open or auto_resolved; what people settled stays."""
    k, f = known.select(key, "status"), found.select(key).distinct().withColumn("_f", F.lit(True))
    settled = F.col("status").isin("acknowledged", "dismissed")
    kind = F.when(F.col("status").isNull(), "created").when(F.col("_f").isNull(), F.when(~settled & (F.col("status") != "resolved"), "auto_resolved")).when(F.col("status") == "resolved", "reopened").when(~settled, "still_open")
    return k.join(f, key, "full").withColumn("change", kind).where("change IS NOT NULL").select(key, "change")


def rel_diff(a: Column, b: Column) -> Column:
    return ratio(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))


def conflicting_values(values: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """values (keys, unit, value, low, high; one row for each different value): keys with values of one unit that differ by a share of the larger and whose intervals (touching counts) don't overlap: the number of such pairs and the largest difference.

    Sorted by value, a value conflicts with another only if it also does with some value beyond it, so the keys
    that can have a pair at all are those whose extremes differ enough; only their values meet.
    """
    w = Window.partitionBy(*keys, "unit")
    spread = rel_diff(F.max("value").over(w), F.min("value").over(w))
    some = values.withColumn("_s", spread).where(F.col("_s") >= least).drop("_s")
    a, b = some.alias("a"), some.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "unit")] + [F.col("a.value") < F.col("b.value")]
    apart = (F.col("a.high") < F.col("b.low")) | (F.col("b.high") < F.col("a.low"))
    met = a.join(b, on).withColumn("difference", rel_diff(F.col("a.value"), F.col("b.value"))).where((F.col("difference") >= least) & apart)
    return met.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.count("*").alias("pairs"), F.max("difference").alias("largest"))


def retraction_impact(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """measurements (keys, retracted): active and retracted of each cell, and whether it lost all or some."""
    c = measurements.groupBy(*keys).agg(F.count_if(~F.col("retracted")).alias("active"), F.count_if(F.col("retracted")).alias("retracted"))
    return c.withColumn("state", F.when(F.col("retracted") == 0, "intact").when(F.col("active") == 0, "collapsed").otherwise("partial"))


def latency(days: DataFrame) -> DataFrame:
    """days (days): how long things took, negative ones dropped: n, least, median, mean, most, and counts up to 30, 180, 365 and over."""
    d = days.where("days >= 0")
    c = F.col("days")
    return d.agg(F.count("*").alias("n"), F.min(c).alias("least"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.max(c).alias("most"), F.count_if(c <= 30).alias("d30"), F.count_if((c > 30) & (c <= 180)).alias("d180"), F.count_if((c > 180) & (c <= 365)).alias("d365"), F.count_if(c > 365).alias("later"))


def rate_by_group(rows: DataFrame, group: str, flag: Column, top: int = 5) -> DataFrame:
    """The groups (null as a dash) with the highest share of flagged rows."""
    g = rows.groupBy(F.coalesce(F.col(group), F.lit("—")).alias("group")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return g.orderBy(F.desc("rate"), "group").limit(top)


def solution_score(evidence: Column, verified: Column, year: Column) -> Column:
    return F.round(evidence + 2 * verified.cast("int") + clamp01((year - 2000) / 25), 6)


def agreement(values: DataFrame, key: str, source: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """single where one source speaks, consensus where all values are within a share of the largest, else disagreement."""
    g = values.groupBy(key).agg(F.count_distinct(source).alias("sources"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.withColumn("state", F.when(F.col("sources") < 2, "single").when(ratio(F.col("high") - F.col("low"), F.col("high")) <= tolerance, "consensus").otherwise("disagreement"))


def error_budget(rows: DataFrame, key: str, bad: Column, target: float) -> DataFrame:
    """Share of bad rows by key, how fast that uses up the budget of a target, and the alert that it deserves."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    burn = F.round(F.col("bad") / F.col("n") / (1 - target), 9)
    return g.withColumn("burn", burn).withColumn("alert", F.when(F.col("burn") >= 14.4, "critical").when(F.col("burn") >= 1, "warning").otherwise("ok"))


def completeness(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, share) of rows where a field is filled."""
    wide = rows.groupBy(group).agg(*(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields))
    return wide.unpivot(group, fields, "field", "share")


def latest(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def coverage_delta(before: Column, after: Column) -> Column:
    """Net change in per cent of before; where that was nothing: 0 or 100."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.round((after - before) / before * 100, 2))
