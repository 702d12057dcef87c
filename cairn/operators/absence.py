"""Coverage grids, absence posteriors, gap scores, recall priors and contradictions of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import clamp01, ratio

RECALL, PRIOR, CONFIDENT, UNINFORMATIVE = 0.7, 0.5, 0.66, 0.4


def coverage_grid(left: DataFrame, right: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of two vocabularies with its evidence_count; the vocabularies are small and the observations aggregated first."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("evidence_count"))
    return left.crossJoin(right).join(counts, keys, "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long")))


def posterior(recall: Column, prior: float = PRIOR) -> Column:
    """P(absent | nothing found)."""
    r = clamp01(recall)
    return (1 - prior) / ((1 - prior) + prior * (1 - r))


def absence(cells: DataFrame, recall: Column, prior: float = PRIOR) -> DataFrame:
    """confidence and status of every cell; no confidence where the recall is too low to say."""
    p = posterior(recall, prior)
    covered, blind = F.col("evidence_count") > 0, clamp01(recall) < UNINFORMATIVE
    return cells.withColumn("confidence", F.when(covered, 0.0).when(~blind, p)).withColumn(
        "status", F.when(covered, "covered").when(blind, "unknown").when(F.round(p, 4) >= CONFIDENT, "confident_absence").otherwise("possible_absence")
    )


def binary_entropy(p: Column) -> Column:
    inside = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(inside)


def entropy_of(cells: DataFrame, status: str = "status") -> DataFrame:
    """One row: entropy of the statuses' shares, in bits and as a share of the most there can be."""
    counts = cells.groupBy(status).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("p", p).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.count("*").alias("kinds")).withColumn("normalised", F.when(F.col("kinds") > 1, F.col("entropy") / F.log2("kinds")).otherwise(0.0))


def gini(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient of a value within each group."""
    w = Window.partitionBy(*keys)
    ranked = values.withColumn("_i", F.row_number().over(w.orderBy(value)))
    n, total = F.count("*"), F.sum(value)
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(2 * F.sum(F.col("_i") * F.col(value)), n * total) - (n + 1) / n, F.lit(0.0)).alias("gini"))


def smoothed_recall(found: Column, attempts: Column, mean: float = 0.7, strength: float = 20.0) -> Column:
    return (found + mean * strength) / (attempts + strength)


def jeffreys(found: Column, n: Column) -> Column:
    return (found + 0.5) / (n + 1)


def wilson(found: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 1 without trials."""
    p = ratio(found, n)
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n), 1 + z * z / n
    none = n == 0
    return F.when(none, 0.0).otherwise(clamp01((middle - spread) / scale)), F.when(none, 1.0).otherwise(clamp01((middle + spread) / scale))


def near_misses(mentions: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """What is mentioned and never observed."""
    return mentions.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def contradictions(measurements: DataFrame, key: list[str], value: str, gap: float = 0.3) -> DataFrame:
    """Groups of measurements of one thing whose extremes differ by at least gap of the larger: n, low, high, difference."""
    spread = measurements.groupBy(*key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return spread.withColumn("difference", ratio(F.col("high") - F.col("low"), F.greatest(F.abs("high"), F.abs("low")))).where(F.col("difference") >= gap)


def severity(difference: Column, criticality: Column) -> tuple[Column, Column]:
    """Score and label of a contradiction."""
    s = difference * (0.5 + 0.5 * criticality)
    return s, F.when(s >= 0.6, "critical").when(s >= 0.4, "high").when(s >= 0.2, "medium").otherwise("low")


def consensus(measurements: DataFrame, key: list[str], value: str, weight: str, tolerance: float = 0.5) -> DataFrame:
    """Weighted mean of each key (plain where no weight is positive), its spread, and how many values are further off than tolerance of it."""
    w = Window.partitionBy(*key)
    mean = F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)).over(w), F.sum(weight).over(w)), F.avg(value).over(w))
    rows = measurements.withColumn("_m", mean)
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.first("_m").alias("consensus"), (F.max(value) - F.min(value)).alias("spread"),
        F.count_if(F.abs(F.col(value) - F.col("_m")) > tolerance * F.abs("_m")).alias("outliers"),
    )


def outliers(rows: DataFrame, key: list[str], value: str, z: float = 3.5, least: int = 4) -> DataFrame:
    """Rows outside the quartiles by 1.5 of their distance, or with a robust z over the limit, in groups of enough rows."""
    stats = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    both = rows.join(stats.where(F.col("_n") >= least), key)
    both = both.withColumn("_d", F.abs(F.col(value) - F.col("_q")[1]))
    mad = both.groupBy(*key).agg(F.median("_d").alias("_mad"))
    both = both.join(mad, key)
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    robust = F.coalesce(F.try_divide(F.col(value) - F.col("_q")[1], 1.4826 * F.col("_mad")), F.lit(0.0))
    out = both.withColumn("robust_z", robust).withColumn("by_iqr", (F.col(value) < q1 - 1.5 * (q3 - q1)) | (F.col(value) > q3 + 1.5 * (q3 - q1)))
    return out.where(F.col("by_iqr") | (F.abs("robust_z") > z)).drop("_n", "_q", "_d", "_mad")


def population(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95))))
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("_q"))
    return out.select(*key, "n", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), *(F.col("_q")[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))))


def gap_priority(parts: dict[str, tuple[float, Column]]) -> Column:
    """Weighted mean of components, each one half where it is unknown."""
    total = sum(w for w, _ in parts.values())
    return sum((F.coalesce(c, F.lit(0.5)) * (w / total) for w, c in parts.values()), F.lit(0.0))
