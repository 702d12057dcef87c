"""Comparison of systems and runs: tests of pairs, edit distance, triples, gates, health and samples to label."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import ratio
from ..functions.order import cumulative, sums_in_order


@F.pandas_udf(T.DoubleType())
def sign_p(positive: pd.Series, negative: pd.Series) -> pd.Series:
    """Exact two-sided binomial p of a split that even chances would make; 1 without any. For rows of results, one for each test."""

    def p(pos: int, neg: int) -> float:
        n, k = pos + neg, min(pos, neg)
        term = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k, max(-1, k - 100_000), -1)]  # terms fall off long before
        return min(1.0, 2 * math.fsum(map(math.exp, term))) if n else 1.0

    return pd.Series([p(int(a), int(b)) for a, b in zip(positive, negative, strict=True)], dtype="float64")


def signed_rank(pairs: DataFrame) -> DataFrame:
    """pairs (a, b): Wilcoxon's W+ and W- (zero differences left out, ties share their middle rank), their lesser, how many differ each way, and the sign test's p."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    per = d.groupBy(F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"), F.count("*").alias("n"))
    rank = F.col("upto_n") - (F.col("n") - 1) / 2
    s = cumulative(per, "size", ["n"]).agg(F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * F.col("minus")).alias("w_minus"), F.sum("plus").alias("positive"), F.sum("minus").alias("negative"))
    return s.na.fill(0).withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("sign_p", sign_p("positive", "negative"))


def edit_scores(pairs: DataFrame) -> DataFrame:
    """pairs (id, gold, pred): character error rate (without gold: 0 or 1) and similarity."""
    d, n = F.levenshtein("gold", "pred"), F.char_length("gold")
    cer = F.when(n > 0, d / n).otherwise((F.char_length("pred") > 0).cast("double"))
    longest = F.greatest(n, F.char_length("pred"))
    return pairs.select("id", cer.alias("cer"), F.when(longest > 0, 1 - d / longest).otherwise(1.0).alias("similarity"))


def graded_ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """ranked (query, id, rank from 1, grade): graded nDCG at k, 0 where no grade is positive."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))
    gain = lambda place: F.when(F.col(place) <= k, F.col("grade") / F.log2(F.col(place) + 1.0)).otherwise(0.0)
    s = ranked.withColumn("_best", best).groupBy("query").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("_best")).alias("ideal"))
    return s.select("query", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def phantoms(cited: DataFrame, known: DataFrame) -> DataFrame:
    """cited (answer, id), known (id): citations of each answer, and how many name nothing that exists."""
    k = known.select("id").distinct().withColumn("_k", F.lit(1))
    return cited.join(k, "id", "left").groupBy("answer").agg(F.count("*").alias("citations"), F.count_if(F.col("_k").isNull()).alias("phantoms")).withColumn("rate", ratio(F.col("phantoms"), F.col("citations")))


def run_diff(before: DataFrame, after: DataFrame, key: str, band: float = 0.02) -> DataFrame:
    """before and after (key, value): improved, regressed or same within a band; added and removed."""
    a, b = before.select(key, F.col("value").alias("old")), after.select(key, F.col("value").alias("new"))
    change = F.round(F.col("new") - F.col("old"), 9)
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(change > band, "improved").when(change < -band, "regressed").otherwise("same")
    return a.join(b, key, "full").withColumn("change", kind)


def flaky(runs: DataFrame, key: str, order: str, least: int = 3) -> DataFrame:
    """runs (key, order, passed): tests that both passed and failed in at least so many runs, and how often the result turned."""
    turned = (F.col("passed") != F.lag("passed").over(Window.partitionBy(key).orderBy(order))).cast("int")
    g = runs.withColumn("_t", turned).groupBy(key).agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"), F.sum("_t").alias("flips"))
    return g.where((F.col("runs") >= least) & (F.col("passes") > 0) & (F.col("passes") < F.col("runs"))).withColumn("flip_rate", F.col("flips") / (F.col("runs") - 1))


def health(defects: dict[str, tuple[float, Column]]) -> tuple[Column, Column]:
    """100 times the weighted mean of 1 - share of each defect, and its grade."""
    total = sum(w for w, _ in defects.values())
    score = 100 * sum((F.lit(w / total) * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) for w, x in defects.values()), F.lit(0.0))
    return score, F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def triples(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold and pred (src, relation, dst), compared in lower case without blanks at the ends: per relation and in all ('*') precision, recall and F1."""
    norm = lambda d: d.select(*(F.lower(F.trim(F.col(c))).alias(c) for c in ("src", "relation", "dst"))).distinct()
    both = norm(gold).withColumn("g", F.lit(1)).join(norm(pred).withColumn("p", F.lit(1)), ["src", "relation", "dst"], "full").na.fill(0, ["g", "p"])
    rows = both.select(F.explode(F.array(F.col("relation"), F.lit("*"))).alias("relation"), "g", "p")
    s = rows.groupBy("relation").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("gold"), F.sum("p").alias("pred"))
    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("gold"))
    return s.select("relation", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def set_scores(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """gold and pred (key, id): precision (without predictions 1 only if nothing was expected) and recall (1 if nothing was expected) of each key."""
    both = gold.select(key, "id").distinct().withColumn("g", F.lit(1)).join(pred.select(key, "id").distinct().withColumn("p", F.lit(1)), [key, "id"], "full").na.fill(0, ["g", "p"])
    s = both.groupBy(key).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("gold"), F.sum("p").alias("pred"))
    precision = F.when(F.col("pred") == 0, (F.col("gold") == 0).cast("double")).otherwise(F.col("tp") / F.col("pred"))
    return s.select(key, precision.alias("precision"), ratio(F.col("tp"), F.col("gold"), 1.0).alias("recall"))


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (metric, value), rules (metric, low, high; null: no limit): whether each is kept; a metric that is missing is not."""
    found = rules.join(metrics, "metric", "left")
    kept = F.col("value").isNotNull() & (F.coalesce(F.col("value") >= F.col("low"), F.lit(True))) & (F.coalesce(F.col("value") <= F.col("high"), F.lit(True)))
    return found.select("metric", "value", kept.alias("kept"))


def linking(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """ranked (mention, id, rank), gold (mention, id; null: there is none): accuracy at 1, recall at k and mean reciprocal rank. Where gold has none, an empty list is right."""
    hit = gold.withColumnRenamed("id", "gold").join(ranked, "mention", "left").groupBy("mention", "gold").agg(F.min(F.when(F.col("id") == F.col("gold"), F.col("rank"))).alias("place"), F.count("rank").alias("n"))
    right = F.when(F.col("gold").isNull() & (F.col("n") == 0), 1).when(F.col("gold").isNotNull(), F.col("place"))
    s = hit.withColumn("r", right)
    return s.agg(F.avg(F.coalesce(F.col("r") == 1, F.lit(False)).cast("double")).alias("accuracy"), F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def to_label(rows: DataFrame, group: str, quota: int) -> DataFrame:
    """rows (id, group, p): the least certain of each group, as many as its quota."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.abs(F.col("p") - 0.5), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= quota)


def costs(steps: DataFrame, budget: float, order: list[str]) -> DataFrame:
    """steps (query, cost, order): one row of queries, mean, percentiles and how many are over a budget. Costs are added up in an order without ties, as a sum near the budget hangs on it."""
    per = sums_in_order(steps, ["query"], "cost", order).select("query", F.col("total").alias("cost"))
    q = F.percentile("cost", F.array(F.lit(0.5), F.lit(0.95)))
    return per.agg(F.count("*").alias("queries"), F.avg("cost").alias("mean"), q.alias("q"), F.count_if(F.col("cost") > budget).alias("over")).select("queries", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "over")


def abstention(answers: DataFrame, key: str) -> DataFrame:
    """answers (key, answered, correct): precision of what was answered (1 if nothing was), coverage, accuracy, and precision times coverage."""
    a = F.count_if("answered")
    right = F.count_if(F.col("answered") & F.col("correct"))
    g = answers.groupBy(key).agg(F.count("*").alias("n"), a.alias("a"), right.alias("c"))
    precision, coverage = ratio(F.col("c"), F.col("a"), 1.0), F.col("a") / F.col("n")
    return g.select(key, precision.alias("precision"), coverage.alias("coverage"), (F.col("c") / F.col("n")).alias("accuracy"), (precision * coverage).alias("score"))


def bag_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold and pred (id, token), with repeats: F1 of the tokens as bags."""
    count = lambda d, c: d.groupBy("id", "token").agg(F.count("*").alias(c))
    both = count(gold, "g").join(count(pred, "p"), ["id", "token"], "full").na.fill(0, ["g", "p"])
    return both.groupBy("id").agg(ratio(2 * F.sum(F.least("g", "p")), F.sum("g") + F.sum("p")).alias("f1"))


def degradation(scores: DataFrame, kind: str) -> DataFrame:
    """scores (kind, clean, changed): relative loss by kind of change: mean and worst; 0 where the clean score is not positive."""
    loss = F.when(F.col("clean") > 0, (F.col("clean") - F.col("changed")) / F.col("clean")).otherwise(0.0)
    return scores.withColumn("_l", loss).groupBy(kind).agg(F.avg("_l").alias("mean"), F.max("_l").alias("worst"), F.count_if(F.col("_l") > 0).alias("worse"))
