"""Evaluation metrics and statistics over tables of predictions, ranks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import mid_rank, ratio
from ..functions.order import cumulative


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, precision and hit at k, nDCG at k, reciprocal rank and average precision over the whole ranking.

    ranked (query, id, rank from 1), relevant (query, id). An id counts at its first rank only. Precision is of what is
    shown, so fewer than k are no fault. A query without anything relevant has recall 1 and nDCG and average precision 0.
    """
    first = ranked.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "id")))
    gold = relevant.select("query", "id").distinct()
    n = gold.groupBy("query").agg(F.count("*").alias("n"))
    hits = first.join(gold.withColumn("hit", F.lit(1)), ["query", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = F.sum("hit").over(Window.partitionBy("query").orderBy("rank"))
    hits = hits.withColumn("precise", F.col("hit") * upto / F.col("rank")).withColumn("top", (F.col("rank") <= k).cast("int"))
    gain = F.col("top") * F.col("hit") / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("query").agg(F.sum(F.col("hit") * F.col("top")).alias("found"), F.sum("top").alias("shown"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("best"), F.sum(gain).alias("dcg"), F.sum("precise").alias("ap"))
    both = per.join(n, "query", "full").na.fill(0, ["found", "shown", "dcg", "ap", "n"])
    best_dcg = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("n")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))
    return both.select(
        "query", ratio(F.col("found"), F.col("n"), 1.0).alias("recall"), ratio(F.col("found"), F.col("shown")).alias("precision"), (F.col("found") > 0).cast("int").alias("hit"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / best_dcg, F.lit(0.0)).alias("ndcg"), ratio(F.col("ap"), F.col("n")).alias("ap"),
    )


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of confidence: how many, mean confidence, share of true labels."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")
    return pairs.groupBy(at).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, Brier score, expected and largest calibration error, and Murphy's three parts."""
    b = reliability(pairs, bins)
    n, base = F.sum("n"), F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    per = b.agg(n.alias("n"), (F.sum(F.col("n") * gap) / n).alias("ece"), F.max(gap).alias("mce"), (F.sum(F.col("n") * gap * gap) / n).alias("reliability"), base.alias("base"), (F.sum(F.col("n") * F.col("accuracy") * F.col("accuracy")) / n).alias("square"))
    brier = pairs.agg(F.avg(F.pow(F.col("confidence") - F.col("label").cast("double"), 2)).alias("brier"))
    return per.crossJoin(brier).select("n", "brier", "ece", "mce", "reliability", (F.col("square") - F.col("base") * F.col("base")).alias("resolution"), (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def by_score(pairs: DataFrame) -> DataFrame:
    """score with the counts of true and false labels at it and above it: a row for each different score."""
    per = pairs.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n")).select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    return cumulative(per, "score", ["pos", "neg"], descending=True).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})


def auc(pairs: DataFrame) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision."""
    t = by_score(pairs)
    area = F.sum(F.col("pos") * F.col("fp") - F.col("pos") * F.col("neg") / 2.0)
    p, n = F.sum("pos"), F.sum("neg")
    return t.agg((1 - ratio(area, p * n, None)).alias("roc_auc"), ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), p).alias("pr_auc"))


def threshold_sweep(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F at every score as threshold."""
    t = by_score(pairs).withColumn("p", F.max("tp").over(Window.partitionBy(F.lit(0))))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    return t.select("score", precision.alias("precision"), recall.alias("recall"), ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall).alias("f"))


def risk_coverage(records: DataFrame) -> DataFrame:
    """records (confidence, correct): coverage and risk of answering down to each confidence."""
    per = records.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    both = cumulative(per, "confidence", ["n", "wrong"], descending=True).crossJoin(F.broadcast(per.agg(F.sum("n").alias("total"))))
    return both.select("confidence", (F.col("upto_n") / F.col("total")).alias("coverage"), (F.col("upto_wrong") / F.col("upto_n")).alias("risk"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs (gold, pred): per class precision, recall, F1 and support."""
    c = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    gold, pred = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("g")), c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    hit = c.where(F.col("gold") == F.col("pred")).select(F.col("gold").alias("label"), F.col("n").alias("tp"))
    t = gold.join(pred, "label", "full").join(hit, "label", "left").na.fill(0)
    precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("g"))
    return t.select("label", F.col("g").alias("support"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of two annotators' labels: agreement, chance agreement and kappa."""
    c = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    n = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    a, b = c.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("x")), c.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = ratio(F.col("same"), F.col("total")), ratio(F.col("xy"), F.col("total") * F.col("total"))
    return n.crossJoin(chance).select(po.alias("po"), pe.alias("pe"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """ratings (item, label), as many of each item: Fleiss' kappa."""
    c = ratings.groupBy("item", "label").agg(F.count("*").alias("n"))
    item = c.groupBy("item").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    bar = item.agg(F.avg((F.col("sq") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("p"))
    share = c.groupBy("label").agg(F.sum("n").alias("n")).withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).agg(F.sum(F.col("q") * F.col("q")).alias("pe"))
    return bar.crossJoin(share).select(F.col("p").alias("po"), "pe", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def krippendorff(ratings: DataFrame) -> DataFrame:
    """ratings (item, label): nominal alpha over items with two ratings or more."""
    c = ratings.groupBy("item", "label").agg(F.count("*").alias("n"))
    c = c.withColumn("m", F.sum("n").over(Window.partitionBy("item"))).where("m > 1")
    observed = c.agg((F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1))).alias("do"), F.sum("n").alias("total"))
    expected = c.groupBy("label").agg(F.sum("n").alias("n")).agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("de"))
    return observed.crossJoin(expected).select(F.when(F.col("de") == 0, 1.0).otherwise(1 - F.col("do") * (F.col("total") - 1) / F.col("de")).alias("alpha"))


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of mid-ranks of x and y within each group; 0 where either is flat."""
    ranked = pairs.withColumn("_x", mid_rank("x", keys)).withColumn("_y", mid_rank("y", keys))
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")), F.lit(0.0)).alias("rho"))


def kendall(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's tau-a within each (short) group of pairs with an id."""
    a, b = pairs.alias("a"), pairs.alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.id") < F.col("b.id")])
    sign = F.signum((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y")))
    return met.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg((F.sum(sign) / F.count("*")).alias("tau"))


def effect_sizes(pairs: DataFrame) -> DataFrame:
    """pairs (side 'a' or 'b', value): Cohen's d (pooled) and Cliff's delta, from counts by value and not from all pairs of values."""
    of = lambda k: F.col("side") == k
    s = pairs.agg(*(f(F.when(of(k), F.col("value"))).alias(f"{n}_{k}") for k in ("a", "b") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    per = pairs.groupBy("value").agg(F.count_if(of("a")).alias("a"), F.count_if(of("b")).alias("b"))
    over = cumulative(per, "value", ["b"]).agg(F.sum(F.col("a") * (2 * F.col("upto_b") - F.col("b"))).alias("u"))  # twice how often a is over b, ties half
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    delta = F.col("u") / (F.col("n_a") * F.col("n_b")) - 1
    size = F.abs(delta)
    return s.crossJoin(over).select(((F.col("mean_a") - F.col("mean_b")) / pooled).alias("cohen_d"), delta.alias("cliffs_delta"), F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large").alias("band"))


def adjusted(pvalues: DataFrame) -> DataFrame:
    """pvalues (id, p) with Holm's and Benjamini-Hochberg's adjusted values; a table of tests, not of data."""
    w = Window.partitionBy(F.lit(0)).orderBy("p", "id")
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    rows = pvalues.withColumn("i", F.row_number().over(w)).withColumn("m", m)
    holm = F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col("p")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col("m") * F.col("p") / F.col("i")).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return rows.select("id", "p", holm.alias("holm"), bh.alias("bh"))


def pareto(points: DataFrame) -> DataFrame:
    """points (id, cost, quality) that no other dominates: less cost and at least the quality, or as much cost and more.

    Sorted by cost, a point stands if its quality is over all that cost less; one pass of a running maximum per
    different cost.
    """
    best = points.groupBy("cost").agg(F.max("quality").alias("top"))
    w = Window.partitionBy(F.lit(0)).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("before", F.max("top").over(w)).where(F.col("before").isNull() | (F.col("top") > F.col("before")))
    return points.join(front, "cost").where(F.col("quality") == F.col("top")).select("id", "cost", "quality")


def win_rates(scores: DataFrame) -> DataFrame:
    """scores (system, item, score): share of common items that a beats b on; ties are counted apart."""
    a, b = scores.alias("a"), scores.alias("b")
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.system") != F.col("b.system")))
    return met.groupBy(F.col("a.system").alias("system"), F.col("b.system").alias("opponent")).agg(
        F.count("*").alias("n"), F.avg((F.col("a.score") > F.col("b.score")).cast("double")).alias("win_rate"), F.count_if(F.col("a.score") == F.col("b.score")).alias("ties")
    )


def bland_altman(pairs: DataFrame, tolerance: float) -> DataFrame:
    d = F.col("pred") - F.col("gold")
    a = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.avg(F.abs(d)).alias("mae"), F.avg((F.abs(d) <= tolerance).cast("double")).alias("within"))
    return a.select("*", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def b_cubed(clusters: DataFrame) -> DataFrame:
    """clusters (id, pred, gold): B-cubed precision, recall and F, and purity, from counts per cell."""
    c = clusters.groupBy("pred", "gold").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.sum("n").over(Window.partitionBy("pred"))).withColumn("g", F.sum("n").over(Window.partitionBy("gold"))).withColumn("top", F.max("n").over(Window.partitionBy("pred")))
    total = F.sum("n")
    s = c.agg((F.sum(F.col("n") * F.col("n") / F.col("p")) / total).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("g")) / total).alias("recall"), (F.sum(F.col("top") * F.col("n") / F.col("p")) / total).alias("purity"))
    pairs = lambda x: x * (x - 1) / 2
    both = c.agg(F.sum(pairs(F.col("n"))).alias("b"))
    one, other = c.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("x")), c.groupBy("gold").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("y"))
    return s.crossJoin(both).crossJoin(one).crossJoin(other).select(
        "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "purity",
        ratio(F.col("b"), F.col("x"), 1.0).alias("pair_precision"), ratio(F.col("b"), F.col("y"), 1.0).alias("pair_recall"),
    )
