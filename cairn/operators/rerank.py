"""Greedy selections that depend on what was taken before. Their groups are candidate lists, short by nature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import cut


def mmr(hits: DataFrame, lambda_: float = 0.7, k: int = 10, candidates: int = 100) -> DataFrame:
    """hits (query, id, score, v): maximal marginal relevance by cosine among each query's best candidates: query, id, place."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    short = hits.withColumn("_n", best).where(F.col("_n") <= candidates).drop("_n")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        v = np.stack([np.asarray(x, dtype=float) for x in pdf["v"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, ids, near, free, out = pdf["score"].to_numpy(float), pdf["id"].to_numpy(), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        while free.any() and len(out) < k:
            worth = np.where(free, np.round(lambda_ * score - (1 - lambda_) * near, 9), -np.inf)
            at = int(worth.argmax())
            out.append(ids[at])
            free[at] = False
            near = np.maximum(near, v @ v[at])
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": out, "place": range(1, len(out) + 1)})

    return short.groupBy("query").applyInPandas(pick, "query long, id long, place long")


def set_cover(offers: DataFrame, most: int | None = None) -> DataFrame:
    """offers (candidate, gap; cost of the candidate and weight of the gap, 1 where they are missing): place, candidate, gained, cost, covered.

    A greedy cover: the next candidate is the one whose newly covered weight is the most for its cost, of equals the
    cheaper one and then the lesser name. It ends when nothing is left that a candidate offers, or after most
    picks if that is given; covered is the share of all gaps' weight by then. Each pick is one aggregation over
    what is left. A cost that is not positive, or a negative weight, is a ValueError.
    """
    spark = offers.sparkSession
    for name in ("cost", "weight"):
        if name not in offers.columns:
            offers = offers.withColumn(name, F.lit(1.0))
    left = cut(offers.groupBy("candidate", "gap").agg(F.min("cost").cast("double").alias("cost"), F.max("weight").cast("double").alias("weight")))
    gaps = left.groupBy("gap").agg(F.max("weight").alias("w")).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.min("w").alias("low")).first()
    if not left.where("cost <= 0").isEmpty() or (gaps["low"] or 0) < 0:
        raise ValueError("costs must be positive and weights not negative")
    plan, done = [], 0.0
    while most is None or len(plan) < most:
        top = left.groupBy("candidate", "cost").agg(F.sum("weight").alias("gained")).orderBy(F.desc(F.col("gained") / F.col("cost")), "cost", "candidate").first()
        if top is None:
            break
        done += top["gained"]
        plan.append((len(plan) + 1, top["candidate"], top["gained"], top["cost"], done / gaps["w"] if gaps["w"] else 1.0))
        left = cut(left.join(left.where(F.col("candidate") == top["candidate"]).select("gap"), "gap", "left_anti"))
    return spark.createDataFrame(plan, "place long, candidate string, gained double, cost double, covered double")


def uncovered(offers: DataFrame, plan: DataFrame) -> DataFrame:
    """The gaps of offers that no candidate of a set_cover() plan closes."""
    closed = offers.join(plan.select("candidate"), "candidate", "left_semi").select("gap").distinct()
    return offers.select("gap").distinct().join(closed, "gap", "left_anti")
