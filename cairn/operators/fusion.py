"""Rank fusion and score normalisation.

Runs are (query, source, source_pos, id, score). All ranking is within a query, so the work is dealt by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import minmax, zscore
from ..functions.storage import cut

RUN = ["query", "source"]


def with_rank(runs: DataFrame) -> DataFrame:
    """rank1: from 1, by descending score and then id, within each run."""
    return runs.withColumn("rank1", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("score"), "id")))


def rrf(runs: DataFrame, k: int = 60, base: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion. base is the number of the first rank: 1, or 0 in the hybrid and the weighted form."""
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(1.0))
    return with_rank(runs).groupBy("query", "id").agg(F.sum(weight / (k + F.col("rank1") - 1 + base)).alias("fused"))


def borda(runs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Every run of n gives n - rank0 points."""
    points = F.count("*").over(Window.partitionBy(*RUN)) - F.col("rank1") + 1
    weight = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0))
    return with_rank(runs).withColumn("points", weight * points).groupBy("query", "id").agg(F.sum("points").alias("fused"))


def condorcet(runs: DataFrame, block: int = 4096, spread: int = 8) -> DataFrame:
    """(query, id, wins, losses): majority comparisons of each two ids of a query over the sources that rank both.

    A query's ids are dealt into blocks, and each block meets each of its query as arrays of ranks: comparisons are counted in numpy and no pair becomes a
    row. They grow with the square of a query's ids; a task holds two blocks, and what it hands on is a row for each id and `spread` part of the other blocks.
    """
    ranks = with_rank(runs).withColumn("_n", F.count("*").over(Window.partitionBy(*RUN)))
    names = [r[0] for r in runs.select("source").distinct().orderBy("source").collect()]  # as many as there are signals
    if not names:
        return ranks.select("query", "id", F.lit(0).cast("long").alias("wins"), F.lit(0).cast("long").alias("losses"))
    own = [F.coalesce(F.max(F.when(F.col("source").eqNullSafe(F.lit(n)), F.col("rank1"))), F.lit(0)).alias(f"r{i}") for i, n in enumerate(names)]
    ids = ranks.groupBy("query", "id").agg(*own, F.max("_n").alias("_n")).where("_n > 1")  # ids that meet another one
    size = ids.groupBy("query").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    dealt = ids.join(size, "query").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = cut(dealt.groupBy("query", "block").agg(F.collect_list(F.struct("id", *(f"r{i}" for i in range(len(names))))).alias("rows")))
    packed = packed.select("query", "block", F.col("rows.id").alias("ids"), F.flatten(F.array(*(F.col(f"rows.r{i}") for i in range(len(names))))).alias("ranks"))
    left = packed.select("query", F.col("block").alias("a"), "ids", F.col("ranks").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    right = packed.select("query", F.pmod("block", F.lit(spread)).alias("part"), F.col("ranks").alias("others"))
    met = left.join(right, ["query", "part"]).select("query", "ids", "mine", "others")
    k = len(names)

    def count(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                query, ids = batch.column("query")[at : at + 1], batch.column("ids")[at].values
                mine, others = (batch.column(c)[at].values.to_numpy().astype(np.int32).reshape(k, -1) for c in ("mine", "others"))
                wins, losses = (np.zeros(len(ids), np.int64) for _ in range(2))
                for lo in range(0, len(ids), 128):
                    some = mine[:, lo : lo + 128, None]
                    margin = np.zeros((some.shape[1], others.shape[1]), np.int16)
                    for i in range(k):
                        a, b = some[i], others[i][None, :]
                        sign = (a < b).view(np.int8) - (a > b).view(np.int8)
                        if not (mine[i].all() and others[i].all()):  # 0: the source doesn't rank it
                            sign *= ((a > 0) & (b > 0)).view(np.int8)
                        margin += sign
                    wins[lo : lo + 128], losses[lo : lo + 128] = np.count_nonzero(margin > 0, 1), np.count_nonzero(margin < 0, 1)
                yield pa.RecordBatch.from_arrays([pa.array(query.to_pylist() * len(ids), query.type), ids, pa.array(wins), pa.array(losses)], ["query", "id", "wins", "losses"])

    schema = T.StructType([runs.schema["query"], runs.schema["id"], T.StructField("wins", T.LongType()), T.StructField("losses", T.LongType())])
    votes = met.mapInArrow(count, schema)
    return votes.groupBy("query", "id").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def comb(runs: DataFrame) -> DataFrame:
    """CombSUM, CombMNZ, CombANZ and CombMED of scores scaled to 0..1 in their run (0 where a run is flat)."""
    scaled = runs.withColumn("x", minmax("score", RUN, 0.0))
    total, n = F.sum("x"), F.count("*")
    return scaled.groupBy("query", "id").agg(total.alias("comb_sum"), (total * n).alias("comb_mnz"), (total / n).alias("comb_anz"), F.median("x").alias("comb_med"))


def dbsf(runs: DataFrame) -> DataFrame:
    """Distribution-based fusion: each score's place between its run's mean minus and plus 3 deviations, summed."""
    w = Window.partitionBy(*RUN)
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    x = F.when(sd > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - mean + 3 * sd) / (6 * sd)))).otherwise(F.lit(0.5))
    return runs.withColumn("x", x).groupBy("query", "id").agg(F.sum("x").alias("fused"))


def normalised(runs: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Every row with min-max, z-score and softmax of its score within its run."""
    w = Window.partitionBy(*RUN)
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return runs.withColumn("e", e).select("query", "source", "id", minmax("score", RUN, 0.0).alias("minmax"), zscore("score", RUN).alias("z"), (F.col("e") / F.sum("e").over(w)).alias("softmax"))


def weighted_sum(runs: DataFrame, weights: dict[str, float], scaled: bool = False) -> DataFrame:
    """(query, id, source, part, fused, share): weighted linear fusion of raw scores (scaled: of 0 to 1 in their run) and what each source adds to it."""
    if abs(sum(weights.values()) - 1) >= 1e-6:
        raise ValueError("weights have to sum to 1")
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")]
    rows = runs.withColumn("part", F.coalesce(weight, F.lit(0.0)) * (minmax("score", RUN, 0.0) if scaled else F.col("score")))
    fused = F.sum("part").over(Window.partitionBy("query", "id"))
    return rows.select("query", "id", "source", "part", fused.alias("fused"), F.when(fused != 0, F.col("part") / fused).otherwise(0.0).alias("share"))


def autocut(scores: DataFrame, ratio: float = 0.5, min_keep: int = 1) -> DataFrame:
    """scores (query, id, score) with keep_gap: up to the largest fall of the score from min_keep on, the first of equals; keep_ratio: at least ratio of the best."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    whole = Window.partitionBy("query")
    floor = max(1, min_keep)
    rows = scores.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w))
    best = F.max(F.when((F.col("rank") >= floor) & F.col("gap").isNotNull(), F.struct("gap", -F.col("rank")))).over(whole)
    rows = rows.withColumn("cut", F.coalesce(-best["col2"], F.count("*").over(whole)))
    return rows.select("query", "id", "score", "rank", (F.col("rank") <= F.col("cut")).alias("keep_gap"), ((F.col("score") >= ratio * F.max("score").over(whole)) | (F.col("rank") <= floor)).alias("keep_ratio"))


def team_draft(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(query, id, source, place): two runs take turns, a first, each with its best that is not taken yet.

    When a run has picked n, the other has picked as many or one less, so an id is a's if a comes to it first. Which of
    two comes first depends on what was skipped before; each query's two lists, short as candidates are, are gone through.
    """

    def draft(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [pdf[pdf["source"] == s].sort_values("rank1")["id"].tolist() for s in (a, b)]
        at, seen, out, turn = [0, 0], set(), [], 0
        while at[0] < len(lists[0]) or at[1] < len(lists[1]):
            own = lists[turn]
            while at[turn] < len(own) and own[at[turn]] in seen:
                at[turn] += 1
            if at[turn] < len(own):
                seen.add(own[at[turn]])
                out.append((own[at[turn]], (a, b)[turn]))
            turn = 1 - turn
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": [i for i, _ in out], "source": [s for _, s in out], "place": range(1, len(out) + 1)})

    ranked = with_rank(runs.where(F.col("source").isin(a, b))).select("query", "source", "id", "rank1")
    return ranked.groupBy("query").applyInPandas(draft, ranked.select("query", "id", "source").schema.add("place", "long"))


def round_robin(runs: DataFrame) -> DataFrame:
    """(query, id, place): runs in turn, each id at its first appearance."""
    first = with_rank(runs).groupBy("query", "id").agg(F.min(F.struct("rank1", "source_pos")).alias("at"))
    return first.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("at", "id")).alias("place"))


def diversify(hits: DataFrame, key: str, per_key: int = 2, limit: int = 20) -> DataFrame:
    """hits (query, id, score, key) with at most per_key of each key; a null key has no limit."""
    own = F.row_number().over(Window.partitionBy("query", key).orderBy(F.desc("score"), "id"))
    kept = hits.withColumn("_n", own).where(F.col(key).isNull() | (F.col("_n") <= per_key)).drop("_n")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return kept.withColumn("place", place).where(F.col("place") <= limit)


def fold_order(hits: DataFrame) -> DataFrame:
    """place: best hits at both ends, weakest in the middle (odd ranks ascending, then even ranks descending)."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    n = F.count("*").over(Window.partitionBy("query"))
    rows = hits.withColumn("rank", F.row_number().over(w)).withColumn("n", n)
    odd = (F.col("rank") + 1) / 2
    return rows.withColumn("place", F.when(F.col("rank") % 2 == 1, odd).otherwise(F.col("n") - F.col("rank") / 2 + 1).cast("long")).drop("n")


def mcda(matrix: DataFrame, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """matrix (alternative, criterion, value): weighted mean of min-max values (1 where flat), cost criteria turned round."""
    weight = F.create_map(*(F.lit(x) for c, (w, _) in criteria.items() for x in (c, w)))[F.col("criterion")]
    benefit = F.create_map(*(F.lit(x) for c, (_, b) in criteria.items() for x in (c, b)))[F.col("criterion")]
    w = Window.partitionBy("criterion")
    low, high = F.min("value").over(w), F.max("value").over(w)
    x = F.when(high == low, 1.0).when(benefit, (F.col("value") - low) / (high - low)).otherwise((high - F.col("value")) / (high - low))
    total = sum(v for v, _ in criteria.values())
    return matrix.withColumn("x", x * weight / total).groupBy("alternative").agg(F.sum("x").alias("score"))
