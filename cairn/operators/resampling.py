"""Permutation tests and bootstrap intervals: seeded weights of every row in every replicate, as one aggregation over all replicates.

A weight is a hash of the row's key and the replicate's number, so it doesn't depend on how rows are dealt, and no row is
copied: a task adds up its rows' share in all replicates and hands on one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut

#: Where a Poisson variable of mean 1 passes from one count to the next.
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800, 479001600], float))


def mixed(keys: np.ndarray, number: int) -> np.ndarray:
    """64 well mixed bits of each key for a replicate (the finish of splitmix64)."""
    z = keys + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _per_replicate(rows: DataFrame, replicates: int, add) -> DataFrame:
    """(replicate, total, weight) over rows (key, x): add(keys, x, first, last) gives the two sums of those replicates for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((replicates, 2)), False
        for batch in batches:
            keys, x = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            some |= len(keys) > 0
            for first in range(0, replicates, 64):
                last = min(replicates, first + 64)
                sums[first:last] += add(keys, x, first, last)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1]))], names=["replicate", "total", "weight"])

    kinds = "replicate long, total double, weight double"
    return rows.mapInArrow(run, kinds).groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def _keyed(rows: DataFrame, key: list[str], value: str, seed: int) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), *key).alias("key"), F.col(value).cast("double").alias("x"))


def permutation(pairs: DataFrame, key: list[str], most_exact: int = 20, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """One row for pairs (key, a, b): n, observed_diff (mean of a - b), two-sided p_value of flipping signs, exact, n_resamples.

    Up to most_exact pairs all flips are gone through; beyond, replicates seeded ones. Pairs with a null are left out; without any pair the
    difference is null and p 1.
    """
    d = pairs.withColumn("_d", F.col("a").cast("double") - F.col("b").cast("double"))
    rows = cut(_keyed(d, key, "_d", seed))
    n, mean = rows.agg(F.count("*"), F.avg("x")).first()
    kinds = "n long, observed_diff double, p_value double, exact boolean, n_resamples long"
    spark = pairs.sparkSession
    if not n:
        return spark.createDataFrame([(0, None, 1.0, True, 1)], kinds)
    if n <= most_exact:
        x = np.sort(np.array([r.x for r in rows.collect()]))
        total = np.zeros(1)
        for v in x:
            total = np.concatenate([total + v, total - v])
        return spark.createDataFrame([(n, mean, float((np.abs(total / n) >= abs(mean) - 1e-12).mean()), True, len(total))], kinds)

    def add(keys: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
        bits = mixed(keys, first // 64)
        up = np.array([x[(bits >> np.uint64(k)) & np.uint64(1) == 1].sum() for k in range(last - first)])
        return np.stack([2 * up - x.sum(), np.full(last - first, len(x), float)], axis=1)

    hit = F.abs(F.col("total") / n) >= abs(mean) - 1e-12
    return _per_replicate(rows, replicates, add).agg(F.avg(hit.cast("double")).alias("p_value")).select(F.lit(n).cast("long").alias("n"), F.lit(mean).alias("observed_diff"), "p_value", F.lit(False).alias("exact"), F.lit(replicates).cast("long").alias("n_resamples"))


def bootstrap(rows: DataFrame, key: list[str], value: str, confidence: float = 0.95, replicates: int = 1_000, seed: int = 0) -> DataFrame:
    """One row for rows (key, value): n, the mean, and the bounds between which it falls in `confidence` of the replicates, each of which takes every row a Poisson number of times.

    Bounds are percentiles with linear interpolation, never beyond the mean. Nulls are left out; without a row all but n are null.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    known = cut(_keyed(rows, key, value, seed))

    def add(keys: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.empty((last - first, 2))
        for r in range(first, last):
            w = np.searchsorted(_POISSON, (mixed(keys, r) >> np.uint64(11)).astype(float) / 2**53, side="right")
            out[r - first] = w @ x, w.sum()
        return out

    mean = F.try_divide(F.col("total"), F.col("weight"))
    tail = (1 - confidence) / 2
    per = _per_replicate(known, replicates, add).select(mean.alias("m")).where("m IS NOT NULL")
    ends = per.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    point = known.agg(F.count("*").alias("n"), F.avg("x").alias("point"))
    return point.crossJoin(F.broadcast(ends)).select("n", "point", F.least("low", "point").alias("lower"), F.greatest("high", "point").alias("upper"))  # one row each
