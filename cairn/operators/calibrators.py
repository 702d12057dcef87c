"""Calibration of confidences: histogram bins, isotonic regression and Platt's sigmoid, from pairs (confidence, label)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp01
from ..functions.storage import cut


def histogram_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(low, value) of each of equal bins of 0..1: the share of true labels, 0 of an empty bin; 1.0 belongs to the last."""
    x = clamp01(F.col("confidence"))
    at = F.least(F.floor(x * bins), F.lit(bins - 1)).alias("bin")
    got = pairs.where("confidence IS NOT NULL AND label IS NOT NULL").groupBy(at).agg(F.avg(F.col("label").cast("double")).alias("value"))
    every = pairs.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(got, "bin", "left").select((F.col("bin") / bins).alias("low"), F.coalesce("value", F.lit(0.0)).alias("value"))


def pooled(low: list[float], high: list[float], pos: list[float], n: list[float]) -> list[tuple[float, float, float, float]]:
    """Adjacent violators pooled: blocks (low, high, pos, n) in order whose means pos / n grow."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(low, high, pos, n, strict=True):
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            a = out.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        out.append(block)
    return out


def isotonic(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(low, high, n, value): the blocks of confidences of the best fit that never falls; equal confidences are one point with their count.

    Confidences are dealt by range and pooled within each; a pool of pools is the pool of all, so the ranges' blocks are dealt again to a
    sixteenth as many ranges, until one is left. That one holds blocks, not rows: of yes-or-no labels some cube root of them.
    """
    schema = "low double, high double, pos double, n double"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            blocks = pooled(*(list(a) + b for a, b in zip(zip(*blocks, strict=True) if blocks else ((), (), (), ()), own, strict=True))) if blocks else pooled(*own)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*blocks, strict=True)], names=["low", "high", "pos", "n"])

    known = pairs.where("confidence IS NOT NULL AND label IS NOT NULL").select(clamp01(F.col("confidence")).alias("low"), F.col("label").cast("double").alias("y"))
    blocks = known.groupBy("low").agg(F.sum("y").alias("pos"), F.count("*").cast("double").alias("n")).select("low", F.col("low").alias("high"), "pos", "n")
    ranges = ranges or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = cut(blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low").mapInArrow(pool, schema))
        if ranges == 1:
            return blocks.select("low", "high", F.col("n").cast("long").alias("n"), (F.col("pos") / F.col("n")).alias("value"))
        ranges = max(1, ranges // 16)


def platt(pairs: DataFrame, rounds: int = 50, tolerance: float = 1e-9) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))): the likeliest for Platt's smoothed targets, by Newton steps that are halved until the loss falls.

    A step is one aggregation over the different confidences. Without pairs: (1, 0).
    """
    known = pairs.where("confidence IS NOT NULL AND label IS NOT NULL")
    per = cut(known.groupBy(F.col("confidence").cast("double").alias("x")).agg(F.sum(F.col("label").cast("double")).alias("pos"), F.count("*").cast("double").alias("n")))
    pos, n = per.agg(F.coalesce(F.sum("pos"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    if not n:
        return 1.0, 0.0
    yes, no = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    target = F.col("pos") * yes + (F.col("n") - F.col("pos")) * no
    x = F.col("x")

    def sums(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = F.lit(a) * x + F.lit(b)
        p = 1 / (1 + F.exp(-z))
        off, curve = F.col("n") * p - target, F.col("n") * p * (1 - p)
        loss = F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - target * z
        r = per.agg(F.sum(loss), F.sum(off * x), F.sum(off), F.sum(curve * x * x), F.sum(curve * x), F.sum(curve)).first()
        return r[0], np.array(r[1:3]), np.array([[r[3], r[4]], [r[4], r[5]]])

    at = np.array([0.0, float(np.log((pos + 1) / (n - pos + 1)))])
    loss, slope, curve = sums(*map(float, at))
    for _ in range(rounds):
        step, size = np.linalg.solve(curve + 1e-12 * np.eye(2), slope), 1.0
        while size > 1e-10:
            new = sums(*map(float, at - size * step))
            if new[0] < loss:
                break
            size /= 2
        else:
            break
        at, fell, (loss, slope, curve) = at - size * step, loss - new[0], new
        if fell < tolerance * max(1.0, abs(loss)):
            break
    return float(at[0]), float(at[1])
