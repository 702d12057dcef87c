"""k-means over all vectors, and an inverted file of its lists so that a search need not meet every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.storage import cut


def whole(vectors: DataFrame, unit: bool = False) -> DataFrame:
    """(id, v) of vectors whose components are all finite numbers, as doubles; as unit vectors if asked, without those of length 0.

    Vectors of another length than most (ties: the greater) are left out, as are null and empty ones.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & good & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (most["n"] if most else -1))
    if unit:
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("_l", length).where("_l > 0").select("id", F.transform("v", lambda x: x / F.col("_l")).alias("v"))
    return rows


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(rows: DataFrame, centres: np.ndarray, most: int = 1) -> DataFrame:
    """(id, v, list, distance): each vector with its nearest centre's number and squared distance, or with each of its `most` nearest ones."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = _square_distances(_matrix(part.column(1)), centres)
                near = np.argsort(d, axis=1, kind="stable")[:, :most]
                row = np.repeat(np.arange(len(d)), near.shape[1])
                found = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), pa.array(near.ravel().astype(np.int32)), pa.array(d[row, near.ravel()])], names=["id", "v", "list", "distance"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    return rows.select("id", "v").mapInArrow(run, schema)


def _round(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts, sums and inertia of one assignment: a task hands on one row for each centre."""
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, d + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = _matrix(batch.column(1).slice(at, 1024))
                dist = _square_distances(x, centres)
                near = dist.argmin(1)
                np.add.at(sums, near, np.column_stack([np.ones(len(x)), dist[np.arange(len(x)), near], x]))
        used = np.nonzero(sums[:, 0])[0]
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used].tolist(), pa.list_(pa.float64()))], names=["list", "s"])

    got = rows.select("id", "v").mapInArrow(run, "list int, s array<double>").select("list", F.posexplode("s").alias("at", "x")).groupBy("list", "at").agg(F.sum("x").alias("x")).collect()  # centres x (width + 2)
    out = np.zeros((k, d + 2))
    for r in got:
        out[r["list"], r["at"]] = r["x"]
    return out[:, 0], out[:, 2:], float(out[:, 1].sum())


def _start(rows: DataFrame, k: int, seed: int, rounds: int = 4) -> np.ndarray:
    """k-means||: in each round vectors are drawn with a chance that grows with their distance, twice k of them are expected; then k of these by weight."""
    first = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1).collect()
    centres = np.array([first[0]["v"]], float)
    for turn in range(1, rounds + 1):
        near = assigned(rows, centres)
        phi = near.agg(F.sum("distance")).first()[0] or 0.0
        if phi <= 0:
            break
        chance = F.pmod(F.xxhash64(F.lit(seed + turn), "id"), F.lit(2**53)) / float(2**53)
        drawn = near.where(chance < 2 * k * F.col("distance") / phi).select("v").distinct().orderBy("v").collect()
        if drawn:
            centres = np.unique(np.concatenate([centres, np.array([r["v"] for r in drawn], float)]), axis=0)
    weight, _, _ = _round(rows, centres)
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    best = _square_distances(centres, centres[chosen]).min(1)
    while len(chosen) < min(k, len(centres)):
        p = weight * best
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(p), p=p / p.sum())))
        best = np.minimum(best, _square_distances(centres, centres[chosen[-1:]])[:, 0])
    return centres[chosen]


def kmeans(rows: DataFrame, k: int, rounds: int = 30, tolerance: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, list[float]]:
    """Centres of rows (id, v; see whole()), and the inertia of each round, which never grows. A centre without vectors stays where it is.

    With fewer different vectors than k there are fewer centres; without any, none.
    """
    rows = cut(rows)
    if rows.isEmpty():
        return np.zeros((0, 0)), []
    centres, inertia = _start(rows, k, seed), []
    for _ in range(rounds):
        counts, sums, now = _round(rows, centres)
        inertia.append(now)
        if len(inertia) > 1 and inertia[-2] - now <= tolerance * max(now, 1e-300):
            break
        used = counts > 0
        centres = centres.copy()
        centres[used] = sums[used] / counts[used, None]
    return centres, inertia


def topic_map(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found (id, list, distance), labels (id, label): of each list its size, the label that most have (ties: the least), its share and the mean distance."""
    per = found.join(labels, "id").groupBy("list", "label").agg(F.count("*").alias("n"), F.sum("distance").alias("d"))
    of = per.groupBy("list").agg(F.sum("n").alias("size"), F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("top"), F.sum("d").alias("d"))
    return of.select("list", "size", "top.label", (F.col("top.n") / F.col("size")).alias("share"), (F.col("d") / F.col("size")).alias("mean_distance"))


def inverted_file_search(vectors: DataFrame, queries: DataFrame, lists: int, probes: int, top: int = 10, seed: int = 3) -> DataFrame:
    """(query, id, score, rank): of each query's nearest lists the vectors of greatest cosine. Every vector is in a list; equal scores go by id.

    vectors (id, v), queries (query, v). Lists come from kmeans() on all unit vectors.
    """
    rows = cut(whole(vectors, unit=True))
    centres, _ = kmeans(rows, lists, seed=seed)
    if not len(centres):
        return queries.select("query", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    filed = assigned(rows, centres).select("id", "v", "list")
    asked = assigned(whole(queries.withColumnRenamed("query", "id"), unit=True), centres, most=probes).select(F.col("id").alias("query"), F.col("v").alias("q"), "list")
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    met = asked.join(filed, "list").select("query", "id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top)
