"""Product codes of vectors: Lloyd's rounds that move only what changed.

Vectors become integers and are cut into parts; each part position has a codebook. The assignments of a round are written
beside the vectors, the sums and counts behind each entry are a small running table, and a round adds to it only the
vectors' parts whose assignment changed, once with a plus at the new entry and once with a minus at the old one. Workers
add up what their rows contribute, so that a task shuffles one row for each entry that gained or lost anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import storage
from .common import cut, sliced

#: Integers of greater size would leave 64 bits when their distances are squared and summed.
LARGEST = 2**28


def integers(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """vec_id, label, x (floor of scale times each component) of the vectors that are whole: not null, and all components finite numbers."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & whole).select(
        "vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"),
    )


class Codebooks:
    """Entries by part: parts x entries x width integers; at most a few thousand numbers, whatever the input."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # int64
        self.largest = int(np.abs(entries).max(initial=0))

    @classmethod
    def of_rows(cls, rows: list[list[int]], parts: int) -> Codebooks:
        x = np.array(rows, dtype=np.int64)
        return cls(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows x parts x width integers: the nearest entry's index, the lower one of ties, and its squared distance."""
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        if largest > LARGEST:
            raise ValueError(f"vector_codes: a component's integer has size {largest}, over {LARGEST}")
        exact = x.shape[2] * (2 * largest) ** 2 < 2**53  # then float arithmetic is exact too, and many times faster
        kind = np.float64 if exact else np.int64
        code, dist = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.int64)
        for p, entries in enumerate(self.entries.astype(kind)):
            own = x[:, p].astype(kind)
            d = (own * own).sum(1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(1)
            code[:, p] = d.argmin(1)  # the first of equals
            dist[:, p] = d.min(1)
        return code, dist

    def moved(self, sums: dict[tuple[int, int], list[int]]) -> Codebooks:
        """Each entry at its parts' mean, rounded down: sums has the count and the sums of the entries in use. The others stay."""
        entries = self.entries.copy()
        for (p, e), (n, *s) in sums.items():
            if n:
                entries[p, e] = [v // n for v in s]
        return Codebooks(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """One round over rows (vec_id, label, x, code): the same with the new code, then for each task what its rows contribute.

    Contributions are rows with `entry`, part * 256 + index, and `change`: how many parts more, and the sums that came with them.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField(n, kinds[n]) for n in ("vec_id", "label", "x", "code")] + [T.StructField("entry", T.IntegerType()), T.StructField("change", T.ArrayType(T.LongType()))])
    parts, many, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, many, width + 1), np.int64)
        kinds = None
        for batch in sliced(batches, 4096):
            x = _matrix(batch.column(2), parts)
            code, _ = books.nearest(x)
            before = batch.column(3)
            known = np.array(before.is_valid())
            old = np.zeros_like(code)
            if known.any():
                old[known] = np.frombuffer(b"".join(before.drop_null().to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                gone = known & (old[:, p] != code[:, p])
                for at, sign, index in ((gone | ~known, 1, code), (gone, -1, old)):
                    own = np.concatenate([np.ones((int(at.sum()), 1), np.int64), x[at, p]], axis=1)
                    np.add.at(change[p], index[at, p], sign * own)
            n, kinds = len(code), [f.type for f in batch.schema]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                names=out.names,
            )
        at = [(p, e) for p in range(parts) for e in range(many) if change[p, e].any()]
        if at:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(at), k) for k in kinds), pa.array([p * 256 + e for p, e in at], pa.int32()), pa.array([change[p, e].tolist() for p, e in at], pa.list_(pa.int64()))],
                names=out.names,
            )

    return rows.mapInArrow(run, out)


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code: bytes in part order, error) of every whole vector, and the codebooks.

    Codebooks begin as the parts of the vectors with the smallest ids; equal ids go by their integers, null ids come last. A
    round in which nothing changed ends the rounds, since the rest would change nothing either.

    Defined results: vectors that are null or hold a null, infinite or undefined component are dropped, and so are
    vectors of another length than most have (ties: the greater length) or whose length is no multiple of parts; repeated
    rows are vectors of their own; with fewer vectors than entries the codebooks are shorter; null labels and ids are kept;
    an empty table gives an empty table. A component of over LARGEST / scale in size stops the work with an error that names it.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte")
    spark = vectors.sparkSession
    x = integers(vectors, scale)
    length = x.groupBy(F.size("x").alias("n")).count().where(f"n > 0 AND n % {parts} = 0").orderBy(F.desc("count"), F.desc("n")).first()
    kinds = {f.name: f.dataType for f in x.schema}
    if length is None:
        schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return spark.createDataFrame([], schema), None
    x = x.where(F.size("x") == length["n"])
    books = Codebooks.of_rows([r["x"] for r in x.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()], parts)
    state, sums, old = x.withColumn("code", F.lit(None).cast("binary")), None, None
    for _ in range(rounds):
        written = cut(assign(state, books))
        path = storage.written[-1]
        change = written.where("entry IS NOT NULL").select("entry", F.posexplode("change").alias("at", "v"))
        state = written.where("entry IS NULL").select("vec_id", "label", "x", "code")
        if old:
            storage.delete(spark, old)  # the round before, all of which the new table holds
        old = path
        if change.isEmpty():
            break
        sums = cut((change if sums is None else sums.unionByName(change)).groupBy("entry", "at").agg(F.sum("v").alias("v")))
        books = books.moved(_by_entry(sums))
    kinds = T.StructType([f for f in state.schema if f.name in ("vec_id", "label")] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            code, dist = books.nearest(_matrix(batch.column(2), parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(dist.sum(1))], names=kinds.names)

    coded = cut(state.select("vec_id", "label", "x").mapInArrow(last, kinds))
    storage.delete(spark, old)
    return coded, books


def _by_entry(sums: DataFrame) -> dict[tuple[int, int], list[int]]:
    """parts x entries x (width + 1) numbers in all."""
    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.collect():
        out.setdefault(divmod(r["entry"], 256), {})[r["at"]] = r["v"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: error summed over equal labels, nulls together. Sums first, so that a frequent label costs no more."""
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def hex_code(code: Column) -> Column:
    return F.lower(F.hex(code))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same for the table embeddings as SQL for DuckDB, every round over all vectors."""
    ctes = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, x) AS rid, x FROM (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)))""",
        f"v AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v FROM k, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v AS c FROM v WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT rid, v.p, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d "
            f"FROM v JOIN c{r} c ON c.p = v.p) GROUP BY rid, p)"
        )
        if r < rounds:
            ctes.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM "
                f"(SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT a.p, a.best.e AS e, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} a JOIN v USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"
            )
    return "WITH " + ",\n".join(ctes) + f""",
f AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, b.s AS codebooks_sha256 FROM k JOIN f USING (rid) CROSS JOIN b"""
