"""Product codes against plain Lloyd rounds over all vectors."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows of (vec_id, embedding, label): [(vec_id, label, code, error)] and the codebooks."""
    kept = [(i, [math.floor(scale * v) for v in e], label) for i, e, label in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(nearest(cut(x, p), books[p])[1], []).append(cut(x, p))
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = []
    for i, x, label in kept:
        best = [nearest(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return sorted(out, key=repr), books


def coded(df, **options):
    got, books = vector_codes.encode(df, **options)
    rows = got.select("vec_id", "label", vector_codes.hex_code(F.col("code")), "error").collect()
    return sorted((tuple(r) for r in rows), key=repr), books.entries.tolist() if books else None


def hard(spark, n=120, width=16, seed=3):
    rnd = random.Random(seed)
    near = [[rnd.choice((-0.5, 0.0, 0.25)) for _ in range(width)] for _ in range(6)]
    rows = [(i, [v + rnd.uniform(-0.05, 0.05) for v in rnd.choice(near)], rnd.choice((None, 0, 1))) for i in range(n)]
    rows += [rows[3], (7, rows[9][1], 2), (None, rows[4][1], 1), (500, rows[5][1], None), (501, rows[5][1], None)]  # repeated rows, equal ids, a null id, copies
    rows += [(502, [0.0] * width, 1), (503, [-0.0] * width, 1), (-5, [1e-9] * width, 1), (-6, [-1e-9] * width, 1)]
    rows += [(600, None, 1), (601, [None] * width, 1), (602, [float("nan")] * width, 1), (603, [float("inf")] + [0.0] * (width - 1), 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("entry", F.lit("clash")).repartition(5)


@pytest.mark.parametrize("options", [{}, {"parts": 2, "entries": 5}, {"parts": 4, "entries": 200}, {"rounds": 1}, {"rounds": 40}])
def test_codes_equal_plain_rounds(spark, options):
    df = hard(spark)
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert coded(df, **options) == plain(rows, **options)


def test_codes_of_large_integers_are_exact(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, [rnd.uniform(-30_000, 30_000) for _ in range(8)], 0) for i in range(60)], SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    assert coded(df, entries=4) == plain(rows, entries=4)
    with pytest.raises(Exception, match="vector_codes: a component's integer"):
        coded(spark.createDataFrame([(1, [3e38] * 8, 0)], SCHEMA))


def test_few_no_and_odd_vectors(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == ([], None)
    assert coded(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0, 2.0], 1)], SCHEMA)) == ([], None)
    got, books = coded(spark.createDataFrame([(1, [0.1] * 8, 1), (2, [0.2] * 8, 1), (3, [0.2] * 24, 1)], SCHEMA))  # the last has another length
    assert [r[0] for r in got] == [1, 2] and len(books[0]) == 2


def test_a_round_adds_only_what_changed(spark):
    """Contributions of a second round: none for what stayed, a plus and a minus for what moved."""
    rows = [(i, [float(i)] * 8, 0) for i in range(10)]
    x = vector_codes.integers(spark.createDataFrame(rows, SCHEMA).coalesce(1)).withColumn("code", F.lit(None).cast("binary"))
    books = vector_codes.Codebooks.of_rows([[0] * 8, [4096 * 9] * 8], 8)
    first = vector_codes.assign(x, books).cache()
    kept = first.where("entry IS NULL").select("vec_id", "label", "x", "code")
    assert vector_codes.assign(kept, books).where("entry IS NOT NULL").count() == 0
    other = vector_codes.Codebooks.of_rows([[0] * 8, [4096 * 7] * 8], 8)  # 4 goes over
    moved = {r.entry: r.change for r in vector_codes.assign(kept, other).where("entry IS NOT NULL").collect()}
    assert moved == {p * 256 + e: [s, s * 4 * 4096] for p in range(8) for e, s in ((0, -1), (1, 1))}
    first.unpersist()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLES['op13_vector_codes']}) ORDER BY vec_id").fetchall()
    assert [tuple(r) for r in queries.op13_vector_codes(spark, sf).selectExpr(*names.split(", ")).orderBy("vec_id").collect()] == want
