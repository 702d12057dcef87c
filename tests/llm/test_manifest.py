"""The Merkle manifest against a plain one."""

from __future__ import annotations

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import manifest, queries

from .test_operators import digest, empty_docs, hard_docs

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain(rows, fan=8):
    """rows of (doc_id, source, lang, n_chars, text), one after the other."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: digest("".join(map(field, r)))
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, levels([leaf_of(r) for r in own])))
    top = levels([t[-1][0] for _, t in trees])

    out = []
    for at, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            acc = leaf_of((*r[:4], r[4].translate(lower))) if hit and r[4] is not None else tree[0][i]
            proof = ""
            for part, start in ((tree, i), (top, at)):
                for level in part[:-1]:
                    first = start - start % fan
                    run = level[first : first + fan]
                    proof += "".join(h for j, h in enumerate(run, first) if j != start)
                    acc = digest("".join(acc if j == start else h for j, h in enumerate(run, first)))
                    start //= fan
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], digest(proof), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def taken(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("most", [50_000, 30, 0])
def test_manifest_equals_a_plain_one(spark, most):
    docs = hard_docs(spark, ["LOUD " * 30, "É", "#/#", *(f"Text {i}" for i in range(90))])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, "de").when(F.col("doc_id") == 2, "日").otherwise("en"))
    docs = docs.unionByName(docs.where("doc_id IN (3, 4, 9)")).repartition(5)
    got = taken(manifest.prove(manifest.build(docs), most_broadcast=most))
    assert got == plain([tuple(r) for r in docs.select(*FIELDS).collect()])
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_many_and_no_documents(spark):
    assert taken(manifest.manifest(empty_docs(spark))) == []
    for n, fan in ((1, 8), (2, 8), (8, 8), (9, 8), (65, 8), (30, 2)):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.lit("AB").alias("text"))
        assert taken(manifest.manifest(docs, fan)) == plain([tuple(r) for r in docs.select(*FIELDS).collect()], fan)


def test_manifest_has_many_languages(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.concat(F.lit("l"), F.col("id") % 100).alias("lang"), F.lit(1).alias("n_chars"), F.lit("Ab").alias("text"))
    assert taken(manifest.manifest(docs)) == plain([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_manifest_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_manifest']})").fetchall()
    assert taken(queries.op12_manifest(spark, sf)) == sorted(want, key=repr)


def test_rows_are_given_out_in_blocks(spark):
    from cairn.llm.common import counted_out

    df = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, 8), (5, 9), (6, 30)], "id long, n long")
    got = sorted((r.id, r.i) for r in counted_out(df, "n", "i", block=8).collect())
    assert got == [(i, k) for i, n in ((2, 1), (3, 7), (4, 8), (5, 9), (6, 30)) for k in range(1, n + 1)]
