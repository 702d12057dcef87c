"""The byte network against plain convolutions, finite differences and held-out documents."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import byte_cnn, queries

from .test_operators import empty_docs, hard_docs

LANGS = ["aa", "bb", "cc"]


@pytest.fixture(scope="module")
def net():
    return byte_cnn.Network.start(LANGS, 32, 8, 5, np.random.default_rng(0))


def plain_chances(net, window):
    """Convolution by its definition."""
    pooled = []
    for w, filters, offsets in zip(byte_cnn.WIDTHS, net.filters, net.offsets, strict=True):
        seen = [np.einsum("ke,kef->f", net.embedding[list(window[i : i + w])], filters) for i in range(len(window) - w + 1)]
        pooled.append(np.max(seen, axis=0) + offsets)
    z = np.maximum(np.concatenate(pooled), 0) @ net.weights + net.biases
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_tables_are_convolutions(net):
    x = np.random.default_rng(1).integers(0, 256, (150, 32), dtype=np.uint8)
    assert np.allclose(net.chances(x), [plain_chances(net, bytes(r)) for r in x], atol=1e-5)


def test_gradients_are_slopes(net):
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 110, (6, 32), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -np.log(np.array([plain_chances(net, bytes(r)) for r in x])[np.arange(6), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[at], 1e-3
        p[at] = was + step
        up = loss()
        p[at] = was - step
        down = loss()
        p[at] = was
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.02, abs=1e-3)
    net.tables = []


def test_windows_hold_every_byte():
    texts = [b"", b"a", b"B" * 32, b"c" * 33, "日本".encode() * 40]
    x, counts = byte_cnn.windowed(texts, 32)
    assert counts.tolist() == [1, 1, 1, 2, 8]
    assert b"".join(bytes(r) for r in x).replace(b"\0", b"") == b"".join(texts).lower()


def test_training_sample_is_bounded_and_not_held_out(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"), F.when(F.col("id") % 3 == 0, "xx").when(F.col("id") % 3 == 1, "yy").alias("lang"))
    rows = byte_cnn.training_windows(docs, per_language=50).collect()
    assert {r.lang for r in rows} == {"xx", "yy"} and len(rows) == 100 and len({(r.lang, r.h) for r in rows}) == 100
    allowed = {f"text {i % 900}" for i in range(3000) if zlib.crc32(str(i).encode()) % 5}
    assert {bytes(w).decode() for r in rows for w in r.windows} <= allowed
    assert len(byte_cnn.training_windows(docs, per_language=50, most_texts=20).collect()) == 20


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_language(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.98
    for lang in {r.lang for r in held}:
        assert np.mean([got[r.doc_id].lang_pred == lang for r in held if r.lang == lang]) >= 0.95, lang
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_take_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = byte_cnn.train(docs, steps=150)
    own = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in byte_cnn.predict(docs.select("doc_id", "text"), net, ["doc_id"]).collect()}
    again = byte_cnn.predict(docs.withColumn("lang", F.lit("zz")).repartition(7).select("doc_id", "text", "lang"), byte_cnn.train(docs.repartition(3), steps=150), ["doc_id"])
    assert {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in again.collect()} == own


def test_hard_and_empty_tables(spark):
    docs = hard_docs(spark, ["x" * 1_000_000, "۱۲۳ 456"]).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = byte_cnn.language_id(docs, steps=20).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} == {"en", "und"}
    texts = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in got:
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred, r.score) == (("en", 1.0) if letters else ("und", 0.0))
        else:
            assert not r.held_out
    assert byte_cnn.language_id(empty_docs(spark)).collect() == []
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in byte_cnn.language_id(nameless).collect()} == {("und", 0.0)}
