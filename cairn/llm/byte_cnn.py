"""Language of texts by a small convolutional network over bytes.

Byte embeddings, filters of several widths, the greatest response of each filter in a window, and a softmax over the
languages seen in training. It is trained in numpy on a bounded sample and applied to every window of every whole text.
A filter is linear in the bytes' embeddings, so its response is a sum of table look-ups, one for each pair of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import sliced

WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Texts are seen with A-Z in lower case.
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held_out(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the id as text; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Network:
    """A few thousand numbers: embedding (256 x e), filters by width (w x e x f) and their biases, softmax weights and biases."""

    languages: list[str]
    window: int
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    biases: np.ndarray
    tables: list[list[np.ndarray]] = field(default_factory=list, repr=False)

    @classmethod
    def start(cls, languages: list[str], window: int, embedding: int, filters: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        features = len(WIDTHS) * filters
        return cls(
            languages, window, draw(256, embedding, scale=0.5), [draw(w, embedding, filters, scale=(w * embedding) ** -0.5) for w in WIDTHS],
            [np.zeros(filters, np.float32) for _ in WIDTHS], draw(features, len(languages), scale=features**-0.5), np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.weights, self.biases]

    def tabulate(self) -> None:
        """For each width, what each pair of bytes (and a last single byte) adds to the filters' responses."""
        self.tables = []
        for filters in self.filters:
            single = [self.embedding @ f for f in filters]  # 256 x f
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, -1) for k in range(0, len(filters) - 1, 2)]
            self.tables.append(pairs + single[len(pairs) * 2 :])

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of windows x bytes: for each width, windows x positions x filters."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            n = self.window - w + 1
            for k, table in enumerate(tables):
                at = pair[:, 2 * k : 2 * k + n] if len(table) == 65536 else x[:, 2 * k : 2 * k + n]
                got = np.take(table, at, axis=0, mode="clip")
                y = got if k == 0 else np.add(y, got, out=y)
            yield y

    def chances(self, x: np.ndarray, windows: int = 64) -> np.ndarray:
        """Of windows x bytes: the languages' probabilities, some windows at a time."""
        if not self.tables:
            self.tabulate()
        out = np.empty((len(x), len(self.languages)))
        for i in range(0, len(x), windows):
            pooled = np.concatenate([y.max(axis=1) + b for y, b in zip(self.responses(x[i : i + windows]), self.offsets, strict=True)], axis=1)
            out[i : i + windows] = softmax(np.maximum(pooled, 0) @ self.weights + self.biases)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of parameters(). A filter's gradient comes from the place of its greatest response alone."""
        self.tabulate()
        places, tops = [], []
        for r, b in zip(self.responses(x), self.offsets, strict=True):
            at = r.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + b)
        pooled = np.concatenate(tops, axis=1)
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.weights + self.biases)
        error[np.arange(len(y)), y] -= 1
        error = (error / len(y)).astype(np.float32)
        back = (error @ self.weights.T) * (pooled > 0)
        embedding, filters, offsets = np.zeros_like(self.embedding), [], []
        for w, own, at, g in zip(WIDTHS, self.filters, places, np.split(back, len(WIDTHS), axis=1), strict=True):
            seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(w)]  # windows x filters x w
            filters.append(np.einsum("bf,bfke->kef", g, self.embedding[seen], optimize=True))
            offsets.append(g.sum(0))
            np.add.at(embedding, seen, g[:, :, None, None] * own.transpose(2, 0, 1)[None])
        return [embedding, *filters, *offsets, hidden.T @ error, error.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], embedding: int = 8, filters: int = 16, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam over seeded batches of windows, as many of each language; some are shortened, as the last windows of texts are."""
    rng = np.random.default_rng(seed)
    net = Network.start(languages, x.shape[1], embedding, filters, rng)
    by_language = [np.flatnonzero(y == k) for k in range(len(languages))]
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        label = rng.integers(len(languages), size=batch)
        rows = x[[rng.choice(by_language[k]) for k in label]].copy()
        for i in np.flatnonzero(rng.random(batch) < 0.3):
            rows[i, rng.integers(4, x.shape[1]) :] = 0
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), net.gradients(rows, label), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.tables = []
    return net


def windowed(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts in windows, zeros after a text's end; and how many windows each text has (one at least)."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], dtype=np.int64)
    padded = b"".join(t.translate(FOLD).ljust(n * window, b"\0") for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(padded, np.uint8).reshape(-1, window), counts


def training_windows(docs: DataFrame, per_language: int = 800, most_texts: int = 8_000, per_text: int = 3, window: int = 256, seed: int = 11) -> DataFrame:
    """(lang, h, windows) of at most per_language different texts of a language and most_texts in all, by a seeded hash of the text.

    Languages are the most frequent ones if there are more than most_texts. From each text per_text windows, evenly placed over
    the whole. Copies of a text count once. Texts over a threshold of their hash are left out before anything is shuffled.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = known.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    found = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("texts"), "lang").limit(most_texts).withColumn("languages", F.count("*").over(Window.partitionBy()))
    each = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(most_texts) / F.col("languages"))))
    shares = found.select("lang", each.alias("each"), F.least(F.lit(1.0), (4 * each + 40) / F.col("texts")).alias("share"))  # most_texts rows at most
    raw, n = F.col("text").cast("binary"), F.octet_length("text")
    last = F.greatest(F.lit(0), n - window)
    pieces = F.array_distinct(F.array(*(F.substring(raw, F.floor(last * k / max(1, per_text - 1)).cast("int") + 1, F.lit(window)) for k in range(per_text))))
    few = hashed.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(2**30)) < F.col("share") * 2**30)
    one = few.select("lang", "each", "h", pieces.alias("windows")).groupBy("lang", "each", "h").agg(F.min("windows").alias("windows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "windows"))
    return one.withColumn("rank", rank).where("rank <= each").select("lang", "h", "windows")


def train(docs: DataFrame, per_language: int = 800, most_texts: int = 8_000, window: int = 256, **options) -> Network | None:
    """A network for docs (doc_id, text, lang), learned from texts whose ids are not held out. The driver sees at most
    most_texts texts' windows (three of 256 bytes each). None if there is nothing to learn from."""
    rows = sorted(training_windows(docs, per_language, most_texts, window=window).collect(), key=lambda r: (r.lang, r.h))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    pieces = [(bytes(p), languages.index(r.lang)) for r in rows for p in r.windows]
    x = np.concatenate([windowed([p], window)[0][:1] for p, _ in pieces])
    return fit(x, np.array([k for _, k in pieces]), languages, **options)


def predict(docs: DataFrame, net: Network | None, carry: list[str]) -> DataFrame:
    """The columns carry of every row with lang_pred and score: the language of the greatest mean probability, and that mean.

    Windows count by their bytes. Texts that are null or have no letter are UNKNOWN with score 0, and so is all without a network.
    """
    out = T.StructType([*docs.select(*carry).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    n_carry = len(carry)
    readable = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            texts = batch.column(n_carry).to_pylist()
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None and net]
            if at:
                x, counts = windowed([texts[i] for i in at], net.window)
                ends = np.cumsum(counts)
                weight = np.full(len(x), net.window, float)
                weight[ends - 1] = [len(texts[i]) - (n - 1) * net.window for i, n in zip(at, counts, strict=True)]
                mean = np.add.reduceat(net.chances(x) * weight[:, None], ends - counts) / np.add.reduceat(weight, ends - counts)[:, None]
                best = mean.argmax(axis=1)
                score[at] = np.clip(mean[np.arange(len(at)), best], 0, 1)
                for i, k in zip(at, best, strict=True):
                    named[i] = net.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], pa.array(named), pa.array(score)], names=out.names)

    return docs.select(*carry, readable).mapInArrow(run, out)


def language_id(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    Defined results: equal texts get the same language; lang, source and doc_id take no part in a prediction; rows with a null
    id are not learned from and not held out; repeated rows are judged each; with one language known, every text with a letter
    is of it; with none, and for null texts and those without a letter, lang_pred is `und` and score 0; other columns are ignored.
    """
    net = train(docs, **options)
    slots = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slots, net, ["doc_id", "held_out"])
