"""Quality rules: document statistics, and gradient-boosted trees over them.

The statistics are counted over every whole text. The trees are fitted on a bounded, seeded sample of
labelled documents, flattened into numpy node arrays and applied to all documents in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = BASE + ["n_upper", "n_bang", "n_bar", "n_digits", "n_distinct"]
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
SPACES = [bytes([c]) for c in b" \t\n\v\f\r"]
#: Direction in which each feature may move the score: -1 means that more of it never helps.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1,
    "upper": -1, "bangs": -1, "bars": -1, "digits": 0, "distinct": 0,
}


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text; null has none of anything."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    n, repeated = len(words), 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(seen := Counter(windows)) < len(windows):
            upto = 0
            for i, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += i + 3 - max(upto, i)
                    upto = i + 3
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(text or "") - sum(map(raw.count, SPACES))
    symbols = sum(map(raw.count, SYMBOLS))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeated,
        upper, raw.count(b"!"), raw.count(b"|"), digits, len(set(words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES of rows of STATS, as shares of the words or characters."""
    n, chars, symbols, dup, repeat, upper, bang, bar, digits, distinct = stats.astype(float).T
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(n), chars / words, symbols / words, dup / words, repeat / words, upper / letters, bang / words, bar / words, digits / letters, distinct / words], axis=1)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2; leaves come last."""

    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray  # tree x inner node; a value up to it goes left
    value: np.ndarray  # tree x leaf
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting on binned features.

    A split on a constrained feature is taken only if its sides are in order, and its middle then bounds
    all that is below either side, so each tree is monotonic in that feature.
    """
    inner = 2**depth - 1
    p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    empty = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    if len(np.unique(y)) < 2:
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    score, made = np.full(len(x), bias), []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        members, bounds = {0: np.arange(len(x))}, {0: (-np.inf, np.inf)}
        for node in range(inner):
            rows, (low, high) = members.pop(node), bounds.pop(node)
            best = (1e-6, None)
            g, h = grad[rows].sum(), hess[rows].sum()
            for k, e in enumerate(edges):
                if not len(e) or not len(rows):
                    continue
                gl = np.bincount(binned[rows, k], grad[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(binned[rows, k], hess[rows], len(e) + 1).cumsum()[:-1]
                left, right = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = (gl * left - 0.5 * (hl + ridge) * left**2) + ((g - gl) * right - 0.5 * (h - hl + ridge) * right**2)
                whole = np.clip(g / (h + ridge), low, high)
                gain -= g * whole - 0.5 * (h + ridge) * whole**2
                gain[(hl < 1e-3) | (h - hl < 1e-3) | (monotone[k] * (right - left) < 0)] = -np.inf
                if (at := int(gain.argmax())) is not None and gain[at] > best[0]:
                    best = (gain[at], (k, at, left[at], right[at]))
            if best[1] is None:  # all rows go left, where the value is that of the node
                sides, limits = (rows, rows[:0]), ((low, high), (low, high))
            else:
                k, at, left, right = best[1]
                feature[node], threshold[node] = k, edges[k][at]
                side, mid = binned[rows, k] > at, (left + right) / 2
                sides = (rows[~side], rows[side])
                limits = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[k]]
            for child, own, bound in zip((2 * node + 1, 2 * node + 2), sides, limits, strict=True):
                if child < inner:
                    members[child], bounds[child] = own, bound
                else:
                    leaf = np.clip(grad[own].sum() / (hess[own].sum() + ridge), *bound)
                    value[child - inner] = rate * leaf
                    score[own] += rate * leaf
        made.append((feature, threshold, value))
    return Trees(*(np.array(v) for v in zip(*made, strict=True)), bias)


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns carry of every document beside its STATS."""
    fields = docs.select(*carry, "text").schema
    names = [f"_{s}" for s in STATS]
    out = docs.select(*carry).schema
    for name in names:
        out = out.add(name, "long")

    def run(batches):
        for batch in sliced(batches):
            got = np.array([text_stats(t) for t in batch.column(len(carry)).to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(c) for c in got.T)], names=[*carry, *names])

    assert len(fields) == len(carry) + 1
    return docs.select(*carry, "text").mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, seed: int = 7) -> Trees:
    """Trees for labels.quality. At most max_labels labelled documents are used, chosen by a seeded hash of doc_id.

    Of texts that share a labelled doc_id the one with the least statistics counts; it is chosen before anything
    reaches the driver, which sees one row for each of the chosen ids at most.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labels)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labels rows of two numbers
    one = F.struct(*(f"_{s}" for s in STATS))
    rows = measure(own, ["doc_id", "_quality"]).groupBy("doc_id", "_quality").agg(F.min(one).alias("s")).select("doc_id", "_quality", "s.*").toPandas().sort_values("doc_id")
    x = features(rows[[f"_{s}" for s in STATS]].to_numpy())
    return fit_trees(x, rows["_quality"].to_numpy(dtype=float), list(FEATURES.values()))


def verdicts(docs: DataFrame, trees: Trees, carry: list[str], least: float = 0.5) -> DataFrame:
    """Every document with its base statistics, base_failed, the trees' probability of good quality, and kept.

    A null or empty text has no words and fails the base rule. Repeated rows are judged alike, each on its own.
    """
    out = docs.select(*carry).schema
    for name, kind in (*((b, "long") for b in BASE), ("base_failed", "boolean"), ("quality", "double"), ("kept", "boolean")):
        out = out.add(name, kind)
    n_carry, names = len(carry), [f.name for f in out]
    at_text = n_carry

    def run(batches):
        for batch in sliced(batches):
            stats = np.array([text_stats(t) for t in batch.column(at_text).to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
            quality = 1 / (1 + np.exp(-trees.score(features(stats))))
            failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
            cols = [*(np.ascontiguousarray(stats[:, i]) for i in range(len(BASE))), failed, quality, ~failed & (quality >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], *(pa.array(c) for c in cols)], names=names)

    text = F.col("text").alias("_text")
    return docs.select(*carry, text).mapInArrow(run, out)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, quality, kept.

    Defined results: with no labels of both classes the trees say the same of every text, and only the base
    rule rejects; an empty table gives an empty table; extra columns of either table are ignored.
    """
    return verdicts(docs, fit(docs, labels, **options), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules() keeps."""
    trees = fit(docs, labels, **options)
    columns = docs.columns
    slots = [f"_c{i}" for i in range(len(columns))]  # any name may clash with a statistic's
    judged = verdicts(docs.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(columns, slots, strict=True)), F.col("text")), trees, slots)
    return judged.where("kept").select(*(F.col(s).alias(c) for c, s in zip(columns, slots, strict=True)))
