"""Quality classifier from weak labels.

Heuristic labellers vote on every document: clean, junk, toxic or nothing. Expectation-maximisation over the
counts of all vote patterns of the corpus estimates how often each labeller is right, and with these the
probability of each class for a pattern. Those probabilities train a hashed linear scorer on a bounded sample
of documents, which then scores all of them by their whole texts.

Insults are listed for English alone. The words that mark toxic texts of other languages are learned, language by
language, from a bounded sample of labelled documents. A labeller abstains from texts of a language that it
doesn't know, and that counts neither way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .quality_rules import FEATURES, STATS, features, text_stats

CLASSES = ("clean", "junk", "toxic")
CLEAN, JUNK, TOXIC = 1, 2, 3  # votes; 0 abstains
STRANGE = 4  # abstains for want of the language, which says nothing of the text; shown as 0
#: Insults, as persons and as judgements: two overlapping labellers.
PERSONS = frozenset("clown creep cretin freak idiot idiots imbecile loser losers moron morons scum vermin weirdo".split())
JUDGEMENTS = frozenset("contemptible disgusting filthy garbage pathetic repulsive revolting sickening stupid trash worthless".split())
LISTED = "en"  # the language of both
LETTERS = re.compile(r"[^\W\d_]+")
#: For each statistic: clean up to the first number and junk above the second, and the kind of fault that this is.
LIMITS = {
    "symbols": (0.05, 0.25, "noise"), "symbol_share": (0.01, 0.05, "noise"),
    "upper": (0.15, 0.3, "shouting"), "bangs": (0.1, 0.4, "shouting"),
    "bars": (0.0, 0.2, "table"), "bar_share": (0.0, 0.03, "table"),
    "repeated": (0.2, 0.5, "repetition"), "dup_lines": (0.02, 0.1, "repetition"), "sameness": (0.5, 0.7, "repetition"),
}
LABELLERS = {k: kind for k, (_, _, kind) in LIMITS.items()} | {"length": "noise", "word_length": "noise", "persons": "toxic", "judgements": "toxic", "insults": "toxic", "marked": "toxic", "much_marked": "toxic"}
#: What a document may be; all faults but the last are junk. A document of one kind often shows it to few labellers.
KINDS = ("clean", "noise", "shouting", "table", "repetition", "toxic")
AS_CLASS = np.array([[1, 0, 0]] + [[0, 1, 0]] * (len(KINDS) - 2) + [[0, 0, 1]], dtype=float)


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def votes(text: str | None, lang: str | None = LISTED, marks: dict[str, frozenset[str]] | None = None) -> bytes:
    """One vote of each of LABELLERS; marks are the words of markers()."""
    stats = text_stats(text)
    own = dict(zip(FEATURES, features(np.array([stats]))[0], strict=True))
    n, letters, bars = stats[0], max(1, stats[1]), stats[STATS.index("n_bar")]
    own |= {"symbol_share": (stats[2] - bars) / letters, "bar_share": bars / letters, "sameness": 1 - own["distinct"] if 30 <= n <= 3000 else 0.0}
    own["symbols"] -= bars / max(1, n)
    out = [CLEAN if own[k] <= low else JUNK if own[k] > high else 0 for k, (low, high, _) in LIMITS.items()]
    out.append(CLEAN if n >= 50 else 0)
    out.append(CLEAN if 3 <= own["word_length"] <= 9 else JUNK if n and not 2 <= own["word_length"] <= 15 else 0)
    found = words(text)
    persons, judgements = sum(map(PERSONS.__contains__, found)), sum(map(JUDGEMENTS.__contains__, found))
    quiet, clean = (0, CLEAN) if lang == LISTED else (STRANGE, STRANGE)
    out += [TOXIC if persons else quiet, TOXIC if judgements else quiet]
    total = persons + judgements
    out.append(TOXIC if total else clean)
    known = (marks or {}).get(lang)
    met = len(known.intersection(found)) if known else 0
    out += [TOXIC if met > 1 else 0 if met else CLEAN, TOXIC if met > 2 else STRANGE if met else 0] if known else [STRANGE, STRANGE]  # one alone is often chance, and a short text can't have many
    return bytes(out)


def markers(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, least: int = 4, fewest: int = 5, share: float = 0.1, chance: float = 0.05, most: int = 5_000, seed: int = 11) -> dict[str, frozenset[str]]:
    """Words that mark toxic texts, for each language but LISTED.

    They are in at least a share of the language's toxic texts and in least of them, and in other texts at most
    chance as often. At most max_labels labelled documents are read, chosen by a seeded hash of doc_id, copies of
    a text count once, and at most the most frequent words are kept. A language with fewer than fewest words, as few
toxic labels give, has none.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labels)
    )
    own = docs.where(F.col("lang") != LISTED).select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # max_labels rows of two numbers
    own = own.groupBy("lang", "text").agg(F.max("toxic").alias("toxic"))

    def each(batches):
        for batch in batches:
            found = [sorted(set(words(t))) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([w for f in found for w in f], pa.string())], names=["lang", "toxic", "word"])

    own = cut(own)
    texts = own.groupBy("lang").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))  # a row for each language
    met = own.mapInArrow(each, "lang string, toxic int, word string").groupBy("lang", "word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
    rate = F.col("t") / F.col("n1")
    good = met.where(F.col("t") >= least).join(texts, "lang").where((rate >= share) & ((F.col("f") + 0.5) / (F.col("n0") + 1) < chance * rate))
    out: dict[str, set[str]] = {}
    for row in good.orderBy(F.desc("t"), "f", "lang", "word").limit(most).collect():
        out.setdefault(row["lang"], set()).add(row["word"])
    return {lang: frozenset(found) for lang, found in out.items() if len(found) >= fewest}


@dataclass(frozen=True)
class Labels:
    """Class shares, and for each labeller the probability of each vote, nothing included, in each class."""

    prior: np.ndarray
    right: np.ndarray  # labeller x class x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        score = np.tile(np.log(self.prior), (len(patterns), 1))
        for k, theta in enumerate(self.right):
            score += np.log(np.column_stack([theta, np.ones(len(theta))])[:, patterns[:, k]]).T
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        return self.posterior(patterns) @ AS_CLASS


def _start(aim: str) -> np.ndarray:
    """A labeller before any data: it sees six tenths of the faults that it looks for and is seldom wrong."""
    quiet, fault = np.array([0.45, 0.55, 0.0, 0.0]), np.zeros(4)
    fault[TOXIC if aim == "toxic" else JUNK] = 1
    rows = np.array([0.4 * quiet + 0.6 * fault if kind == aim else 0.998 * quiet + 0.002 * fault for kind in KINDS])
    return (rows + 1e-4) / (rows + 1e-4).sum(axis=1, keepdims=True)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, strength: float = 200.0) -> Labels:
    """Expectation-maximisation from _start(), which counts as much as strength documents of each kind."""
    start = np.array([_start(aim) for aim in LABELLERS.values()])
    got = Labels(np.array([0.8] + [0.2 / (len(KINDS) - 1)] * (len(KINDS) - 1)), start)
    for _ in range(rounds):
        share = got.posterior(patterns) * counts[:, None]
        prior = (share.sum(axis=0) + 1) / (share.sum() + len(KINDS))
        seen = strength * start
        for j in range(len(start)):
            for v in range(4):
                seen[j, :, v] += share[patterns[:, j] == v].sum(axis=0)
        got = Labels(prior, seen / seen.sum(axis=2, keepdims=True))
    return got


class Hashed:
    """Sparse features of texts: which words a text has, and how often each shape of words occurs."""

    def __init__(self, bits: int):
        self.mask, self.known, self.shapes = (1 << bits) - 1, {}, {}

    def _of(self, word: bytes) -> tuple[int, int]:
        at = xxhash.xxh64_intdigest(word.lower().strip(b".,;:!?\"'()[]*$%&#|"), 1) & self.mask
        shape = re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", word)))[:12]
        found = at, xxhash.xxh64_intdigest(shape, 2) & self.mask
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different words, the different shapes, and each shape's share of the words."""
        known, of = self.known, self._of
        pairs = np.array([known.get(w) or of(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], dtype=np.int64).reshape(-1, 2)
        shapes, often = np.unique(pairs[:, 1], return_counts=True)
        return np.unique(pairs[:, 0]), shapes, (often / max(1, len(pairs))).astype(np.float32)


def weighted(words: np.ndarray, shapes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's features."""
    return np.concatenate([words, shapes]), np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), 4.0 * share])


@dataclass(frozen=True)
class Scorer:
    weight: np.ndarray  # feature x class
    bias: np.ndarray
    bits: int

    def __call__(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        score = value @ self.weight[at] + self.bias
        score = np.exp(score - score.max())
        return score / score.sum()

    def of_batch(self, words: pa.ListArray, shapes: pa.ListArray, share: pa.ListArray) -> np.ndarray:
        """The classes' probabilities of many documents, each list summed at once."""

        def sums(lists: pa.ListArray, value: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            ends = lists.offsets.to_numpy().astype(np.int64)
            rows = self.weight[lists.values.to_numpy()[ends[0] : ends[-1]]].astype(float)
            total = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(rows if value is None else rows * value[ends[0] : ends[-1], None], axis=0)])
            return total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]], np.diff(ends)

        own, n = sums(words, None)
        score = own / np.sqrt(np.maximum(n, 1))[:, None] + 4.0 * sums(shapes, share.values.to_numpy())[0] + self.bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int, share: np.ndarray, steps: int = 60_000, rate: float = 0.1, least: int = 5, seed: int = 3) -> Scorer:
    """Multinomial logistic regression on probabilities, by AdaGrad, one document at a time.

    It goes over the sample as often as makes about so many steps, six times at least and sixty at most.
    Features that fewer than least documents have keep no weight, or rare words would learn single documents.
    share is that of each class in all documents; the scores are corrected for that in the sample.
    """
    k = len(CLASSES)
    weight, seen, bias = np.zeros((1 << bits, k)), np.full((1 << bits, k), 1e-3), np.zeros(k)
    often = np.zeros(1 << bits, dtype=np.int64)
    for at, _, _ in rows:
        often[at] += 1
    kept = [(at[often[at] >= least], value[often[at] >= least], target) for at, value, target in rows]
    draw = np.random.default_rng(seed)
    for _ in range(max(6, min(60, steps // max(1, len(kept))))):
        for i in draw.permutation(len(kept)):
            at, value, target = kept[i]
            gap = target - Scorer(weight, bias, bits)(at, value)
            grad = value[:, None] * gap
            seen[at] += grad**2
            weight[at] += rate * grad / np.sqrt(seen[at])
            bias += 0.01 * gap
    sample = np.mean([target for _, _, target in rows], axis=0) if rows else share
    return Scorer(weight.astype(np.float32), bias + np.log(np.maximum(share, 1e-6) / np.maximum(sample, 1e-6)), bits)


def classify(docs: DataFrame, labels: DataFrame | None = None, per_class: int = 3_000, bits: int = 18, seed: int = 5) -> DataFrame:
    """One row per document: doc_id, votes, weak_label, p_clean, p_junk, p_toxic, kept.

    Every text is read once (labelled ones once more, by markers()): its votes and hashed features are written, and all
    else works on these. The scorer is fitted on at most per_class different texts of each class that the labellers
    see, chosen by a seeded hash. The accuracies come from all documents, of which the driver sees only counts of
    vote patterns: some hundreds, and whatever the input no more than the labellers' votes allow (under five million).
    labels (doc_id, toxic) are read by markers() alone; without them, or in a language with few, toxic texts in
    other languages than English stay unseen.

    Defined results: a null text is empty; an empty text is junk to its labellers; repeated rows and ids stay and
    each text is scored by itself; an empty table gives an empty table; a table without lang is English, a null lang
    no known language; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(LISTED)).alias("lang"))
    marks = markers(docs, labels) if labels is not None else {}
    names = ["doc_id", "votes", "h", "words", "shapes", "share"]
    schema = docs.select("doc_id").schema.add("votes", "binary").add("h", "long").add("words", T.ArrayType(T.IntegerType())).add("shapes", T.ArrayType(T.IntegerType())).add("share", T.ArrayType(T.FloatType()))

    def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0)]).astype(kind)))

    def vote(batches):
        hashed = Hashed(bits)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(1).to_pylist()
                h = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), seed) >> 1 for t in texts]
                own = [votes(t, lang, marks) for t, lang in zip(texts, batch.column(2).to_pylist(), strict=True)]
                words_, shapes, share = zip(*map(hashed, texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(h, pa.int64()), lists(words_, np.int32), lists(shapes, np.int32), lists(share, np.float32)], names=names)

    voted = cut(docs.mapInArrow(vote, schema))
    counted = sorted((bytes(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    patterns = as_patterns([p for p, _ in counted])
    found = estimate(patterns, np.array([c for _, c in counted], dtype=float))
    scorer = _fit(voted, counted, found, per_class, bits)
    kinds = ["p_clean", "p_junk", "p_toxic"]
    out = docs.select("doc_id").schema.add("votes", "string").add("weak_label", "string")
    for name in kinds:
        out = out.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast((found, scorer))  # 2**bits x 3 numbers

    def score(batches):
        by_votes, model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                own = part.column(1).to_pylist()
                different = sorted(set(own))
                weak = dict(zip(different, by_votes.classes(as_patterns(different)).argmax(axis=1).tolist(), strict=True))
                got = model.of_batch(part.column(2), part.column(3), part.column(4))
                shown = {v: "".join(str(x % STRANGE) for x in v) for v in different}
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shown[v] for v in own], pa.string()), pa.array([CLASSES[weak[v]] for v in own], pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in got.T)], names=["doc_id", "votes", "weak_label", *kinds])

    return voted.select("doc_id", "votes", "words", "shapes", "share").mapInArrow(score, out).withColumn("kept", F.col("p_clean") >= 0.5)


def as_patterns(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), dtype=np.uint8).reshape(-1, len(LABELLERS)).astype(np.int64)


def _fit(voted: DataFrame, counted: list[tuple[bytes, int]], found: Labels, per_class: int, bits: int) -> Scorer:
    """The scorer, fitted on at most per_class different texts of each class.

    Only texts whose hash is low enough for some four times as many to be expected are looked at, and copies are
    one text before anything is sorted.
    """
    posterior = found.classes(as_patterns([p for p, _ in counted]))
    share, rows = found.prior @ AS_CLASS, []
    spark = voted.sparkSession
    kinds = spark.createDataFrame([(bytearray(p), int(q.argmax())) for (p, _), q in zip(counted, posterior, strict=True)], "votes binary, k int")
    for k in range(len(CLASSES)):
        n = sum(c for (_, c), q in zip(counted, posterior, strict=True) if int(q.argmax()) == k)
        if not n:
            continue
        limit = min(2**63 - 1, (4 * per_class + 1000) * 2**63 // n)
        low = voted.where((F.col("h") <= limit) & F.col("doc_id").isNotNull()).join(F.broadcast(kinds.where(F.col("k") == k)), "votes")  # one row for each pattern
        one = low.groupBy("h").agg(F.min(F.struct("votes", "words", "shapes", "share")).alias("d"))
        rows += one.orderBy("h").limit(per_class).select("h", "d.*").collect()
    rows.sort(key=lambda r: r["h"])
    known = {p: q for (p, _), q in zip(counted, posterior, strict=True)}
    sample = [(*weighted(np.array(r["words"], dtype=np.int64), np.array(r["shapes"], dtype=np.int64), np.array(r["share"], dtype=float)), known[bytes(r["votes"])]) for r in rows]
    return train(sample, bits, share)
