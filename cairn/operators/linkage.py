"""Entity resolution by Fellegi and Sunter's model: blocking rules, comparison levels, EM over counts of level patterns, clusters.

Pairs come from the union of several blocking rules, each an equi-join; a pair that an earlier rule gives is not given again.
Rows that agree in every compared and blocked column are one class with a count, so copies are never expanded into pairs.
The model is fitted on counts of patterns (one number for each combination of levels, a few hundred whatever the input).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.components import components
from ..functions.storage import cut, spread
from ..functions.strings import jaro_winkler


@dataclass(frozen=True)
class Comparison:
    """A column and its levels of agreement from the closest on; a pair that meets none is at level 0, one with a null at -1. Equal values meet the closest.

    With `tf` a pair that agrees exactly weighs more, the rarer their value is.
    """

    name: str
    levels: tuple[Callable[[Column, Column], Column], ...]
    tf: bool = False

    def level(self, equal: bool = False) -> Column:
        """With equal, of pairs that are known to have the same value: nothing is compared."""
        left, right = F.col(f"l_{self.name}"), F.col(f"r_{self.name}")
        if equal:
            return F.when(left.isNull(), -1).otherwise(len(self.levels))
        out = F.when(left.isNull() | right.isNull(), -1)
        for i, met in enumerate(self.levels):
            out = out.when(met(left, right), len(self.levels) - i)
        return out.otherwise(0)


def exact(name: str, tf: bool = False) -> Comparison:
    return Comparison(name, (lambda a, b: a == b,), tf)


def jaro_winkler_at(name: str, thresholds: tuple[float, ...] = (0.92, 0.85), tf: bool = False) -> Comparison:
    near = tuple((lambda a, b, t=t: jaro_winkler(a, b) >= t) for t in thresholds)
    return Comparison(name, (lambda a, b: a == b, *near), tf)


def within(name: str, shares: tuple[float, ...]) -> Comparison:
    """Numbers that are equal, or differ by no more than shares of the greater one."""
    near = tuple((lambda a, b, s=s: F.abs(a - b) <= s * F.greatest(F.abs(a), F.abs(b))) for s in shares)
    return Comparison(name, (lambda a, b: a == b, *near))


@dataclass(frozen=True)
class Model:
    """comparisons; rules and deterministic rules as lists of columns that must be equal; rules to train on."""

    comparisons: tuple[Comparison, ...]
    rules: tuple[tuple[str, ...], ...]
    deterministic: tuple[tuple[str, ...], ...]
    training: tuple[tuple[str, ...], ...]

    def columns(self) -> list[str]:
        names = [c.name for c in self.comparisons] + [n for rules in (self.rules, self.deterministic, self.training) for r in rules for n in r]
        return list(dict.fromkeys(names))


@dataclass
class Fit:
    """Probabilities of each level among matches (m) and others (u), of a match between two random rows, and what EM took."""

    m: dict[str, np.ndarray]
    u: dict[str, np.ndarray]
    prior: float
    rounds: list[int] = field(default_factory=list)


def classes(rows: DataFrame, model: Model, id_: str) -> tuple[DataFrame, DataFrame]:
    """(id, copies, columns) of one row for each combination of values, the least id; and members (id, of). Ids that are null are left out."""
    names = model.columns()
    kept = rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias("_id"), *names)
    one = cut(kept.groupBy(*names).agg(F.min("_id").alias("id"), F.count("*").alias("copies")))
    same = [kept[n].eqNullSafe(one[n]) for n in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return one, kept.join(one, on).select(F.col("_id").alias("id"), one["id"].alias("of"))


def _sided(one: DataFrame, side: str) -> DataFrame:
    return one.select(*(F.col(c).alias(f"{side}_{c}") for c in one.columns))


#: Pairs of one block that a task makes, about.
TASK_PAIRS = 500_000


def rule_pairs(one: DataFrame, rules: tuple[tuple[str, ...], ...], comparisons: tuple[Comparison, ...] = (), most: int = TASK_PAIRS) -> DataFrame:
    """Pairs (l_*, r_*) of classes that some rule brings together, each once, l_id < r_id, with `rule`, the first rule's number, and the levels of comparisons.

    A block of over `most` pairs is cut into parts of its left rows, each of which meets all of the block. Columns of a pair's rule are equal, so they are not compared.
    """
    out = None
    for at, rule in enumerate(rules):
        known = one.where(" AND ".join(f"{n} IS NOT NULL" for n in rule))
        sizes = known.groupBy(*rule).agg(F.count("*").alias("_k")).where(F.col("_k") > 1).withColumn("_parts", F.ceil(F.col("_k") * F.col("_k") / (2 * most)).cast("int"))
        dealt = known.join(sizes.drop("_k"), list(rule))
        left = _sided(dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts").select(*one.columns, "part"), "l")
        right = _sided(dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*one.columns, "part"), "r")
        on = (F.col("l_part") == F.col("r_part")) & (F.col("l_id") < F.col("r_id"))
        for name in rule:
            on = on & (F.col(f"l_{name}") == F.col(f"r_{name}"))
        for earlier in rules[:at]:
            met = F.lit(True)
            for name in earlier:
                met = met & (F.col(f"l_{name}") == F.col(f"r_{name}"))
            on = on & ~F.coalesce(met, F.lit(False))
        got = spread(left, *(f"l_{name}" for name in rule), "l_part").join(right, on).drop("l_part", "r_part").withColumn("rule", F.lit(at))
        got = _with_levels(got, comparisons, rule)
        out = got if out is None else out.unionByName(got)
    return out


def _inner(one: DataFrame, rule: tuple[str, ...] = ()) -> DataFrame:
    """A class with itself, where it has copies and the rule's columns are known."""
    known = F.col("copies") > 1
    for name in rule:
        known = known & F.col(name).isNotNull()
    some = one.where(known)
    return some.select(*(F.col(c).alias(f"{s}_{c}") for s in ("l", "r") for c in one.columns))


def _with_levels(pairs: DataFrame, comparisons: tuple[Comparison, ...], equal: tuple[str, ...] = ()) -> DataFrame:
    return pairs.withColumns({f"g_{c.name}": c.level(c.name in equal) for c in comparisons}) if comparisons else pairs


def _row_pairs() -> Column:
    """How many pairs of rows a pair of classes stands for."""
    return F.when(F.col("l_id") == F.col("r_id"), F.expr("l_copies * (l_copies - 1) div 2")).otherwise(F.col("l_copies") * F.col("r_copies"))


def patterns(one: DataFrame, comparisons: tuple[Comparison, ...], rules: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(g_<comparison>, ..., pairs): how many pairs of rows that some rule brings together show each pattern of levels, copies counted."""
    inner = None
    for at, rule in enumerate(rules):
        own = _inner(one, rule)
        for earlier in rules[:at]:
            met = F.lit(True)
            for name in earlier:
                met = met & F.col(f"l_{name}").isNotNull()
            own = own.where(~met)
        inner = own if inner is None else inner.unionByName(own)
    names = [f"g_{c.name}" for c in comparisons]
    every = rule_pairs(one, rules, comparisons).drop("rule").unionByName(_with_levels(inner, comparisons, tuple(c.name for c in comparisons)))
    return every.groupBy(*names).agg(F.sum(_row_pairs()).alias("pairs"))


def blocking_stats(one: DataFrame, rules: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(rule, blocks, largest, pairs, reduction): what each rule alone brings together, from the sizes of its blocks; no pair is made.

    reduction is 1 - pairs / all pairs. A look at `largest` before the join tells whether a rule is too coarse.
    """
    out = None
    all_rows = one.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    for at, rule in enumerate(rules):
        blocks = one.where(" AND ".join(f"{n} IS NOT NULL" for n in rule)).groupBy(*rule).agg(F.sum("copies").alias("n"))
        got = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
        got = got.select(F.lit("+".join(rule)).alias("rule"), "*", F.lit(at).alias("at"))
        out = got if out is None else out.unionByName(got)
    n = F.col("n").cast("double")
    return out.join(F.broadcast(all_rows)).select("at", "rule", "blocks", "largest", "pairs", F.coalesce(1 - F.try_divide(F.col("pairs").cast("double"), n * (n - 1) / 2), F.lit(0.0)).alias("reduction"))  # one row


def random_pairs(one: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` pairs of different classes, drawn without regard to any rule: rows in a seeded order, each with those a few places on.

    The sample is bounded by a parameter, and so is the one window that numbers it.
    """
    rows = max(2, int(np.sqrt(2 * most)))
    order = Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    taken = cut(one.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows).withColumn("at", F.row_number().over(order) - 1))
    n = taken.count()
    if n < 2:
        return _sided(one, "l").join(_sided(one, "r"), F.lit(False))
    left = _sided(taken, "l").withColumn("r_at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n // 2)), lambda d: F.pmod(F.col("l_at") + d, F.lit(n)))))
    if n % 2 == 0:  # the partner half way round would be met from either side
        left = left.where((F.pmod(F.col("r_at") - F.col("l_at"), F.lit(n)) < n // 2) | (F.col("l_at") < F.col("r_at")))
    return left.join(_sided(taken, "r"), "r_at").drop("l_at", "r_at")


def _counted(df: DataFrame, comparisons: tuple[Comparison, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their counts; as many rows as there are combinations of levels."""
    rows = sorted(tuple(r) for r in df.select(*(f"g_{c.name}" for c in comparisons), F.col("pairs").cast("double")).collect())
    table = np.array(rows, float).reshape(len(rows), len(comparisons) + 1)
    return table[:, :-1].astype(int), table[:, -1]


def em(gamma: np.ndarray, counts: np.ndarray, u: list[np.ndarray], prior: float, rounds: int = 200, tolerance: float = 1e-6, fixed_u: bool = True) -> tuple[list[np.ndarray], list[np.ndarray], float, int]:
    """m (and u unless it is fixed) by levels, the share of matches, and how many rounds were run. Levels of -1 say nothing.

    Starts from matches that agree: each level's m grows by ten from one to the next.
    """
    sizes = [len(x) for x in u]
    m = [10.0 ** np.arange(k) for k in sizes]
    m, u = [x / x.sum() for x in m], [x.copy() for x in u]
    done = 0
    for done in range(1, rounds + 1):
        match, other = np.full(len(counts), np.log(prior)), np.full(len(counts), np.log1p(-prior))
        for c in range(len(sizes)):
            seen = gamma[:, c] >= 0
            match[seen] += np.log(m[c][gamma[seen, c]])
            other[seen] += np.log(u[c][gamma[seen, c]])
        p = 1 / (1 + np.exp(np.clip(other - match, -700, 700)))
        changed = 0.0
        for c, k in enumerate(sizes):
            seen = gamma[:, c] >= 0
            for table, weight in ((m, p * counts), (u, (1 - p) * counts))[: 1 if fixed_u else 2]:
                got = np.bincount(gamma[seen, c], weight[seen], k)
                if got.sum() > 0:
                    new = np.maximum(got / got.sum(), 1e-9)
                    changed = max(changed, float(np.abs(new - table[c]).max()))
                    table[c] = new / new.sum()
        share = float(np.clip((p * counts).sum() / max(counts.sum(), 1e-300), 1e-12, 1 - 1e-12)) if len(counts) else prior
        changed, prior = max(changed, abs(share - prior)), share
        if changed < tolerance:
            break
    return m, u, prior, done


def fit(one: DataFrame, model: Model, recall: float = 0.9, most_random: int = 100_000, otherwise: float = 0.01, seed: int = 42) -> Fit:
    """u from random pairs, the prior from pairs that a deterministic rule finds (their count over recall, over all pairs), m by EM.

    A training rule's own columns agree in all its pairs, so it says nothing of their comparisons; m is the mean over the rules that say
    something, and stays at EM's start where none does. Levels that no random pair shows have half a pair.
    """
    sizes = {c.name: len(c.levels) + 1 for c in model.comparisons}
    gamma, counts = _counted(_with_levels(random_pairs(one, most_random, seed), model.comparisons).groupBy(*(f"g_{c.name}" for c in model.comparisons)).agg(F.sum(_row_pairs()).alias("pairs")), model.comparisons)
    u = {}
    for i, c in enumerate(model.comparisons):
        seen = gamma[:, i] >= 0
        got = np.bincount(gamma[seen, i], counts[seen], sizes[c.name]) + 0.5
        u[c.name] = got / got.sum()
    n = one.agg(F.sum("copies")).first()[0] or 0
    found = patterns(one, (), model.deterministic).agg(F.sum("pairs")).first()[0] or 0
    prior = float(np.clip(found / recall / max(1, n * (n - 1) / 2), 0, 0.5)) or otherwise
    trained: dict[str, list[np.ndarray]] = {c.name: [] for c in model.comparisons}
    rounds = []
    for rule in model.training:
        open_ = tuple(c for c in model.comparisons if c.name not in rule)
        gamma, counts = _counted(patterns(one, open_, (rule,)), open_)
        if not counts.sum() or not open_:
            continue
        got, _, _, took = em(gamma, counts, [u[c.name] for c in open_], 0.5)
        rounds.append(took)
        for c, m in zip(open_, got, strict=True):
            trained[c.name].append(m)
    m = {}
    for name, seen in trained.items():
        start = 10.0 ** np.arange(sizes[name])
        m[name] = np.mean(seen, axis=0) if seen else start / start.sum()
    return Fit(m, u, prior, rounds)


def scored(one: DataFrame, model: Model, fitted: Fit, least: float = 0.5) -> DataFrame:
    """(left_id, right_id, weight, probability) of pairs of classes at probability least or more. weight is log2 of the odds.

    The frequencies of values are counted, and joined to the classes before any pair is made.
    """
    with_tf = one
    for c in (c for c in model.comparisons if c.tf):
        counts = one.where(F.col(c.name).isNotNull()).groupBy(c.name).agg(F.sum("copies").alias("_n"))
        total = cut(counts).agg(F.sum("_n").alias("_all"))
        tf = counts.join(F.broadcast(total)).select(c.name, (F.col("_n") / F.col("_all")).alias(f"_tf_{c.name}"))  # one row
        with_tf = with_tf.join(tf, c.name, "left")
    pairs = rule_pairs(cut(with_tf), model.rules, model.comparisons)
    return pairs.withColumn("weight", _weight(model, fitted)).select(
        F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "weight", (1 / (1 + F.pow(F.lit(2.0), -F.col("weight")))).alias("probability"),
    ).where(F.col("probability") >= least)


def _weight(model: Model, fitted: Fit) -> Column:
    out = F.lit(float(np.log2(fitted.prior / (1 - fitted.prior))))
    for c in model.comparisons:
        m, u = fitted.m[c.name], fitted.u[c.name]
        g = F.col(f"g_{c.name}")
        own = F.when(g == -1, 0.0)
        for k in range(len(m)):
            value = F.lit(float(np.log2(m[k] / u[k])))
            if c.tf and k == len(m) - 1:
                value = F.lit(float(np.log2(m[k]))) - F.log2(F.col(f"l__tf_{c.name}"))
            own = own.when(g == k, value)
        out = out + own
    return out


def clusters(one: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster, probability): every row with the least id that its matches reach and the best probability in its cluster (null if it is alone)."""
    found = components(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    named = cut(one.select("id", "copies").join(found, F.col("id") == F.col("node"), "left").select("id", "copies", F.coalesce("component", "id").alias("cluster")))
    own = pairs.groupBy("left_id").agg(F.max("probability").alias("probability"))
    best = cut(own.join(named.select(F.col("id").alias("left_id"), "cluster"), "left_id").groupBy("cluster").agg(F.max("probability").alias("probability")))
    return members.join(named.select(F.col("id").alias("of"), "cluster", "copies"), "of").join(best, "cluster", "left").select("id", "cluster", F.when((F.col("copies") > 1) & F.col("probability").isNull(), 1.0).otherwise(F.col("probability")).alias("probability"))


def link(rows: DataFrame, model: Model, id_: str, threshold: float = 0.5, **options: float) -> tuple[DataFrame, DataFrame, Fit]:
    """Scored pairs of classes, every row's cluster, and the model.

    Defined results: rows with a null id are left out; a null in a compared column is no evidence, one in a rule's column meets nothing;
    rows alike in all columns are one class and one cluster; an empty table gives empty results. A rule's block is joined within
    itself, so its pairs grow with the square of its distinct rows: blocking_stats() tells before. Large blocks are
    cut into parts by rule_pairs().
    """
    one, members = classes(rows, model, id_)
    fitted = fit(one, model, **options)
    pairs = cut(scored(one, model, fitted, threshold))
    return pairs, clusters(one, members, pairs), fitted


#: Probability from which clusters of a kind are merged, and from which they are reviewed.
BANDS = {
    "default": (0.92, 0.75),
    "Material": (0.93, 0.75),
    "Alloy": (0.93, 0.75),
    "Equipment": (0.90, 0.72),
    "Person": (0.95, 0.80),
    "Lab": (0.90, 0.72),
    "ResearchTeam": (0.90, 0.72),
}


def proposals(found: DataFrame, reviewed: DataFrame, kind: str = "default") -> DataFrame:
    """(cluster, members, probability, decision, blocked) of clusters of two rows or more; one with a reviewed id is never merged by itself."""
    auto, review = BANDS.get(kind, BANDS["default"])
    locked = reviewed.select("id").distinct().withColumn("locked", F.lit(True))
    g = found.join(locked, "id", "left").groupBy("cluster").agg(F.count("*").alias("members"), F.max("probability").alias("probability"), F.coalesce(F.max("locked"), F.lit(False)).alias("blocked"))
    said = F.when((F.col("probability") >= auto) & ~F.col("blocked"), "auto_merge").when(F.col("probability") >= review, "review_needed").otherwise("separate")
    return g.where("members > 1").select("cluster", "members", "probability", said.alias("decision"), "blocked")
