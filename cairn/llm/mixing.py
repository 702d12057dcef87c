"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import counted_out, cut, let, word_count


def fill(sources: DataFrame, weights: list[float], max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """sources (source, total) with weight and target.

    Sources by code point, null last, have the weights in turn. The budget (all words, unless given) is shared
    by weight; a source stops at max_epochs times its words and what it leaves is shared by the others, until
    none is above. The sources at their limit are those with the least limit per weight, so one pass over
    running sums finds the level that clamping again and again would reach. One row per source is all that
    meets in a task here, which is meant for up to some hundred thousand sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    cap = F.col("total") * F.lit(float(max_epochs))
    return (
        sources.select("source", "total", "n")
        .withColumn("weight", F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_budget", F.lit(budget).cast("double") if budget is not None else F.sum("total").over(whole).cast("double"))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source", "_level"))).over(whole)["_level"])
        .withColumn("target", F.coalesce(F.least(cap, F.col("_level") * F.col("weight")), cap))
        .select("source", "total", "n", "weight", "target")
    )


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, budget: float | None = None, seed: int = 11, bucket_rows: int = 256) -> DataFrame:
    """(doc_id, source, size, copies_in, source_size, target, whole, extra) of every distinct (doc_id, source, size).

    The mix repeats each of the unit's rows as often as the whole part of target / source_size says, and extra
    of them once more. Which have that is settled in seeded buckets of a bounded number of units: from the largest
    document to the smallest each row is taken with the seeded chance that the words still due have in its own, so
    all have the same chance. Then, in the same order, what is too much is given back or what still fits is added; and
    once more after the smallest step over the target, if that ends nearer to it. The result depends on the rows alone, not on their
    order or partitions.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = cut(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies_in")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies_in")).alias("total"), F.count("*").alias("n"))
    targets = cut(fill(sources, list(weights), max_epochs, budget)).withColumnRenamed("source", "_source")
    u = units.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    u = (
        u.withColumn("rate", F.least(rate, F.lit(float(max_epochs))))
        .withColumn("h", hashed)
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / bucket_rows))))
    )
    first = F.struct((-F.col("size")).alias("order"), "h", "doc_id", "size", F.col("copies_in").alias("copies"))
    grouped = u.groupBy("source", "bucket", "total", "target", "rate").agg(F.sort_array(F.collect_list(first)).alias("rows"))
    return grouped.select("source", "total", "target", "rate", F.explode(_taken("rows", F.col("rate") - F.floor("rate"))).alias("d")).select(
        "d.doc_id", "source", "d.size", F.col("d.copies").alias("copies_in"), F.col("total").alias("source_size"), "target",
        F.floor("rate").cast("long").alias("whole"), F.col("d.extra").alias("extra"),
    )


def _taken(rows: str, share: Column) -> Column:
    """The rows with extra: how many of their copies are taken once more. due: words that should be taken less those that are."""
    kind = "array<struct<doc_id:bigint,size:bigint,copies:bigint,extra:bigint>>"

    def made(row: Column, extra: Column) -> Column:
        return F.array(F.struct(row["doc_id"].alias("doc_id"), row["size"].alias("size"), row["copies"].alias("copies"), extra.alias("extra")))

    def draw(state: Column, row: Column) -> Column:
        due = state["due"] + share * row["size"] * row["copies"]
        chance = F.pmod(row["h"], F.lit(1 << 20)) / float(1 << 20)
        fits = F.coalesce(F.ceil(F.try_divide(due, row["size"]) - chance).cast("long"), F.lit(0).cast("long"))
        take = F.greatest(F.lit(0).cast("long"), F.least(row["copies"], fits))
        return F.struct((due - take * row["size"]).cast("double").alias("due"), F.concat(state["out"], made(row, take)).alias("out"))

    none = F.lit(0).cast("long")

    def moved(state: Column, row: Column, by: Column) -> Column:
        return F.struct((state["due"] - by * row["size"]).cast("double").alias("due"), F.concat(state["out"], made(row, row["extra"] + by)).alias("out"))

    def nearer(state: Column, row: Column) -> Column:
        whole = F.coalesce(F.floor(F.try_divide(F.abs(state["due"]), row["size"])).cast("long"), none)
        return moved(state, row, F.when(state["due"] > 0, F.least(row["copies"] - row["extra"], whole)).otherwise(-F.least(row["extra"], whole)))

    def across(state: Column, row: Column) -> Column:
        step = F.when(state["due"] > 0, F.least(row["copies"] - row["extra"], F.lit(1).cast("long"))).otherwise(-F.least(row["extra"], F.lit(1).cast("long")))
        step = F.when(row["size"] > 0, step).otherwise(none)
        one = moved(state, row, F.when(state["done"], none).otherwise(step))
        return F.struct(one["due"].alias("due"), one["out"].alias("out"), (state["done"] | (step != 0)).alias("done"))

    def fold(rows_: Column, due: Column, step, *more: Column) -> Column:
        return F.aggregate(rows_, F.struct(due.cast("double").alias("due"), F.array().cast(kind).alias("out"), *more), step)

    def best(first: Column) -> Column:
        near = fold(first["out"], first["due"], nearer)
        return let(near, lambda n: let(fold(F.reverse(n["out"]), n["due"], across, F.lit(False).alias("done")), lambda x: let(
            fold(F.reverse(x["out"]), x["due"], nearer), lambda again: F.when(F.abs(again["due"]) < F.abs(n["due"]), again["out"]).otherwise(n["out"]))))

    return let(fold(F.col(rows), F.lit(0.0), draw), best)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes), source, times.

    Defined results: a null text has no words and takes none; null sources are one source, the last; repeated
    rows each have their own draw and keep their row; an empty table gives an empty table.
    """
    got = mix(docs, **options)
    rows = counted_out(got, "copies_in", "_i")
    times = F.col("whole") + (F.col("_i") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source", times.alias("times"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, each as often as mix() says.

    Rows that share doc_id, source and size are counted by their whole content first, so however many copies of
    a row there are, they meet as one row; of those that differ the ones with the least hash are taken first.
    """
    got = mix(docs, **options).where("whole > 0 OR extra > 0").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_src"), F.col("size").alias("_size"), "copies_in", "whole", "extra")
    got = cut(got)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), word_count(F.col("text")).alias("_words"))
    same = F.col("d.doc_id").eqNullSafe(F.col("_doc")) & F.col("d.source").eqNullSafe(F.col("_src")) & (F.col("_words") == F.col("_size"))
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    # there are about as many units as rows, so both sides are sorted, whatever a small table's size says
    out = sized.join(got.where("copies_in = 1").hint("merge"), same).withColumn("_", times(F.col("whole") + F.col("extra"))).select(*columns)
    several = got.where("copies_in > 1")
    if several.isEmpty():
        return out
    unit = ["_doc", "_src", "_size"]
    counted = sized.join(several.hint("merge"), same).groupBy(*unit, "whole", "extra", "d").agg(F.count("*").alias("k"))
    before = Window.partitionBy(*unit).orderBy(F.xxhash64("d"), "d").rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("k"), F.col("extra") - F.coalesce(F.sum("k").over(before), F.lit(0).cast("long"))))
    counted = counted.withColumn("_n", F.col("k") * F.col("whole") + more).where("_n > 0")
    return out.unionByName(counted.withColumn("_", times(F.col("_n"))).select(*columns))
