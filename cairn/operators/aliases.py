"""Looking names up: exactly, by their beginning, and within two edits, by keys that an equi-join finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from .retrieval import canonical_key

#: Deletions are made in so many first characters alone: strings that few edits separate agree there but for as many deletions on either side.
REACH = 8


def without(text: Column, edits: int, reach: int = REACH) -> Column:
    """The different strings that are left of text's first characters when up to `edits` of them go."""
    head = F.substring(text, 1, reach)
    out = F.array(head)
    for _ in range(edits):
        shorter = lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.lit(reach)), lambda i, s=s: i <= F.char_length(s)), lambda i, s=s: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(reach))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def index(names: DataFrame) -> DataFrame:
    """(key, entity) of names (entity, surface): each folded form once, with the least entity that has it. Blank forms are left out."""
    keyed = names.select("entity", canonical_key(F.col("surface")).alias("key")).where("entity IS NOT NULL AND key <> ''")
    return keyed.groupBy("key").agg(F.min("entity").alias("entity"))


def exact(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, key, entity) of asked (query, text) whose folded form is an alias."""
    return asked.select("query", canonical_key(F.col("text")).alias("key")).join(aliases, "key").select("query", "key", "entity")


def beginning_with(aliases: DataFrame, asked: DataFrame, joined_on: int = 3) -> DataFrame:
    """(query, key, entity) of all aliases that begin with the folded text. A text shorter than joined_on meets the aliases by a key of its own length."""
    q = asked.select("query", canonical_key(F.col("text")).alias("text")).where("text <> ''").withColumn("head", F.substring("text", 1, joined_on))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(joined_on)), lambda n: F.substring(F.col("key"), F.lit(1), n)))
    return aliases.withColumn("head", F.explode(heads)).join(q, "head").where(F.startswith("key", "text")).select("query", "key", "entity")


def within(aliases: DataFrame, asked: DataFrame, edits: int = 2) -> DataFrame:
    """(query, key, entity, distance) of all aliases whose folded form is at most `edits` insertions, deletions or changes from the folded text.

    Both sides give the strings that deletions leave of their beginnings, a few dozen for two edits, and meet where one is equal; the
    distance of the whole forms then decides, so nothing is lost and nothing wrong is kept. Texts that are asked for alike meet once.
    """
    texts = asked.select("query", canonical_key(F.col("text")).alias("text")).where("text IS NOT NULL")
    own = texts.select("text").distinct().select("text", F.explode(without(F.col("text"), edits)).alias("left"))
    met = aliases.select("key", "entity", F.explode(without(F.col("key"), edits)).alias("left")).join(own, "left").select("text", "key", "entity").distinct()
    near = cut(met.withColumn("distance", F.levenshtein("text", "key", edits)).where("distance >= 0"))
    return near.join(texts, "text").select("query", "key", "entity", "distance")


def resolved(aliases: DataFrame, asked: DataFrame, edits: int = 2) -> DataFrame:
    """(query, entity, key, distance): the nearest alias of each text that has one; of equals the first key."""
    best = F.min_by(F.struct("entity", "key", "distance"), F.struct("distance", "key"))
    return within(aliases, asked, edits).groupBy("query").agg(best.alias("b")).select("query", "b.*")
