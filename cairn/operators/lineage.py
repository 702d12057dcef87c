"""Chains of records that replace each other: heads, lengths and places by pointer doubling, whatever their length, and with cycles cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut


def supersedence(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (id, superseded_by, retracted): every record's place, and the chains.

    Places are (id, head, hops to the head, cycle); chains are (head, length, active_head, cycle), where active_head is null if the head is
    itself retracted. A pointer to an unknown id, to itself or to nothing ends a chain. Pointers in a circle are cut before the
    circle's least id, so that its head is the one that pointed there, and all that lead into it are flagged; other chains
    are not touched by it. Rows of one id count once, with the greatest pointer and retracted if one is; rows without an id are left out.
    """
    known = cut(records.where("id IS NOT NULL").groupBy("id").agg(F.max("superseded_by").alias("to"), F.coalesce(F.max("retracted"), F.lit(False)).alias("retracted")))
    succ = cut(known.select("id", "to").where("to <> id").join(known.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"))
    n = succ.count() + 1
    end = _ends(succ, n)
    circle = cut(end.where("open").select(F.col("to").alias("id")).distinct())  # where n steps lead to is on a circle
    circles = not circle.isEmpty()
    flagged = known.select("id").where("false")
    if circles:
        flagged = end.where("open").select("id").distinct()
        least = cut(end.where("open").join(circle, "id", "left_semi").select("id", "least"))
        last = succ.join(least, "id").where("to = least").select("id")
        succ = cut(succ.join(last, "id", "left_anti"))
        end = _ends(succ, n)
    all_ = known.select("id", "retracted").join(end.select("id", "to", "hops"), "id", "left").join(flagged.withColumn("cycle", F.lit(True)), "id", "left")
    places = cut(all_.select("id", F.coalesce("to", "id").alias("head"), F.coalesce("hops", F.lit(0).cast("long")).alias("hops"), F.coalesce("cycle", F.lit(False)).alias("cycle"), "retracted"))
    of_head = F.max(F.when(F.col("id") == F.col("head"), F.col("retracted")))
    chains = places.groupBy("head").agg(F.count("*").alias("length"), of_head.alias("_retracted"), F.max("cycle").alias("cycle"))
    return places.drop("retracted"), chains.select("head", "length", F.when(~F.col("_retracted"), F.col("head")).alias("active_head"), "cycle")


def _ends(succ: DataFrame, n: int) -> DataFrame:
    """(id, to, hops, least, open) of every pointer: the end of its chain, or where at least n steps have led, which is open."""
    jump = cut(succ.select("id", "to", F.lit(1).cast("long").alias("hops"), F.least("id", "to").alias("least")))
    steps = 1
    while True:
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        both = jump.join(far, "to", "left")
        jump = cut(both.select(
            "id", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", "_least").alias("least"),
            F.col("_to").isNotNull().alias("open"),
        ))
        steps *= 2
        if steps >= 2 * n or jump.where("open").isEmpty():
            return jump
        jump = jump.drop("open")
