"""Chat formatting of reply trees.

Iterative self-joins double the reach of each message's pointer to its ancestors, and sum the scores on the way, so
a tree of depth d takes about log2(d) joins. With these sums branches are ranked by score before any path is
enumerated; the pointers then give the messages of the chosen paths alone, and each of these is formatted as one
conversation with a loss mask. All of it is DataFrame operations.

Control strings inside roles and texts are escaped reversibly: "<", any backslashes and "|" get one more
backslash, so "<|" stands in the output only where the template put it. Roles also escape line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

START, END = "<|im_start|>", "<|im_end|>\n"
SALTS = 64  # parts in which a tree's branches are ranked first


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (id, to) to the messages 1, 2, 4, ... above, and (id, total, length) of every message's path from its root.

    messages has unique ids (id), parent ids (parent, null or unknown for roots) and scores. A path has no more
    messages than there are, so pointers that still lead on after as many doublings say that parents form a cycle:
    ValueError, whichever tree it is in.
    """
    known = messages.select(F.col("id").alias("at"))
    at = messages.join(known, messages.parent == known["at"], "left").select("id", F.col("at").alias("to"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    at, most, jumps = cut(at), None, []
    # only messages whose pointers still lead on are joined again, so that one long tree makes no work for the others
    live, done = at.where("to IS NOT NULL"), at.where("to IS NULL")
    while not live.isEmpty():
        most = at.count() if most is None else most
        if 1 << len(jumps) > most:
            raise ValueError("parents form a cycle")
        jumps.append(live.select("id", "to"))
        above = live.unionByName(done).select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("total").alias("more"), F.col("length").alias("longer"))
        new = cut(live.join(above, "to").select("id", F.col("far").alias("to"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("longer")).alias("length")))
        live, done = new.where("to IS NOT NULL"), done.unionByName(new.where("to IS NULL"))
    return jumps, done.select("id", "total", "length")


def leaves(messages: DataFrame) -> DataFrame:
    """(id) of the messages that no other replies to."""
    replied = messages.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    return messages.select("id").join(replied, "id", "left_anti")


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, id, up) for every message on the paths to the leaves of chosen (id); up counts steps from the leaf."""
    found = chosen.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):  # found has all messages less than 2**k above a leaf
        found = cut(found)
        found = found.unionByName(found.join(jump, "id").select("leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up")))
    return found


def best_branches(ends: DataFrame, branches: int) -> DataFrame:
    """ends (tree, id, mean, length) with rank, the best of each tree. A tree with very many branches is ranked in parts first."""
    order = [F.desc("mean"), F.desc("length"), "id"]
    part = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    first = ends.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order))).where(F.col("_k") <= branches)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= branches)


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, mask): one conversation for each of a tree's best root-to-leaf paths.

    messages: tree, id, parent, role, text, score. A branch's rank is by its mean score (null counts as 0), then
    length, then leaf; branches limits how many of each tree are formatted. By default all are, without a rank. mask
    lists start and length, in code points, of every assistant text in formatted.

    Defined results: null texts are empty, null roles say "null"; a message whose parent is unknown starts a
    path of its own; parents that form a cycle in any tree are a ValueError for all; no messages give no
    conversations; other columns are ignored.
    """
    rows = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    jumps, sums = ancestors(rows.select("id", "parent", "score"))
    ends = leaves(rows)
    if branches is None:
        chosen = ends.withColumn("rank", F.lit(None).cast("int"))
    else:
        ends = ends.join(sums, "id").join(rows.select("id", "tree"), "id").withColumn("mean", F.col("total") / F.col("length"))
        chosen = best_branches(ends, branches)
    chosen = cut(chosen.select("id", "rank"))
    turns = paths(chosen, jumps).join(rows.select("id", "tree", "role", "text"), "id").join(chosen.withColumnRenamed("id", "leaf"), "leaf")
    escaped = escape("text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("leaf", "tree", "rank", "up", "role", escaped.alias("body"), head.alias("head"))
    one = F.struct((-F.col("up")).alias("place"), "head", "body", (F.col("role") == "assistant").alias("learn"))
    whole = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(one)).alias("turns"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("mask"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.char_length(t["head"])
        chars = F.char_length(t["body"]).cast("long")
        spans = F.when(t["learn"], F.array(F.struct(start.alias("start"), chars.alias("chars")))).otherwise(F.array().cast("array<struct<start:bigint,chars:bigint>>"))
        return F.struct((start + chars + len(END)).alias("at"), F.concat(state["mask"], spans).alias("mask"))

    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return whole.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("turns", zero, step)["mask"].alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text) and learned (texts under the mask), both from the output alone, beside all columns."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substring(p, len(START) + 1, 2**30), "\n", 1)).alias("role"),
            unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.lit(2**30))).alias("text"),
        ),
    )
    learned = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["chars"].cast("int"))))
    return formatted.withColumns({"turns": turns, "learned": learned})


def linear(table: DataFrame) -> DataFrame:
    """messages of a table of conversations (conv_id, turn, role, text): each row replies to the one before.

    Repeated turns keep their rows, in order of role and text; null conv_ids are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = table.select("conv_id", "role", "text", F.row_number().over(order).alias("_n"))
    return rows.select(
        F.col("conv_id").alias("tree"), F.concat_ws(":", name, "_n").alias("id"),
        F.when(F.col("_n") > 1, F.concat_ws(":", name, F.col("_n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )
