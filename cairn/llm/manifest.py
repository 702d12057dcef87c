"""Merkle manifest of a table of documents: a tree for each language over its documents, and one over the languages.

Every proof is looked up by coordinates: a leaf's index and its group's size say which siblings it needs on each
level, the coordinates are exploded and joined with the written table of nodes, and what comes back is set in order,
concatenated and folded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The tree over the subroots; those of the languages count from 0.
ROOT = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sized(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(text: Column) -> Column:
    return digest(F.concat(*(sized(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), sized(text)))


def is_tampered(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the id's decimal digits; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves with tree (languages in order, null first), idx (position by doc_id, null first, then by digest) and n, the tree's size.

    Rows are dealt by range, repeated rows at random among themselves, so that no language meets in one task; what is
    counted for each range and language then says where a range begins. Rows that are alike in all may change places.
    """
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("tie")]
    dealt = cut(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "lang").agg(F.count("*").alias("here"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    sizes = counts.groupBy("lang").agg(F.sum("here").alias("n"))
    trees = sizes.withColumn("tree", (F.row_number().over(Window.orderBy(F.asc_nulls_first("lang"))) - 1).cast("long"))  # a row for each language
    place = cut(begins.join(trees, begins.lang.eqNullSafe(trees.lang)).drop(trees.lang))
    within = Window.partitionBy("part", "lang").orderBy(*order[1:])
    own = dealt.withColumn("at", F.row_number().over(within))
    both = own.join(place, (own.part == place.part) & own.lang.eqNullSafe(place.lang)).drop(place.part, place.lang)
    return cut(both.select("tree", (F.col("begin") + F.col("at") - 1).alias("idx"), "n", "doc_id", "leaf", "tampered"))


def grown(leaves: DataFrame, depth: int, fan: int) -> list[DataFrame]:
    """The levels (tree, idx, n, digest) of all trees at once, each written: level 0 are the leaves, and a tree ends with one node."""
    levels = [leaves]
    for _ in range(depth):
        at = levels[-1]
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # fan of them at most
        up = at.where("n > 1").groupBy("tree", div(F.col("idx"), fan).alias("up"), "n").agg(run.alias("run"))
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        levels.append(cut(up.select("tree", F.col("up").alias("idx"), div(F.col("n") + (fan - 1), fan).alias("n"), F.unhex(digest(joined)).alias("digest"))))
    return levels


def height(n: int, fan: int) -> int:
    """How often a level of n nodes is put together until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


@dataclass
class Manifest:
    leaves: DataFrame  # tree, idx, n, doc_id, leaf, tampered
    levels: list[DataFrame]  # of the languages' trees
    tops: list[DataFrame]  # of the tree over their subroots
    trees: int
    depth: int
    fan: int

    def subroots(self) -> DataFrame:
        return self.tops[0].select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"))

    def root(self) -> str:
        """The one digest that stands for all documents."""
        return bytes(self.tops[-1].first()["digest"]).hex()


def build(docs: DataFrame, fan: int = 8) -> Manifest:
    """All nodes of the manifest of docs (doc_id, source, lang, n_chars, text), written level by level.

    A document's digest, and that of the tampered copy where there is one, is taken in one pass over the texts; nothing
    but digests is shuffled after that.
    """
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.when(is_tampered(F.col("doc_id")), F.unhex(leaf_digest(lower_ascii(F.col("text")))))
    leaves = numbered(cut(rows.select("doc_id", "lang", F.unhex(leaf_digest(F.col("text"))).alias("leaf"), changed.alias("tampered"), F.rand(1).alias("tie"))))
    trees, largest = leaves.agg(F.coalesce(F.max("tree") + 1, F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    depth = height(largest, fan)
    levels = grown(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), depth, fan)
    ends = [level.where("n = 1") for level in levels]
    subroots = ends[0]
    for level in ends[1:]:
        subroots = subroots.unionByName(level)
    tops = [cut(subroots.select(F.lit(ROOT).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest"))]
    tops += grown(tops[0], height(trees, fan), fan)[1:]
    return Manifest(leaves, levels, tops, trees, depth, fan)


def steps(m: Manifest) -> Column:
    """Of a leaf: each level on its way where nodes are put together, with the tree, its own index there and how many nodes there are."""
    fan, made = m.fan, []
    for first, tree, idx, n, depth in ((0, F.col("tree"), F.col("idx"), F.col("n"), m.depth), (m.depth, F.lit(ROOT).cast("long"), F.col("tree"), F.lit(m.trees).cast("long"), height(m.trees, fan))):
        for level in range(depth):
            by = fan**level
            here = F.struct(
                F.lit(first + level).alias("step"), tree.alias("tree"), F.lit(level).alias("level"), div(idx, by).alias("own"),
                div(n + (by - 1), by).alias("n"), (div(idx, by) % fan).cast("int").alias("pos"),
            )
            made.append(F.when(n > by, here))
    return F.array_compact(F.array(*made))


def prove(m: Manifest, most_broadcast: int = 50_000) -> DataFrame:
    """Every document with its proof, folded: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nodes near the roots are asked for by very many leaves. All levels from the lowest above which the trees have
    most_broadcast nodes or fewer (32 bytes each and a key) are counted first and sent to every task; the nodes below are
    each asked for by a small share of the leaves and meet them in a join.
    """
    if not m.trees:
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        return m.leaves.select("doc_id", *(F.lit("").alias(c) for c in names), F.lit(True).alias("verified"))
    fan = m.fan
    way = steps(m)
    if m.depth + height(m.trees, fan) == 0:  # one document in all
        siblings = m.leaves.select("tree", "idx").where("false").withColumn("sib", F.expr("CAST(NULL AS ARRAY<STRUCT<ord: INT, hex: STRING>>)"))
    else:
        asked = F.flatten(F.transform(way, lambda s: F.transform(
            F.filter(F.sequence(s["own"] - s["pos"], F.least(s["own"] - s["pos"] + (fan - 1), s["n"] - 1)), lambda j: j != s["own"]),
            lambda j: F.struct(s["tree"].alias("tree"), s["level"].alias("level"), j.alias("idx"), (s["step"] * (fan + 1) + j % fan).cast("int").alias("ord")),
        )))
        coords = m.leaves.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_idx"), F.explode(asked).alias("c")).select("of_tree", "of_idx", "c.*")
        per_level = m.leaves.where("idx = 0").agg(*(F.sum(F.when(F.col("n") > fan**k, div(F.col("n") + (fan**k - 1), fan**k)).otherwise(0)).alias(f"l{k}") for k in range(m.depth))).first() if m.depth else []
        few, room = m.depth, most_broadcast - 2 * m.trees
        while few and sum(per_level[few - 1 :]) <= room:
            few -= 1
        node = lambda frames, first: [f.where("n > 1").select("tree", F.lit(k).alias("level"), "idx", "digest") for k, f in enumerate(frames, first)]
        low, high = node(m.levels[:few], 0), node(m.levels[few : m.depth], few)
        split = (F.col("tree") == ROOT) | (F.col("level") >= few) if room >= 0 else F.lit(False)
        (high if room >= 0 else low).extend(node(m.tops, 0))
        met = []
        for frames, rows, how in ((low, coords.where(~split), lambda x: x), (high, coords.where(split), F.broadcast)):
            if frames:
                nodes = frames[0]
                for f in frames[1:]:
                    nodes = nodes.unionByName(f)
                met.append(rows.join(how(nodes), ["tree", "level", "idx"]).select("of_tree", "of_idx", "ord", "digest"))
        found = met[0] if len(met) == 1 else met[0].unionByName(met[1])
        sib = F.collect_list(F.struct(F.col("ord"), F.col("digest")))  # at most fan - 1 for each level
        siblings = found.groupBy(F.col("of_tree").alias("tree"), F.col("of_idx").alias("idx")).agg(sib.alias("sib"))
        siblings = siblings.withColumn("sib", F.transform("sib", lambda x: F.struct(x["ord"].alias("ord"), F.lower(F.hex(x["digest"])).alias("hex"))))
    # `#` holds the leaf's own place on each level, and `/` ends a level
    none = F.expr("CAST(array() AS ARRAY<STRUCT<ord: INT, hex: STRING>>)")
    marks = none if m.depth + height(m.trees, fan) == 0 else F.flatten(F.transform(way, lambda s: F.array(
        F.struct((s["step"] * (fan + 1) + s["pos"]).cast("int").alias("ord"), F.lit("#").alias("hex")),
        F.struct((s["step"] * (fan + 1) + fan).cast("int").alias("ord"), F.lit("/").alias("hex")),
    )))
    body = F.array_join(F.transform(F.array_sort(F.concat(F.coalesce("sib", none), marks)), lambda x: x["hex"]), "")
    rows = m.leaves.join(siblings, ["tree", "idx"], "left").withColumn("body", body)
    rows = rows.join(m.subroots(), "tree")
    fold = F.aggregate(F.filter(F.split("body", "/"), lambda x: x != ""), F.lower(F.hex(F.coalesce("tampered", "leaf"))), lambda acc, run: digest(F.replace(run, F.lit("#"), acc)))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    out = rows.select("doc_id", text("leaf"), text("subroot"), F.lit(m.root()).alias("root"), digest(F.translate("body", "#/", "")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, fan: int = 8) -> DataFrame:
    """build() and prove(): one row for each document.

    Defined results: nulls in any column take part as `-`; a null language has a tree of its own, before the others; rows with
    null ids come first and are never tampered with; repeated rows are leaves side by side, each with its own proof; a tampered
    copy that is no different (no capital letter, null text) still verifies; an empty table gives an empty table; other columns
    are ignored.
    """
    return prove(build(docs, fan))


def oracle(depth: int = 12, fan: int = 8) -> str:
    """manifest() over the table documents as SQL for DuckDB, of up to fan ** depth documents a language: each leaf is put
    in its own place among its group's nodes, level by level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    tampered = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        "bits AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM range(256) r(n))",
        f"""d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(tampered)} AS other, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 3 = 0 AS hit FROM documents, bits)""",
        """a0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS leaf_no,
  doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS acc, '' AS proof FROM d)""",
        "n0 AS MATERIALIZED (SELECT tree, leaf_no AS idx, leaf AS h FROM a0)",
    ]
    # levels 0 .. depth - 1 lead to the subroots, those after them to the root; in the second part all leaves share tree 0
    for k in range(2 * depth):
        if k == depth:
            ctes.append(f"n{k}r AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, h FROM n{k})")
        level, own = (f"n{k}r", "tree") if k >= depth else (f"n{k}", "leaf_no")
        by, tree = fan ** (k % depth), "0" if k >= depth else "a.tree"
        ctes.append(f"n{k + 1} AS MATERIALIZED (SELECT tree, idx // {fan} AS idx, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {level}) GROUP BY tree, idx // {fan})")
        if k >= depth:
            ctes.append(f"n{k + 1}r AS MATERIALIZED (SELECT * FROM n{k + 1})")
        ctes.append(
            f"a{k + 1} AS MATERIALIZED (SELECT a.tree, a.leaf_no, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, CASE WHEN max(c) = 1 THEN any_value(acc) ELSE "
            f"sha256(string_agg(CASE WHEN n.idx = a.{own} // {by} THEN acc ELSE h END, '' ORDER BY n.idx)) END AS acc, "
            f"any_value(proof) || coalesce(string_agg(CASE WHEN n.idx <> a.{own} // {by} THEN h END, '' ORDER BY n.idx), '') AS proof "
            f"FROM a{k} a JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {level}) n ON n.tree = {tree} AND n.idx // {fan} = a.{own} // {by * fan} GROUP BY a.tree, a.leaf_no)"
        )
    last = 2 * depth
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified"
        f" FROM a{last} a JOIN n{depth} s ON s.tree = a.tree CROSS JOIN n{last} r"
    )
