"""Readers of the tables and of what they stand for: graph nodes and edges, ranked runs, measurements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with _file and _row, the place of each row in its files."""
    return read(spark, sf_dir, name).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


PLACE = ["_file", "_row"]


def ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, source, source_pos, id, score): each brand's parts by three signals.

    Revenue is added up as decimals, so that it doesn't hang on the order of rows: parts that sold the same tie in any run.
    """
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("query"))
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")), 2).cast("double").alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
        F.count("*").cast("double").alias("orders"),
    )
    both = parts.join(sold, "id")
    names = ["revenue", "quantity", "orders"]
    signals = F.array(*(F.struct(F.lit(n).alias("source"), F.lit(i).alias("source_pos"), F.col(n).alias("score")) for i, n in enumerate(names)))
    return both.select("query", "id", F.explode(signals).alias("s")).select("query", "s.source", "s.source_pos", "id", "s.score")


RANKED_PARTS_SQL = """
sold AS (SELECT l_partkey AS id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS orders
         FROM lineitem GROUP BY l_partkey),
b AS (SELECT p_brand AS query, sold.* FROM part JOIN sold ON p_partkey = id),
runs AS (SELECT query, 'revenue' AS source, 0 AS source_pos, id, revenue AS score FROM b
         UNION ALL SELECT query, 'quantity', 1, id, quantity FROM b
         UNION ALL SELECT query, 'orders', 2, id, orders FROM b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS rank1 FROM runs)
"""


#: Kinds of nodes by the letters before their keys, in the order of letters.
_LETTERS = "cnoprs"
_DIGITS = 15


def _name(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def number(letter: str, key: str) -> Column:
    """A node's name as a number, in the same order as names: the letter, the sign, the digits from the left on, how many they are."""
    k = F.col(key).cast("long")
    digits = F.abs(k).cast("string")
    left = F.rpad(digits, _DIGITS, "0").cast("long")
    first = F.lit(2 * _LETTERS.index(letter)) + F.when(k < 0, 0).otherwise(1)
    code = F.shiftleft(first.cast("long"), 55) + F.shiftleft(left, 4) + F.length(digits)
    return F.when(F.length(digits) > _DIGITS, F.raise_error(F.lit(f"{key} has over {_DIGITS} digits")).cast("long")).otherwise(code)


def named(c: str | Column) -> Column:
    """The name that number() stands for, under the column's name if that is given."""
    n = F.col(c) if isinstance(c, str) else c
    first = F.shiftright(n, 55).cast("int")
    letter = F.substring(F.lit(_LETTERS), F.shiftright(first, 1) + 1, F.lit(1))
    left = F.lpad(F.shiftright(n, 4).bitwiseAND(F.lit((1 << 51) - 1)).cast("string"), _DIGITS, "0")
    name = F.concat(letter, F.when(first % 2 == 0, "-").otherwise(""), F.substring(left, F.lit(1), n.bitwiseAND(F.lit(15)).cast("int")))
    return name.alias(c) if isinstance(c, str) else name


def spelled() -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """named() in numpy: for an array of numbers, the places and the bytes of names of equal length. Made within a function, so that executors need no copy of this module."""
    letters, most = np.frombuffer(_LETTERS.encode(), np.uint8), _DIGITS

    def spell(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, size = n >> 55, n & 15
        for minus in (0, 1):
            for many in np.unique(size):
                at = np.flatnonzero((size == many) & (first % 2 == 1 - minus))
                left = ((n[at] >> 4) & ((1 << 51) - 1)) // 10 ** int(most - many)
                digits = [left // 10 ** int(k) % 10 + ord("0") for k in range(many - 1, -1, -1)]
                yield at, np.stack([letters[first[at] >> 1], *([np.full(len(at), ord("-"))] * minus), *digits], axis=1).astype(np.uint8)

    return spell


def graph(spark: SparkSession, sf_dir: str, numbers: bool = False, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) and edges (src, dst, type) of the trade tables.

    With numbers, ids are numbers in the order of their names (see named), for work over many rounds. Without once, edges are left to stand as often as
    lines name them, for work that takes each link once itself.
    """
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    key = number if numbers else _name
    kinds = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("part", "p", "p_partkey"), ("orders", "o", "o_orderkey")]
    nodes = None
    for name, p, c in kinds:
        one = t[name].select(key(p, c).alias("id"), F.lit(name).alias("label"))
        nodes = one if nodes is None else nodes.unionByName(one)
    links = [
        ("nation", "n", "n_nationkey", "r", "n_regionkey", "in_region"), ("customer", "c", "c_custkey", "n", "c_nationkey", "in_nation"),
        ("supplier", "s", "s_suppkey", "n", "s_nationkey", "in_nation"), ("orders", "o", "o_orderkey", "c", "o_custkey", "placed_by"),
        ("lineitem", "o", "l_orderkey", "p", "l_partkey", "contains"), ("lineitem", "p", "l_partkey", "s", "l_suppkey", "supplied_by"),
    ]
    edges = None
    for name, p, c, q, d, kind in links:
        pairs = t[name].select(c, d)
        if name == "lineitem" and once:  # the others' rows differ in their key. Dealt first, so that no task holds more pairs than its share of them
            pairs = spread(pairs, c).distinct()
        one = pairs.select(key(p, c).alias("src"), key(q, d).alias("dst"), F.lit(kind).alias("type"))
        edges = one if edges is None else edges.unionByName(one)
    return nodes, edges


GRAPH_SQL = """
nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'part' FROM part UNION ALL SELECT 'o' || o_orderkey, 'orders' FROM orders),
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS type FROM nation
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' FROM supplier
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey, 'placed_by' FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'contains' FROM lineitem
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by' FROM lineitem)
"""
