"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are sorted by size, and each enters the bin with the least remaining capacity that still holds it, found
in a balanced tree of remaining capacities; a bin is opened when none does. This fills few bins of a fixed
capacity. For a fixed number of shards the least capacity with which so few bins do is found by bisection, which
leaves them level.

Best fit puts groups of one size into one bin as long as they fit, so the order of all groups is known from how
many there are of each size. Sizes from FINE on are rounded up by less than one part in FINE / 2, so that there are at most
some 1.1 million of them whatever the input: the packing of these counts is worked out in one place, and every group
finds its bin in the result by its rank among those of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

FINE = 1 << 16
RANKED = 20_000  # groups of one size that are ranked together


class Remaining:
    """An AVL tree of (remaining capacity, bin). A node is (left, item, right, height)."""

    def __init__(self) -> None:
        self.root = None

    def add(self, item: tuple[int, int]) -> None:
        self.root = _insert(self.root, item)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least remaining capacity that holds size, the first of equals; None if none does."""
        node, found = self.root, None
        while node:
            if node[1][0] >= size:
                found, node = node[1], node[0]
            else:
                node = node[2]
        if found is not None:
            self.root = _remove(self.root, found)
        return found

    def height(self) -> int:
        return _height(self.root)


def _height(node) -> int:
    return node[3] if node else 0


def _node(left, item, right):
    """A node of two subtrees whose heights differ by two at most, turned so that they differ by one at most."""
    a, b = _height(left), _height(right)
    if a > b + 1:
        x, own, y, _ = left
        if _height(x) < _height(y):
            p, top, q, _ = y
            return _node(_node(x, own, p), top, _node(q, item, right))
        return _node(x, own, _node(y, item, right))
    if b > a + 1:
        x, own, y, _ = right
        if _height(y) < _height(x):
            p, top, q, _ = x
            return _node(_node(left, item, p), top, _node(q, own, y))
        return _node(_node(left, item, x), own, y)
    return left, item, right, max(a, b) + 1


def _insert(node, item):
    if not node:
        return None, item, None, 1
    left, own, right, _ = node
    return _node(_insert(left, item), own, right) if item < own else _node(left, own, _insert(right, item))


def _remove(node, item):
    left, own, right, _ = node
    if item < own:
        return _node(_remove(left, item), own, right)
    if item > own:
        return _node(left, own, _remove(right, item))
    if not left or not right:
        return left or right
    least = right
    while least[0]:
        least = least[0]
    return _node(left, least[1], _remove(right, least[1]))


def best_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """(index of a size, bin, how many of it) in the order of packing, and the number of bins; None if most bins are too few.

    counts says how many groups there are of each size. The tightest bin that holds a size stays the tightest
    when it has taken one, so it takes as many as it holds at once.
    """
    tree, out, bins = Remaining(), [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, left = int(sizes[i]), int(counts[i])
        if size > capacity:
            raise ValueError(f"a group has {size}, over the capacity of {capacity}")
        while left:
            found = tree.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, b = found
            n = min(left, room // size) if size else left
            out.append((i, b, n))
            left -= n
            tree.add((room - n * size, b))
    return out, bins


def level(sizes: np.ndarray, counts: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """best_fit_decreasing() into n bins with the least capacity that bisection finds.

    A group that alone is more than an equal share of all that is left has a bin for itself.
    """
    counts, out, first = counts.astype(np.int64).copy(), [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        while counts[i] and n - first > 1 and int(sizes[i]) * (n - first) >= int(sizes @ counts):
            out.append((i, first, 1))
            counts[i] -= 1
            first += 1
    rest = np.nonzero(counts)[0]
    if not len(rest):
        return out
    own, many, k = sizes[rest].astype(np.int64), counts[rest], n - first
    low = max(-(-int(own @ many) // k), int(own.max()))
    high, best = low, None
    while (best := best_fit_decreasing(own, many, high, k)) is None:
        low, high = high + 1, high + max(1, high // 4096, 2 * (high - low))
    while low < high and high - low > high >> 20:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(own, many, mid, k)) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return out + [(int(rest[i]), b + first, m) for i, b, m in best[0]]


def rounded(size: Column) -> Column:
    """Sizes below FINE as they are, others up to the next of FINE / 2 steps or more for each doubling."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 15)
    return F.when(size < FINE, size).otherwise((F.ceil(size / step) * step).cast("long"))


def ranked(groups: DataFrame) -> DataFrame:
    """groups (gid, size) with cls, its rounded size, and rank, counted from 0 among those of cls.

    Many groups of one size are ranked in parts of bounded size, each after those before it.
    """
    by_size = cut(groups.withColumn("cls", rounded(F.col("size"))))
    parts = by_size.groupBy("cls").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / RANKED)).alias("parts"))
    rows = cut(by_size.join(cut(parts), "cls").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts"))))
    counts = rows.groupBy("cls", "part").count()
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("cls", "part", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("offset")))
    inner = Window.partitionBy("cls", "part").orderBy("gid")
    return rows.withColumn("_n", F.row_number().over(inner) - 1).join(offsets, ["cls", "part"]).select("gid", "size", "cls", (F.col("offset") + F.col("_n")).alias("rank"))


def _place(groups: DataFrame, pack) -> DataFrame:
    """(gid, size, shard) of every group, with pack a function of sizes and counts to what best_fit_decreasing() gives."""
    rows = cut(ranked(groups))
    table = rows.groupBy("cls").agg(F.count("*").alias("count"), F.max("size").alias("most")).toPandas().sort_values("cls")  # a row for each rounded size
    classes, sizes, counts = (table[c].to_numpy(np.int64) for c in ("cls", "most", "count"))  # a class is packed by the largest size that it really has
    made = sorted(pack(sizes, counts), key=lambda x: x[0]) if len(sizes) else []
    at = np.array([i for i, _, _ in made], dtype=np.int64)
    n = np.array([m for _, _, m in made], dtype=np.int64)
    starts = np.cumsum(n) - n  # counted on through all sizes
    first = np.cumsum(counts) - counts
    bins = np.array([b for _, b, _ in made], dtype=np.int32)
    assert len(at) == 0 or (np.diff(at) >= 0).all()
    shared = groups.sparkSession.sparkContext.broadcast((classes, first, starts, bins))  # a row for each size and each bin that it enters

    def find(batches):
        classes, first, starts, bins = shared.value
        for batch in batches:
            if batch.num_rows:
                place = first[np.searchsorted(classes, batch.column(2).to_numpy())] + batch.column(3).to_numpy()
                shard = bins[np.searchsorted(starts, place, side="right") - 1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard)], names=["gid", "size", "shard"])

    return rows.select("gid", "size", "cls", "rank").mapInArrow(find, "gid string, size long, shard int")


def assign(groups: DataFrame, n_shards: int) -> DataFrame:
    """(gid, size, shard) of every group of groups (gid string, size long), in n_shards level shards."""
    return _place(groups, lambda sizes, counts: level(sizes, counts, n_shards))


def fewest_shards(groups: DataFrame, capacity: int) -> DataFrame:
    """(gid, size, shard) of every group, in as few shards of a fixed capacity as best fit decreasing opens.

    A group over the capacity has to overfill a shard; ValueError says so. Sizes from 65,536 up count as the largest of
    their class, 3e-5 more than their own at most, so that a group of just the capacity fits.
    """
    return _place(groups, lambda sizes, counts: best_fit_decreasing(sizes, counts, capacity)[0])


def shard(docs: DataFrame, n_shards: int = 8, slot_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, gid.

    Size is the text's UTF-8 bytes (null: none) plus 1; all rows of a text are one group. The law is "bytes":
    the shards' sizes are near equal, as far as no group is larger than a shard. As best fit decreasing does, the
    first shards have the large groups and the last the small ones. Slots count from 0 in each shard without gaps,
    ordered by a hashed bucket of bounded size and then doc_id.

    Defined results: null texts are a group of their own with the checksum of no bytes; repeated rows each have
    a slot; an empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNull(), "null").otherwise(F.md5(text.cast("binary"))).alias("gid")))
    groups = rows.groupBy("gid").agg(F.sum("size").alias("size"))
    of_group = cut(assign(groups, n_shards)).select("gid", "shard")
    buckets = max(1, -(-rows.count() // slot_rows))
    placed = cut(rows.join(of_group, "gid").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "gid"), F.lit(buckets))))
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    inner = Window.partitionBy("shard", "bucket").orderBy("doc_id", "gid")
    return placed.withColumn("rank", F.row_number().over(inner)).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "gid",
    )
