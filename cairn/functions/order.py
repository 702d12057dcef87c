"""Work that follows an order over all rows, or over a key's rows one by one, without collecting them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .storage import cut


def cumulative(rows: DataFrame, by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """rows (one for each value of by) with upto_<s>: the sum of s up to and including the row.

    Rows are dealt by range of by and summed within each range; the ranges' totals, a row each, say where a range begins.
    """
    order = F.desc(by) if descending else F.asc(by)
    dealt = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums))
    within = Window.partitionBy("_part").orderBy(order)
    out = dealt.join(F.broadcast(offsets), "_part")  # a row for each range
    return out.select(*rows.columns, *((F.col(f"_o_{s}") + F.sum(s).over(within)).alias(f"upto_{s}") for s in sums))


def sums_in_order(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, total, n): each key's sum of value, added one row after the other in an order that has no ties, and how many there are.

    A sum of doubles hangs on the order of its terms. In a fixed order it comes out the same in any run, however the rows are dealt; rows are sorted within
    a key and read one by one, so a large key is never held as an array.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.select(*keys, F.col(value).alias("_one"), F.struct(*order).alias("_at"), F.sum(value).over(w).alias("_upto"))
    return upto.groupBy(*keys).agg(F.max_by("_upto", "_at").alias("total"), F.count("_one").alias("n"))


def folded(rows: DataFrame, keys: list[str], order: list, schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]]) -> DataFrame:
    """Each key's rows in order through step(state, row) -> (state, row of schema or None), from start() on.

    A key's rows are read one after the other from a sorted partition; only the state is kept. Null is a key like any other, and
    nulls reach step as None. All rows of a key go to one task, since each waits for the one before it: more machines serve more keys.
    """
    at = [rows.columns.index(k) for k in keys]
    out = T._parse_datatype_string(schema)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, start()
                state, said = step(state, row)
                if said is not None:
                    made.append(said)
            columns = list(zip(*made, strict=True)) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
