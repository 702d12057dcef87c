"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_dir  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def counted_out(df: DataFrame, n: str, to: str, block: int = 10_000) -> DataFrame:
    """Each row as often as n says, with to counting from 1. A row is given out in blocks, so that no array is as long as the count."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block)))
    rows = df.where(F.col(n) > 0).withColumn("_block", parts)
    left = F.least(F.lit(block).cast("long"), F.col(n) - F.col("_block") * block)
    return rows.withColumn(to, F.explode(F.sequence(F.lit(1).cast("long"), left))).withColumn(to, F.col(to) + F.col("_block") * block).drop("_block")


def word_count(text: Column) -> Column:
    """How many words a text has; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
