"""Streams over files of events: windows with watermarks, first occurrences, and a stateful rate limit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import folded
from ..functions.storage import shared_dir

LATE = "2 days"


def source(spark: SparkSession, path: str, watermark: str = LATE, files: int | None = None) -> DataFrame:
    """Files of events as a stream, with their schema and a watermark on ts (as an instant).

    The files that are there make one batch, as they are in no order of time and the watermark of one batch would drop
    what another has from long before. files limits how many a batch takes, where they come in order of time.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path + "*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with less than gap between them; late data within the watermark still joins sessions up."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and event time, as long as the watermark has not passed it."""
    return events.dropDuplicates([*keys, "ts"])


def rate_limited(events: DataFrame, most: int = 3, seconds: int = 86_400, delay: int = 2 * 86_400) -> DataFrame:
    """(user_id, event_id, admitted): at most so many admitted events of a user within any span of seconds. Runs the stream over all that is there.

    Each batch of the stream is judged up to its watermark, the latest time seen less delay; later events are held back for the next, so
    that events are judged in the order of their times however the files deal them out. What is held when the stream ends is judged then.
    Late rows, those of a time that has been judged already, are left out. The state between batches are the admitted events of the last
    span, at most `most` rows for each user who had any, in a table; users who have none left are forgotten. Events without a time
    are left out; those without a user are one user's.
    """
    spark, span = events.sparkSession, seconds * 1_000_000
    at = f"{shared_dir(spark)}/limit-{uuid.uuid4().hex}"
    kinds = "user_id long, event_id long, t long, admitted boolean"

    def judged(batch: DataFrame | None, number: int, last: int, final: bool) -> int:
        """Writes the table `number` of what it judged, of what it holds back and of the state after it; takes those of the batch before."""
        before = lambda what, schema: spark.read.schema(schema).parquet(f"{at}/{what}/{number - 1}") if number else spark.createDataFrame([], schema)
        rows = before("held", "user_id long, event_id long, t long")
        if batch is not None:
            rows = rows.unionByName(batch.where(F.col("t") >= last))
        mark = None if final else rows.agg(F.max("t")).first()[0]
        mark = 2**62 if final else last if mark is None else max(last, mark - delay * 1_000_000)
        rows = rows.withColumn("prior", F.lit(0))
        now = rows.where(F.col("t") < mark).unionByName(before("state", "user_id long, event_id long, t long").withColumn("prior", F.lit(1)))

        def step(times: list[int], row: tuple) -> tuple[list[int], tuple | None]:
            user, event, t, prior = row
            if prior:
                return [*times, t], None
            times = [x for x in times if t - x < span]
            ok = len(times) < most
            return ([*times, t] if ok else times), (user, event, t, ok)

        folded(now.select("user_id", "event_id", "t", "prior"), ["user_id"], [F.desc("prior"), "t", "event_id"], kinds, list, step).write.mode("overwrite").parquet(f"{at}/out/{number}")
        rows.where(F.col("t") >= mark).drop("prior").write.mode("overwrite").parquet(f"{at}/held/{number}")
        admitted = spark.read.schema(kinds).parquet(f"{at}/out/{number}").where("admitted").select("user_id", "event_id", "t")
        kept = now.where("prior = 1").drop("prior").unionByName(admitted).where(F.col("t") > mark - span)
        kept.write.mode("overwrite").parquet(f"{at}/state/{number}")
        return mark

    done, mark = 0, -(2**62)

    def write(batch: DataFrame, number: int) -> None:
        nonlocal done, mark
        mark = judged(batch, number, mark, False)
        done = number + 1

    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("t")).where("t IS NOT NULL")
    rows.writeStream.option("checkpointLocation", f"{at}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    judged(None, done, mark, True)
    out = spark.read.schema(kinds).parquet(*(f"{at}/out/{n}" for n in range(done + 1)))
    return out.select("user_id", "event_id", "admitted")


def settle(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and read what it wrote.

    In complete mode each batch replaces the table by its number, and the last one is the result; in append mode
    files are added, exactly once.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/table")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/{number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
