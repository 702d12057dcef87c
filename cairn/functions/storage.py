"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this process for a local master, as in tests; a cluster has to name one."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairn-checkpoint-"))
        place = context.getCheckpointDir()
    return f"{place}/cairn-{context.applicationId}"


#: Where cut() wrote, in order, and the tables of dealt().
written: list[str] = []
tables: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df and read it back: short lineage, computed once, and a result that outlives its executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions by columns, none put together: what is then grouped by these takes no second shuffle, and no task holds more than its share in a hash table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Write df dealt into buckets by a column, each row once: joins on that column no longer shuffle it, however often it is read. Buckets are as many as shuffle partitions."""
    return bucketed(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).distinct(), by)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Write df, which lies by a column already, in buckets by it, as many as shuffle partitions."""
    spark = df.sparkSession
    name, many = f"cairn_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables.append(name)
    df.write.bucketBy(many, by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def spread_names(spark: SparkSession, many: int) -> list[int]:
    """Numbers for blocks which Spark's hash deals evenly over the shuffle partitions, so that no task has several blocks while another has none."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(20 * max(many, parts)).select(F.col("id").cast("int").alias("n"))
    rows = numbers.select("n", F.pmod(F.hash("n"), F.lit(parts)).alias("part")).collect()  # some for each partition
    seen: dict[int, int] = {}
    turns = []
    for x in rows:
        seen[x.part] = seen.get(x.part, 0) + 1
        turns.append((seen[x.part], x.part, x.n))
    return [n for _, _, n in sorted(turns)[:many]]


def sweep(spark: SparkSession, *paths: str) -> None:
    """Delete tables of cut() that nothing reads any more, and the shuffles of steps that are done: Spark drops a shuffle's files once the driver's garbage
    collector has met it, which left to itself may be long after a loop has ended."""
    for path in paths:
        delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table of bucketed() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        name = path.rpartition("/")[2]
        if name in tables:
            tables.remove(name)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application's cut() wrote, once its results are written elsewhere."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, shared_dir(spark))
    written.clear()
    tables.clear()
