"""Tables written to the folder that driver and executors share, tasks by counted rows, and ranks over tables of any size."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[str] = []
_LOW = (1 << 33) - 1
#: Rows that a task sorts or groups at once.
ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of our own, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder as Parquet and read again, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str | Column, each: int | None = None) -> DataFrame:
    """df by keys over so many tasks that each has about `each` (ROWS) of its `rows` rows, or a tenth, until all cores have some.

    Spark would join small partitions by their compressed bytes, down to one a core: a task would grow with the input.
    """
    each = each or ROWS
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(rows / each), min(cores, math.ceil(rows / each * 10))), *keys)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, each row's place (from 1) in the order: range partitions, each place its offset and place within.

    The order must be total. No task holds more than one range; the offsets are one row a partition.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(ranges.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(_LOW))).drop("_id"), name)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))
