"""An ordered event log and stream aggregations with Structured Streaming.

Streams are run to the end of what is there (availableNow), so a result is a table that a batch query can be held
against. State is bounded by watermarks.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.durable import checkpoint_dir


def read(spark: SparkSession, base: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the parquet table ``name`` (a file or a folder of part files)."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    s = s.parquet(path) if os.path.isdir(path) else s.option("pathGlobFilter", f"{name}.parquet").parquet(base)
    ntz = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return s.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else s


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream to the end of its input and returns what it wrote, from the shared checkpoint folder."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number:09d}")

    writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{root}/out/*")


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key of an update stream's output."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_batch")))
    return updates.withColumn("_r", r).where("_r = 1").drop("_r", "_batch")


def append_once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The stream with repeats of a key left out, as long as they come within ``late`` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sequence(events: DataFrame, stream: str, order: list[Column]) -> DataFrame:
    """Adds seq: the place of each event in its stream, from 1."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(stream).orderBy(*order)))


def page(events: DataFrame, after: int, through: int, limit: int) -> DataFrame:
    """Events with after < seq <= through in order of seq, at most ``limit``."""
    return events.where((F.col("seq") > after) & (F.col("seq") <= through)).orderBy("seq").limit(limit)


def retained(events: DataFrame, stream: str, time: Column, cutoff: Column) -> DataFrame:
    """The events from each stream's first recent one on: what stays has no gaps."""
    first = F.min(F.when(time >= cutoff, F.col("seq"))).over(W.partitionBy(stream))
    return events.withColumn("_first", first).where(F.col("seq") >= F.col("_first")).drop("_first")


