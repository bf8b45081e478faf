"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``base`` (a file or a folder of part files).

    Zone-less timestamps are cast to TIMESTAMP (session zone UTC), so that watermarks and epoch arithmetic work.
    """
    df = spark.read.parquet(f"{base}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp") for c in ntz}) if ntz else df
