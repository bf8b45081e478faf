"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    ``spark.checkpoint.dir`` of the session or the application comes first. Only where neither names a folder
    (local tests) one is made on this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"sparkloom-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Runs ``df``, writes it to the checkpoint folder and returns it with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
