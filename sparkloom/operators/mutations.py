"""Upserts, retention and eviction as rewrites: each takes the stored rows and gives the rows to store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import stats


def upsert_counters(stored: DataFrame, new: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters of equal keys added up."""
    return stored.select(*keys, *counters).unionByName(new.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def upsert_latest(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (latest first)."""
    return stats.latest(stored.unionByName(new), keys, order)


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows and those new ones whose key isn't stored; of equal new keys one."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def keep_newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``."""
    return stats.top_per_group(rows, keys, order, k).drop("rank")


def keep_within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """The rows of each key, best first, as long as their sizes together stay within ``budget``."""
    run = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")
