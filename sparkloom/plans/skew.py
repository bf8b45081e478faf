"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so there are fewer hot keys than this.
HOT_ONE_IN = 200


def hot_keys(df: DataFrame, keys: list[str], one_in: int = HOT_ONE_IN, least: int = 10_000) -> DataFrame:
    """The keys with more than ``least`` rows and more than one row in ``one_in``: fewer than ``one_in`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.greatest(F.lit(least), F.count(F.lit(1)) / F.lit(one_in)).alias("_t"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_t")).drop("_n", "_t")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which holds each key at most once; how is left, inner, left_semi or left_anti.

    Rows of hot keys meet their one partner by a broadcast of fewer than HOT_ONE_IN rows; the others are shuffled.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(how)
    hot = [tuple(r) for r in hot_keys(left.select(*keys), keys).collect()]  # fewer than HOT_ONE_IN rows
    if not hot:
        return left.join(right, keys, how)
    marks = left.sparkSession.createDataFrame(hot, left.select(*keys).schema)
    rest = left.join(F.broadcast(marks), keys, "left_anti")
    part = left.join(F.broadcast(marks), keys, "left_semi")
    few = right.join(F.broadcast(marks), keys, "left_semi")
    return rest.join(right, keys, how).unionByName(part.join(F.broadcast(few), keys, how))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], pieces: int = 32) -> DataFrame:
    """The inner join of two sides that may both hold a key many times.

    Keys that are hot on the left (fewer than HOT_ONE_IN of them) are cut into ``pieces``: each of their left rows goes to
    one piece by its own hash, each of their right rows to all pieces. No key then meets in one task alone.
    """
    hot = [tuple(r) for r in hot_keys(left.select(*keys), keys).collect()]  # fewer than HOT_ONE_IN rows
    if not hot:
        return left.join(right, keys)
    marks = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys).schema))
    rest = left.join(marks, keys, "left_anti").join(right, keys)
    part = left.join(marks, keys, "left_semi").withColumn("_piece", F.pmod(F.xxhash64(*left.columns), F.lit(pieces)))
    every = right.join(marks, keys, "left_semi").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    return rest.unionByName(part.join(every, [*keys, "_piece"]).drop("_piece"))
