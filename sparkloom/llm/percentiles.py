"""Percentiles with a bounded relative error from signed logarithmic buckets.

A value v falls into bucket ceil(log(|v|) / log(g)) of its sign, g = (1 + a) / (1 - a); the estimate of a bucket,
2 g^b / (g + 1), is off by at most a times the value. Counts of equal buckets add up, so sketches of days, files or
partitions combine by one sum; a sketch of a group has at most a few thousand buckets, whatever its rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.01
#: The bucket of the infinite values of a sign.
INFINITE = 2**31 - 1


def _log_gamma(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def bucket_of(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """The bucket number of |value|; null for 0, INFINITE for an infinite one."""
    return F.when(F.abs(value) == float("inf"), F.lit(INFINITE)).otherwise(F.ceil(F.log(F.abs(value)) / F.lit(_log_gamma(error))).cast("int"))


def sketch(df: DataFrame, groups: list[str], value: str, error: float = RELATIVE_ERROR, *also: Column) -> DataFrame:
    """``groups``, sign (-1, 0, 1), bucket, n: the sketch of each group.

    Null and NaN aren't counted; infinite values have a bucket of their own at each end. A group without a value has no
    row. Partial counts are made before the shuffle, so what moves is buckets and a hot group costs no more than any
    other. ``also`` are further aggregates of each bucket.
    """
    v = F.col(f"`{value}`").cast("double")
    sign = F.signum(v).cast("int")
    bucket = F.when(v == 0, F.lit(0)).otherwise(bucket_of(v, error))
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*[F.col(f"`{g}`") for g in groups], sign.alias("sign"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), *also)
    )


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sums sketches that were computed apart (union them first).

    Rows must have been counted in one sketch only: repeats of a row that may lie in two files are to be removed
    before, or the sketches made by a key under which all repeats fall together (the day of a row, say).
    """
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def _ordered(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Adds ``upto``, the count up to and with the bucket in order of value, and the group's ``total``."""
    order = F.col("sign") * F.col("bucket")
    w = W.partitionBy(*groups)
    run = w.orderBy("sign", order).rowsBetween(W.unboundedPreceding, 0)
    return sketches.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(w)})


def rank_of(total: Column, share: float) -> Column:
    """The least rank at which at least ``share`` of ``total`` values are reached; 1 for a share of 0.

    Counted in whole numbers from the share as written; one of more than 9 decimals is an error.
    """
    part = Fraction(str(share))
    if not 0 <= part <= 1 or part.denominator > 10**9:
        raise ValueError(f"share {share}")
    a, b = part.numerator, part.denominator
    return F.greatest(F.lit(1).cast("long"), F.call_function("div", total.cast("long") * F.lit(a).cast("long") + F.lit(b - 1).cast("long"), F.lit(b).cast("long")))


def bucket_at(sketches: DataFrame, groups: list[str], share: float, also: tuple[str, ...] = ()) -> DataFrame:
    """For each group the bucket that holds the value of that share, with ``below`` (the count before it) and ``total``."""
    rank = rank_of(F.col("total"), share)
    return (
        _ordered(sketches, groups)
        .withColumn("below", F.col("upto") - F.col("n"))
        .where((F.col("below") < rank) & (rank <= F.col("upto")))
        .select(*groups, "sign", "bucket", "below", "n", "total", *also)
    )


def estimates(sketches: DataFrame, groups: list[str], shares: dict[str, float], error: float = RELATIVE_ERROR) -> DataFrame:
    """``groups``, n and a column for each of ``shares``; every estimate is within ``error`` of the exact value.

    The exact value is the smallest one that at least that share of the values doesn't exceed.
    """
    g = (1 + error) / (1 - error)
    guess = F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    rows = _ordered(sketches, groups).withColumns({"below": F.col("upto") - F.col("n"), "guess": guess})
    found = [
        F.max(F.when((F.col("below") < rank_of(F.col("total"), s)) & (rank_of(F.col("total"), s) <= F.col("upto")), F.col("guess"))).alias(name)
        for name, s in shares.items()
    ]
    return rows.groupBy(*groups).agg(F.max("total").alias("n"), *found)


def groups_above(
    df: DataFrame, groups: list[str], value: str, share: float, limit: float, error: float = RELATIVE_ERROR
) -> DataFrame:
    """The groups whose exact percentile lies above ``limit`` (> 0).

    The sketch decides every group whose percentile falls into another bucket than the limit does. For the remaining
    ones the values of that one bucket are counted against the limit in the same pass, which makes the answer exact.
    """
    v = F.col(f"`{value}`").cast("double")
    edge = bucket_of(F.lit(limit), error)
    under = F.count(F.when((v > 0) & (bucket_of(v, error) == edge) & (v <= F.lit(limit)), 1)).alias("under")
    at = bucket_at(sketch(df, groups, value, error, under), groups, share, ("under",))
    rank = rank_of(F.col("total"), share)
    positive = F.col("sign") == 1
    over = (positive & (F.col("bucket") > edge)) | (positive & (F.col("bucket") == edge) & (F.col("below") + F.col("under") < rank))
    return at.where(over).select(*[F.col(f"`{g}`") for g in groups])
