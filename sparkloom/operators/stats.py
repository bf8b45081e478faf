"""Exact and histogram percentiles, islands, rollups and other aggregations that reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds (exclusive) of the latency buckets in milliseconds; a 14th bucket holds the rest.
LATENCY_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)
LATENCY_TOP = 120000


def ranked_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys``, n and a column for each share: the value at position round((n - 1) * share), halves to even, of the sorted values.

    A share of 0.5 over an even number is the mean of the two middle values. Null and NaN aren't counted. Ranks come
    from the counts of distinct values, so a hot group is sorted by value across tasks only as far as it has values.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    run = counts.withColumns({"_n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, v))

    out = []
    for name, share in shares.items():
        n = F.col("_n")
        picked = F.bround((n - 1) * F.lit(share), 0)
        if share == 0.5:
            low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
            out.append(F.round((low + high) / 2, 1).alias(name))
        else:
            out.append(F.round(at(picked), 1).alias(name))
    return run.groupBy(*keys).agg(F.max("_n").alias("n"), *out)


def bucket_index(value: Column) -> Column:
    """The latency bucket (0 to 13) of a duration: the first whose bound lies above it."""
    index = F.when(value < LATENCY_BOUNDS[0], 0)
    for i, bound in enumerate(LATENCY_BOUNDS[1:], 1):
        index = index.when(value < bound, i)
    return index.otherwise(len(LATENCY_BOUNDS))


def latency_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, calls and b0 to b13: calls in each latency bucket. Adding histograms gives the histogram of both."""
    b = bucket_index(F.col(value))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), *[F.count(F.when(b == i, 1)).alias(f"b{i}") for i in range(len(LATENCY_BOUNDS) + 1)]
    )


def histogram_percentile(share: float) -> Column:
    """The percentile of a histogram row (calls, b0 to b13), linear within its bucket, to one decimal; 0 without calls."""
    low = [0, *LATENCY_BOUNDS]
    high = [*LATENCY_BOUNDS, LATENCY_TOP]
    target = F.lit(share) * F.col("calls")
    before, out = F.lit(0), F.lit(None).cast("double")
    steps = []
    for i in range(len(low)):
        c = F.col(f"b{i}")
        steps.append((c > 0, before, c, low[i], high[i]))
        before = before + c
    for filled, under, c, a, z in reversed(steps):
        out = F.when(filled & (under + c >= target), F.lit(a) + (target - under) / c * (z - a)).otherwise(out)
    return F.round(F.when(F.col("calls") > 0, out).otherwise(F.lit(0.0)), 1)


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """``keys``, start, end, n: ranges merged where one starts at most ``gap`` after the end of what came before.

    Reversed ranges are turned round; null bounds are left out.
    """
    a, z = F.least(start, end), F.greatest(start, end)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, a.alias("_a"), z.alias("_z"))
    w = W.partitionBy(*keys).orderBy("_a", "_z")
    reach = F.max("_z").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("_a") <= reach + gap, 0).otherwise(1))
    numbered = marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_no").agg(F.min("_a").alias("start"), F.max("_z").alias("end"), F.count(F.lit(1)).alias("n")).drop("_no")


def gaps(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """``keys``, gap_start, gap_end: the whole numbers missing between neighbours of a sequence."""
    before = F.lag(seq).over(W.partitionBy(*keys).orderBy(seq))
    rows = df.withColumn("_b", before)
    return rows.where(F.col(seq) > F.col("_b") + 1).select(*keys, (F.col("_b") + 1).alias("gap_start"), (F.col(seq) - 1).alias("gap_end"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
