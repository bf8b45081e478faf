"""Retrieval and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, case: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """``case``, precision, rr, ndcg (named with ``k``) of ranked hits with binary relevance (1 or 0)."""
    r = F.col(rank)
    rows = hits.withColumn("_rel", relevant)
    g = rows.groupBy(case).agg(
        F.sum(F.when(r <= k, F.col("_rel"))).alias("_in"), F.min(F.when(F.col("_rel") == 1, r)).alias("_first"), F.sum("_rel").alias("_all"),
        F.sum(F.when(r <= k, F.col("_rel") / F.log2(r + 1))).alias("_dcg"),
    )
    n = F.least(F.lit(k), F.col("_all")).cast("int")
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return g.select(case, F.round(F.col("_in") / k, 6).alias(f"precision{k}"), F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("_dcg") / ideal, F.lit(0.0)), 6).alias(f"ndcg{k}"))


def paired_deltas(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row: cases matched, and the mean of after - before for each metric; cases on one side only aren't counted."""
    a = before.select(key, *[F.col(m).alias(f"_a_{m}") for m in metrics])
    both = a.join(after.select(key, *metrics), key)
    return both.agg(F.count(F.lit(1)).alias("matched"), *[F.round(F.avg(F.col(m) - F.col(f"_a_{m}")), 6).alias(m) for m in metrics])
