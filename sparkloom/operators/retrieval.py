"""Lexical and vector retrieval: BM25, overlap, cosine, rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _same(word: str):
    return lambda x: x == F.lit(word)


def bm25(docs: DataFrame, key: str, text: str, query: Sequence[str], k: int) -> DataFrame:
    """``key``, score: the ``k`` best documents for the OR of the query's terms (k1 1.2, b 0.75), ties by key.

    Only the query's postings are made: each document is counted where it stands, and what is shuffled are totals.
    """
    wanted = [w.lower() for w in dict.fromkeys(query)]
    base = docs.where(F.col(text).isNotNull()).select(F.col(key), terms(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    tf = base.select(key, "_n", *[F.size(F.filter("_w", _same(w))).alias(f"_t{i}") for i, w in enumerate(wanted)])
    seen = tf.agg(F.count(F.lit(1)).alias("_d"), F.avg("_n").alias("_avg"), *[F.count(F.when(F.col(f"_t{i}") > 0, 1)).alias(f"_f{i}") for i in range(len(wanted))])
    rows = tf.where(" OR ".join(f"_t{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(seen))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(wanted)):
        t, f = F.col(f"_t{i}"), F.col(f"_f{i}")
        idf = F.log(1 + (F.col("_d") - f + 0.5) / (f + 0.5))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    return rows.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; null if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """``key``, score: the ``k`` vectors of largest cosine to ``query``, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, item: str, order: Sequence[Column], distinct: bool = True) -> DataFrame:
    """``item``, rank (from 1): each item at its first place; with ``distinct`` repeated items use up no ranks.

    ``hits`` is a ranked list (a page), not a corpus: its places are numbered in one task.
    """
    w = W.orderBy(*order)
    placed = hits.withColumn("_p", F.row_number().over(w))
    first = placed.groupBy(item).agg(F.min("_p").alias("_p"))
    return first.select(item, (F.row_number().over(W.orderBy("_p")) if distinct else F.col("_p")).alias("rank"))


def fuse(lists: dict[str, tuple[DataFrame, float]], item: str, k: int, bonus: float = 0.0, most: float = 0.0) -> DataFrame:
    """``item``, score, sources: weighted reciprocal rank fusion of ranked lists (``item``, rank), ties by item.

    Each list adds weight / (60 + rank); being in several lists adds ``bonus`` for each beyond the first, ``most`` at most.
    """
    parts = [df.select(item, (F.lit(w) / (RRF_K + F.col("rank"))).alias("s"), F.lit(n).alias("src")) for n, (df, w) in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    g = both.groupBy(item).agg(F.sum("s").alias("s"), F.count_distinct("src").alias("sources"))
    agreed = F.least(F.lit(most), F.lit(bonus) * (F.col("sources") - 1))
    return g.select(item, F.round(F.col("s") + agreed, 8).alias("score"), "sources").orderBy(F.desc("score"), item).limit(k)
