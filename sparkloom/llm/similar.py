"""The most similar vectors for every vector, by randomly rotated one-bit codes.

1. A bounded sample of each space gives it centroids (about one per LIST_ROWS vectors). Every vector is a query in the
   list of its nearest centroid, and is stored in the lists of its SPREAD nearest ones.
2. Stored is its residual to the centroid as a code: the signs after a random rotation, packed to one bit each, with
   the residual's length, its product with the code and its product with the centroid as correction scalars.
3. In each list the products of queries and vectors are estimated from bits and scalars. The estimate's error bound
   decides: what may still be among the k best (upper bound at or above the k-th best lower bound, and the floor) is
   computed exactly from the vectors, nothing else.
Long lists are cut into blocks on both sides, so a list that holds a third of all rows is many tasks. Equal vectors are
one vector in the search and are told apart afterwards.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.durable import durable
from sparkloom.plans.skew import lookup

#: Vectors a list is meant for; most lists of all spaces together; vectors the centroids are fitted on.
LIST_ROWS, MAX_LISTS, SAMPLE = 1024, 16_384, 40_000
#: Lists each vector is stored in.
SPREAD = 6
#: Queries and stored vectors of one block.
BLOCK_QUERIES, BLOCK_VECTORS = 2048, 8192
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.5
DECIMALS = 6


def usable(text: str | None, dimension: int | None) -> np.ndarray | None:
    """The vector in a JSON text: an array of finite numbers, not all zero, as many as ``dimension`` (0, null: any)."""
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list) or not value or (dimension and dimension != len(value)):
        return None
    if not all(type(x) in (int, float) for x in value):
        return None
    try:
        v = np.array(value, dtype=np.float64)
    except OverflowError:
        return None
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def vectors(rows: DataFrame, key: str, embedding: str, space: str, dimension: str, order: str) -> DataFrame:
    """space, n, id, g, v of the usable embeddings: v is the vector at length 1 (float32), g marks equal ones.

    A null space counts as the empty one. Of several usable rows of a key in one space and count the latest counts, of
    equally late ones the larger. Rows without a key are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [usable(t, d) for t, d in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([i for i, v in enumerate(found) if v is not None], pa.int64())
            good = [v for v in found if v is not None]
            yield pa.RecordBatch.from_arrays(
                [b.column(2).take(keep), pa.array([len(v) for v in good], pa.int32()), b.column(0).take(keep), b.column(4).take(keep), pa.array([v.astype(np.float32).tobytes() for v in good], pa.binary())],
                ["space", "n", "id", "at", "v"],
            )

    picked = rows.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{embedding}`").cast("string").alias("e"), F.coalesce(F.col(f"`{space}`").cast("string"), F.lit("")).alias("space"),
        F.col(f"`{dimension}`").cast("long").alias("d"), F.unix_micros(F.col(f"`{order}`")).alias("at"),
    )
    parsed = picked.mapInArrow(run, "space string, n int, id string, at long, v binary")
    last = parsed.withColumn("r", F.row_number().over(W.partitionBy("space", "n", "id").orderBy(F.desc_nulls_last("at"), F.desc("v")))).where("r = 1")
    return durable(last.select("space", "n", "id", F.unhex(F.md5(F.concat(F.encode(F.concat_ws("\x1f", "space", "n"), "utf-8"), "v"))).alias("g"), "v"))


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds from evenly drawn rows."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c.astype(np.float32)


def centroids(groups: DataFrame) -> tuple[dict, int]:
    """{(space, n): (number of the first list, centroids)}, number of lists; fitted on about SAMPLE rows of all spaces.

    A space too rare to be in the sample has no entry and is one list, cut into blocks as any other.
    """
    total = groups.count()
    share = min(1.0, SAMPLE / max(1, total))
    rows = groups.sample(share, seed=11).select("space", "n", "v").limit(2 * SAMPLE).collect()  # bounded
    by: dict = {}
    for r in rows:
        by.setdefault((r.space, r.n), []).append(np.frombuffer(r.v, dtype=np.float32))
    out, first = {}, 0
    for key in sorted(by):
        x = np.stack(by[key])
        k = max(1, min(len(x) // 8, round(len(x) / share / LIST_ROWS), MAX_LISTS * len(x) // len(rows)))
        out[key] = (first, _means(x, k))
        first += k
    return out, first


@lru_cache
def rotation(n: int) -> np.ndarray:
    """A random rotation of ``n`` dimensions, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, scalars) of the rows of ``x`` against one centroid.

    Scalars of a row: length of its residual, product of the residual's direction with the code, product with the centroid.
    """
    rest = (x - centre) @ rotation(x.shape[1])
    length = np.sqrt((rest * rest).sum(1))
    made = np.abs(rest).sum(1) / np.maximum(length, 1e-12) / math.sqrt(x.shape[1])
    return np.packbits(rest > 0, axis=1), np.stack([length, np.where(length > 1e-9, made, 1.0), x @ centre], axis=1).astype(np.float32)


def estimate(queries: np.ndarray, centre: np.ndarray, bits: np.ndarray, scalars: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated products, error bounds) of each query with each coded vector."""
    n = queries.shape[1]
    rest = (queries - centre) @ rotation(n)
    size = np.sqrt((rest * rest).sum(1))
    signs = np.unpackbits(bits, axis=1, count=n).astype(np.float32) * 2 - 1
    length, made, with_centre = scalars.T
    guess = (rest @ signs.T) * (length / made / math.sqrt(n)) + (queries @ centre)[:, None] + with_centre - float(centre @ centre)
    spread = epsilon * np.sqrt(np.maximum(0, 1 - made * made)) / made / math.sqrt(max(1, n - 1))
    return guess, size[:, None] * (length * spread)


def search(qv: np.ndarray, xv: np.ndarray, bits: np.ndarray, scalars: np.ndarray, centre: np.ndarray, same: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity) of what may be among the k best of a query; ``same`` is the query's own place, or -1."""
    found: list[tuple] = []
    for a in range(0, len(qv), 256):
        q = qv[a : a + 256]
        guess, bound = estimate(q, centre, bits, scalars)
        rows = np.arange(len(q))
        own = same[a : a + 256]
        guess[rows[own >= 0], own[own >= 0]] = -9
        low = guess - bound
        least = np.full(len(q), floor, dtype=np.float32)
        if low.shape[1] > k:
            least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
        i, j = np.nonzero(guess + bound + 1e-5 >= least[:, None])
        real = guess[i, j] > -5
        i, j = i[real], j[real]
        for s in range(0, len(i), 100_000):  # exact, for these only
            x, y = i[s : s + 100_000], j[s : s + 100_000]
            sim = np.round(np.einsum("ij,ij->i", q[x].astype(np.float64), xv[y].astype(np.float64)), DECIMALS)
            keep = sim >= floor
            found.append((x[keep] + a, y[keep], sim[keep]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    kth = np.full(len(qv), -9.0)
    kth[i[place == k - 1]] = s[place == k - 1]
    keep = s >= kth[i]  # with all that tie with the k-th
    return i[keep], j[keep], s[keep]


def most_similar(rows: DataFrame, k: int = 5, floor: float = -1.0, spread: int = SPREAD) -> DataFrame:
    """space, n, id, neighbour, similarity: for every id of ``vectors`` its ``k`` most similar others of its space and count.

    Similarities are rounded to 6 decimals; equal ones are ordered by id. ``floor`` leaves out what is less similar.
    Ids with an equal vector are neighbours of similarity 1. The result is approximate in that a neighbour stored in
    none of the lists it shares with the query, or beyond its error bound, isn't seen; what comes out is exact.
    """
    w = W.partitionBy("g").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    groups = durable(few.groupBy("g").agg(F.first("space").alias("space"), F.first("n").alias("n"), F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    spark = rows.sparkSession
    index, lists = centroids(groups)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "query", "g", "ids", "v", "bits", "scalars"]
        for b in batches:
            spaces, sizes, vs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            by: dict = {}
            for i, key in enumerate(zip(spaces, sizes)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                first, c = shared.value.get(key, (None, np.zeros((1, key[1]), dtype=np.float32)))
                x = np.stack([np.frombuffer(vs[i], dtype=np.float32) for i in at])
                near = np.argsort(-(x @ c.T - 0.5 * (c * c).sum(1)), axis=1, kind="stable")[:, :spread]
                take = pa.array(at, pa.int64())
                cols = [b.column(2).take(take), b.column(4).take(take), b.column(3).take(take)]
                tag = [f"{key[0]}\x1f{key[1]}\x1f{j}" if first is None else str(first + j) for j in range(len(c))]
                none = pa.nulls(len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([tag[j] for j in near[:, 0]]), pa.array([True] * len(at)), *cols, none, none], names)
                for j in np.unique(near):
                    own = np.flatnonzero((near == j).any(1))
                    bits, scalars = encode(x[own], c[j])
                    t = pa.array(own, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tag[j]] * len(own)), pa.array([False] * len(own)), *(col.take(t) for col in cols), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array([r.tobytes() for r in scalars], pa.binary())],
                        names,
                    )

    placed = groups.select("space", "n", "g", "v", "ids").mapInArrow(place, "list string, query boolean, g binary, ids array<string>, v binary, bits binary, scalars binary")
    placed = durable(placed)
    sizes = placed.groupBy("list").agg(F.count(F.when(F.col("query"), 1)).alias("nq"), F.count(F.when(~F.col("query"), 1)).alias("nx"))
    cut = placed.join(sizes, "list")  # a row for each list, at most MAX_LISTS and the rare spaces
    qb, xb = F.ceil(F.col("nq") / BLOCK_QUERIES), F.ceil(F.col("nx") / BLOCK_VECTORS)
    mine = F.pmod(F.xxhash64("g"), F.when(F.col("query"), qb).otherwise(xb))
    other = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.when(F.col("query"), xb).otherwise(qb)) - 1)
    blocks = cut.where("nq > 0").select("list", "query", "g", "ids", "v", "bits", "scalars", mine.alias("own"), F.explode(other).alias("met"))
    blocks = blocks.withColumn("block", F.when(F.col("query"), F.concat_ws(":", "own", "met")).otherwise(F.concat_ws(":", "met", "own"))).drop("own", "met")

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        q, x = frame[frame["query"]], frame[~frame["query"]]
        if not len(q) or not len(x):
            return pd.DataFrame({"g": [], "similarity": [], "ids": []})
        qv, xv = (np.stack([np.frombuffer(v, dtype=np.float32) for v in f["v"]]) for f in (q, x))
        bits = np.stack([np.frombuffer(v, dtype=np.uint8) for v in x["bits"]])
        scalars = np.stack([np.frombuffer(v, dtype=np.float32) for v in x["scalars"]])
        name = frame["list"].iloc[0]
        centre = np.zeros(qv.shape[1], dtype=np.float32)
        if "\x1f" not in name:
            centre = next(c[int(name) - first] for first, c in shared.value.values() if first <= int(name) < first + len(c))
        at = {g: i for i, g in enumerate(x["g"])}
        same = np.array([at.get(g, -1) for g in q["g"]])
        i, j, s = search(qv, xv, bits, scalars, centre, same, k, floor)
        return pd.DataFrame({"g": q["g"].to_numpy()[i], "similarity": s, "ids": x["ids"].to_numpy()[j]})

    met = blocks.groupBy("list", "block").applyInPandas(look, "g binary, similarity double, ids array<string>")
    order = W.partitionBy("g").orderBy(F.desc("similarity"), F.col("ids")[0])
    best = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    best = best.groupBy("g").agg(F.collect_list(F.struct("similarity", "ids")).alias("near"))
    pool = lookup(groups.select("g", "ids"), best, ["g"])
    own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("i")))
    others = F.flatten(F.transform("near", lambda p: F.transform(p["ids"], lambda i: F.struct((-p["similarity"]).alias("s"), i.alias("i")))))
    ranked = F.when(F.col("near").isNull(), own).otherwise(F.concat(own, others))
    pool = pool.select("g", F.array_sort(ranked).alias("near"))
    each = lookup(rows.select("space", "n", "g", "id"), pool, ["g"], "inner")
    kept = each.select("space", "n", "id", F.explode(F.slice(F.filter("near", lambda p: p["i"] != F.col("id")), 1, k)).alias("p"))
    return kept.select("space", "n", "id", F.col("p.i").alias("neighbour"), (-F.col("p.s")).alias("similarity")).where(F.col("similarity") >= floor)
