"""Near-duplicate classes and splits of a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import graph
from sparkloom.plans.durable import durable


def simhash(text: str, size: int = 4) -> int:
    """64 votes over the digests (MD5, first 16 hex digits) of the character runs of a text, as a signed whole number.

    The text is taken in lower case with single blanks; one shorter than ``size`` is one run.
    """
    plain = " ".join(text.lower().split())
    runs = [plain[i : i + size] for i in range(max(1, len(plain) - size + 1))]
    digests = np.frombuffer(b"".join(hashlib.md5(r.encode("utf-8", "surrogatepass")).digest()[:8] for r in runs), dtype=np.uint8).reshape(-1, 8)
    votes = np.unpackbits(digests, axis=1).astype(np.int32).sum(axis=0) * 2 - len(runs)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def simhashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, simhash of every row; null for a null text."""
    kind = T.StructType([df.schema[key], T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else simhash(t) for t in b.column(1).to_pylist()], pa.int64())], [key, "simhash"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, kind)


def simhash_classes(df: DataFrame, key: str, mark: str, distance: int) -> DataFrame:
    """``key``, class_id: the smallest key of those linked by marks that differ in at most ``distance`` bits.

    Equal marks are one node. Two marks within the distance agree in one of distance + 1 bands of 64 bits; what meets
    in a band is compared. Null marks are left out.
    """
    n = distance + 1
    width = -(-64 // n)
    rows = durable(df.where(F.col(mark).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(mark).alias("m")))
    nodes = rows.groupBy("m").agg(F.min("k").alias("k"))
    bands = F.array(*[F.shiftrightunsigned("m", i * width).bitwiseAND(F.lit((1 << min(width, 63)) - 1)) for i in range(n)])
    keyed = nodes.select("m", "k", F.posexplode(bands).alias("band", "b"))
    pairs = keyed.alias("x").join(keyed.alias("y"), ["band", "b"]).where("x.m < y.m").where(F.bit_count(F.col("x.m").bitwiseXOR(F.col("y.m"))) <= distance)
    links = pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    classes = graph.components(links, nodes.select(F.col("k").alias("node")))
    return rows.join(nodes.withColumnRenamed("k", "node"), "m").join(classes, "node").select(F.col("k").alias(key), F.col("component").alias("class_id"))


def held_out_groups(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """``group``, split: groups in order of sha256(seed NUL group) are held out (eval) until they hold ``share`` of the rows."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2(F.concat(F.lit(seed + "\0"), F.col(group)), 256))
    total = g.agg(F.round(F.sum("n") * share).alias("t"))
    before = F.coalesce(F.sum("n").over(W.orderBy("h", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # groups, not rows
    return g.withColumn("before", before).crossJoin(F.broadcast(total)).select(group, F.when(F.col("before") < F.col("t"), "eval").otherwise("train").alias("split"))
