import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import curation, graph, mutations, quality, retrieval, stats
from sparkloom.plans import skew


def test_percentile_rule(spark):
    rows = [("a", float(v)) for v in (10, 20, 30, 40)] + [("b", float(v)) for v in range(1, 102)] + [("c", None), ("d", float("nan")), ("e", 7.0), (None, 5.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in stats.ranked_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (4, 25.0, 40.0), "b": (101, 51.0, 96.0), "e": (1, 7.0, 7.0), None: (1, 5.0, 5.0)}
    assert stats.ranked_percentiles(df.limit(0), ["k"], "v", {"p50": 0.5}).count() == 0


def test_histograms_add_up(spark):
    df = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 5.0), ("a", "y", 99999.0), ("b", "x", 60000.0), ("b", "x", None)], "k string, s string, v double")
    whole = {r.k: r.asDict() for r in stats.latency_histogram(df, ["k"], "v").collect()}
    assert whole["a"]["calls"] == 3 and (whole["a"]["b0"], whole["a"]["b1"], whole["a"]["b13"], whole["b"]["b13"]) == (1, 1, 1, 1)
    parts = stats.latency_histogram(df, ["k", "s"], "v").groupBy("k").agg(*[F.sum(c).alias(c) for c in ["calls", *[f"b{i}" for i in range(14)]]])
    assert {r.k: r.asDict() for r in parts.collect()} == whole
    p = stats.latency_histogram(spark.createDataFrame([("a", 7.0)] * 10, "k string, v double"), ["k"], "v").select(stats.histogram_percentile(0.5).alias("p")).first().p
    assert p == 7.5


def test_islands_and_gaps(spark):
    rows = [("f", 1, 5), ("f", 6, 8), ("f", 10, 12), ("f", 12, 11), ("g", 9, 3), ("g", None, 4), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    assert sorted((r.k or "", r.start, r.end, r.n) for r in stats.islands(df, ["k"], "a", "b").collect()) == [("", 1, 1, 1), ("f", 1, 8, 2), ("f", 10, 12, 2), ("g", 3, 9, 1)]
    seq = spark.createDataFrame([("s", i) for i in (1, 2, 5, 9, 10)], "k string, i int")
    assert sorted((r.gap_start, r.gap_end) for r in stats.gaps(seq, ["k"], "i").collect()) == [(3, 4), (6, 8)]


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_keys", lambda df, keys, **_: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 50").select(*keys))
    left = spark.createDataFrame([(0 if i < 300 else i, i) for i in range(400)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (350, "b"), (777, "c")], "k long, w string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert sorted(map(str, skew.lookup(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    many = spark.createDataFrame([(k, i) for i in range(70) for k in (0, 5)] + [(350, 1)], "k long, x long")
    assert sorted(map(tuple, skew.spread_join(left, many, ["k"]).select("k", "v", "x").collect())) == sorted(map(tuple, left.join(many, "k").select("k", "v", "x").collect()))
    with pytest.raises(ValueError):
        skew.lookup(left, right, ["k"], "cross")


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_equal_to_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7)]
    nodes = [*range(200), *range(300, 361), 999]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.component for x in graph.components(links, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert got == union_find(pairs, nodes)


def test_graph_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.reach(e, spark.createDataFrame([(6,)], "node long"), 3).collect()} == {(6, 0), (1, 1), (2, 2), (3, 3)}
    assert sorted(r.path for r in graph.cycles(e, 4).collect()) == [[1, 2, 3], [4, 5]]
    assert {r.node: r.layer for r in graph.layers(e.where("dst <> 1 AND src < 5")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert {r.node: r.layer for r in graph.layers(e).collect()} == {6: 0, 1: None, 2: None, 3: None, 4: None, 5: None}


def test_mutations(spark):
    a, b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1)], "k string, n int, t int"), spark.createDataFrame([("x", 5, 2), ("z", 7, 1), ("z", 7, 1)], "k string, n int, t int")
    assert {(r.k, r.n) for r in mutations.upsert_counters(a, b, ["k"], ["n"]).collect()} == {("x", 6), ("y", 2), ("z", 14)}
    assert {(r.k, r.n) for r in mutations.upsert_latest(a, b, ["k"], [F.desc("t")]).collect()} == {("x", 5), ("y", 2), ("z", 7)}
    assert sorted((r.k, r.n) for r in mutations.insert_or_ignore(a, b, ["k"]).collect()) == [("x", 1), ("y", 2), ("z", 7)]
    rows = spark.createDataFrame([("g", i, 10) for i in range(5)], "g string, i int, size int")
    assert sorted(r.i for r in mutations.keep_newest(rows, ["g"], [F.desc("i")], 2).collect()) == [3, 4]
    assert sorted(r.i for r in mutations.keep_within_budget(rows, ["g"], [F.asc("i")], "size", 35).collect()) == [0, 1, 2]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "a lease of a broker"), (2, "Broker BROKER"), (3, None), (4, ""), (5, "other")], "id long, t string")
    hits = retrieval.bm25(docs, "id", "t", ["broker", "lease"], 10).collect()
    assert [r.id for r in hits] == [1, 2] and hits[0].score > hits[1].score
    lists = {"a": (spark.createDataFrame([("p", 1), ("q", 2)], "i string, rank int"), 1.0), "b": (spark.createDataFrame([("q", 1)], "i string, rank int"), 1.0)}
    assert [(r.i, r.score, r.sources) for r in retrieval.fuse(lists, "i", 5).collect()] == [("q", round(1 / 62 + 1 / 61, 8), 2), ("p", round(1 / 61, 8), 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<float>")
    assert [(r.id, r.score) for r in retrieval.nearest(v, "id", "v", [1, 0], 5).collect()] == [(1, 1.0), (3, 0.707107)]


def test_metrics(spark):
    hits = spark.createDataFrame([("c", 1, 0), ("c", 2, 1), ("c", 3, 1), ("n", 1, 0)], "c string, r int, rel int")
    got = {r.c: (r.precision2, r.rr, r.ndcg2) for r in quality.ranking_metrics(hits, "c", "r", F.col("rel"), 2).collect()}
    assert got == {"c": (0.5, 0.5, round((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156), 6)), "n": (0.0, 0.0, 0.0)}


def test_simhash_classes_equal_to_brute_force(spark):
    r = random.Random(1)
    marks = [r.getrandbits(63) for _ in range(30)]
    marks += [m ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for m in marks[:20]] + marks[:3]
    rows = list(enumerate(marks))
    pairs = [(a, b) for a, m in rows for b, n in rows if a < b and bin(m ^ n).count("1") <= 3]
    got = {x.id: x.class_id for x in curation.simhash_classes(spark.createDataFrame(rows, "id long, m long"), "id", "m", 3).collect()}
    assert got == union_find(pairs, range(len(rows)))
