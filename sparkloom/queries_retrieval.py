"""Lexical and vector retrieval over documents, evidence, memory records and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as T
from sparkloom.operators import stats
from sparkloom.plans.registry import Registry
from sparkloom.sources.tables import table

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
QUERY = ("snapshot", "verified", "archive", "retries")
LEXICAL, OTHER = ("broker", "lease"), ("digest", "recent")


def _bm25_sql(query, k, name="score"):
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS t{i}" for i, q in enumerate(query))
    df = ", ".join(f"count(CASE WHEN t{i} > 0 THEN 1 END) AS f{i}" for i in range(len(query)))
    score = " + ".join(f"ln(1 + (d - f{i} + 0.5) / (f{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * n / av))" for i in range(len(query)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(query)))
    return f"""SELECT doc_id, round({score}, 6) AS {name} FROM (SELECT doc_id, len(w) AS n, {tf} FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)) tf,
(SELECT count(*) AS d, avg(n) AS av, {df} FROM (SELECT len(w) AS n, {tf} FROM (SELECT {WORDS} AS w FROM documents WHERE text IS NOT NULL))) s WHERE {hit} ORDER BY 2 DESC, 1 LIMIT {k}"""


R = Registry(a=_bm25_sql(LEXICAL, 60), b=_bm25_sql(OTHER, 60))


def _bm25(spark: SparkSession, base: str, query, k: int) -> DataFrame:
    return T.bm25(table(spark, base, "documents"), "doc_id", "text", query, k)


@R.add(_bm25_sql(QUERY, 50))
def r01_bm25(spark, base):
    return _bm25(spark, base, QUERY, 50)


@R.add(f"SELECT doc_id, round(1 / (1 + score), 6) AS relevance FROM ({_bm25_sql(QUERY, 50)})")
def r02_score_squash(spark, base):
    return _bm25(spark, base, QUERY, 50).select("doc_id", F.round(1 / (1 + F.col("score")), 6).alias("relevance"))


@R.add(f"""SELECT doc_id, round(len(list_intersect(list_distinct(w), {list(QUERY)})) / 4.0, 4) AS overlap FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)
WHERE len(list_intersect(list_distinct(w), {list(QUERY)})) > 0 ORDER BY 2 DESC, 1 LIMIT 100""")
def r03_token_overlap(spark, base):
    """The share of the query's terms that a document holds."""
    want = F.array(*map(F.lit, QUERY))
    d = table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.array_intersect(T.terms(F.col("text")), want)).alias("n"))
    return d.where("n > 0").select("doc_id", F.round(F.col("n") / len(QUERY), 4).alias("overlap")).orderBy(F.desc("overlap"), "doc_id").limit(100)


COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 0)"


def _nearest_sql(k, where="true"):
    return f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 AND {where} ORDER BY 2 DESC, 1 LIMIT {k}"


def _probe(spark, base):
    return table(spark, base, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@R.add(_nearest_sql(20))
def r04_nearest(spark, base):
    return T.nearest(table(spark, base, "embeddings").where("vec_id <> 0"), "vec_id", "embedding", _probe(spark, base), 20)


@R.add(f"SELECT vec_id, score FROM ({_nearest_sql(1)}) WHERE score >= 0.05")
def r05_best_above(spark, base):
    """The best match, if it is good enough."""
    return T.nearest(table(spark, base, "embeddings").where("vec_id <> 0"), "vec_id", "embedding", _probe(spark, base), 1).where("score >= 0.05")


@R.add(
    """WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a), s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b),
u AS (SELECT doc_id, 1.0 / (60 + rank) AS s, 'a' AS src FROM l UNION ALL SELECT doc_id, 1.0 / (60 + rank), 'b' FROM s)
SELECT doc_id, round(sum(s), 8) AS score, count(DISTINCT src) AS sources FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""",
    "a",
    "b",
)
def r07_rank_fusion(spark, base):
    """Two ranked lists fused by reciprocal ranks."""
    a, b = (T.ranked(_bm25(spark, base, q, 60), "doc_id", [F.desc("score"), F.col("doc_id")]) for q in (LEXICAL, OTHER))
    return T.fuse({"a": (a, 1.0), "b": (b, 1.0)}, "doc_id", 40)


_ROW_RANKS = """WITH l AS (SELECT source, min(r) AS rank FROM (SELECT d.source, row_number() OVER (ORDER BY a.score DESC, a.doc_id) AS r FROM a JOIN documents d USING (doc_id)) GROUP BY 1),
s AS (SELECT source, min(r) AS rank FROM (SELECT d.source, row_number() OVER (ORDER BY b.score DESC, b.doc_id) AS r FROM b JOIN documents d USING (doc_id)) GROUP BY 1),
u AS (SELECT source, {wa} / (60 + rank) AS s, 'a' AS src FROM l UNION ALL SELECT source, {wb} / (60 + rank), 'b' FROM s)
SELECT source, round(sum(s){bonus}, 8) AS score, count(DISTINCT src) AS sources FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"""


def _sources_ranked(spark, base, query, distinct):
    hits = _bm25(spark, base, query, 60).join(table(spark, base, "documents").select("doc_id", "source"), "doc_id")
    return T.ranked(hits, "source", [F.desc("score"), F.col("doc_id")], distinct)


@R.add(_ROW_RANKS.format(wa="1.0", wb="1.0", bonus=""), "a", "b")
def r08_row_rank_fusion(spark, base):
    """As r07 over the sources of the hits, where repeated sources use up ranks."""
    return T.fuse({n: (_sources_ranked(spark, base, q, False), 1.0) for n, q in (("a", LEXICAL), ("b", OTHER))}, "source", 40)


@R.add(_ROW_RANKS.format(wa="1.2", wb="0.9", bonus=" + least(0.06, 0.018 * (count(DISTINCT src) - 1))"), "a", "b")
def r09_weighted_fusion(spark, base):
    """Weighted lists and a bonus for agreement."""
    lists = {"a": (_sources_ranked(spark, base, LEXICAL, False), 1.2), "b": (_sources_ranked(spark, base, OTHER, False), 0.9)}
    return T.fuse(lists, "source", 40, bonus=0.018, most=0.06)


@R.add("SELECT root, path, file_hash, max(hits) AS hits, count(*) AS n FROM evidence GROUP BY 1, 2, 3")
def r10_identity_dedup(spark, base):
    """Copies of one chunk merged, with the largest hit count."""
    return table(spark, base, "evidence").groupBy("root", "path", "file_hash").agg(F.max("hits").alias("hits"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY hits DESC, id) AS r FROM (SELECT DISTINCT path, id, hits FROM evidence)) WHERE r = 1")
def r11_first_per_path(spark, base):
    e = table(spark, base, "evidence").select("path", "id", "hits").distinct()
    return stats.latest(e, ["path"], [F.desc("hits"), F.col("id")]).select("path", "id")


@R.add("""SELECT id, CAST((length(text) - length(replace(text, 'limit', ''))) // 5 AS BIGINT) AS n FROM (SELECT DISTINCT id, text FROM evidence) WHERE contains(text, 'limit') ORDER BY 2 DESC, 1 LIMIT 50""")
def r16_literal_search(spark, base):
    """Rows that hold a literal term, with the number of places."""
    e = table(spark, base, "evidence").select("id", "text").distinct().where(F.col("text").contains("limit"))
    n = ((F.length("text") - F.length(F.replace("text", F.lit("limit"), F.lit("")))) / 5).cast("long")
    return e.select("id", n.alias("n")).orderBy(F.desc("n"), "id").limit(50)


@R.add("SELECT path, id, hits FROM (SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY hits DESC, id) AS r FROM (SELECT DISTINCT path, id, hits FROM evidence)) WHERE r <= 8")
def w13_per_folder_limit(spark, base):
    """At most eight rows of each top folder."""
    e = table(spark, base, "evidence").select("path", "id", "hits").distinct().withColumn("f", F.split_part("path", F.lit("/"), F.lit(1)))
    return stats.top_per_group(e, ["f"], [F.desc("hits"), F.col("id")], 8).select("path", "id", "hits")


@R.add("SELECT path, id, n - 3 AS omitted FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY hits DESC, id) AS r, count(*) OVER (PARTITION BY path) AS n FROM (SELECT DISTINCT path, id, hits FROM evidence)) WHERE r <= 3 AND n > 3")
def w14_matches_per_file(spark, base):
    """The three best rows of each path that has more, with the number left out."""
    e = table(spark, base, "evidence").select("path", "id", "hits").distinct().withColumn("n", F.count(F.lit(1)).over(W.partitionBy("path")))
    return stats.top_per_group(e.where("n > 3"), ["path"], [F.desc("hits"), F.col("id")], 3).select("path", "id", (F.col("n") - 3).alias("omitted"))


@R.add("""WITH e AS (SELECT DISTINCT id, root, path, least(start_line, end_line) AS a, greatest(start_line, end_line) AS z FROM evidence WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY root, path ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY root, path ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM m)
SELECT root, path, min(a) AS start, max(z) AS "end", count(*) AS n FROM g GROUP BY root, path, no""")
def w07_interval_merge(spark, base):
    """Line ranges of a file merged where they overlap or touch."""
    return stats.islands(table(spark, base, "evidence").select("id", "root", "path", "start_line", "end_line").distinct(), ["root", "path"], "start_line", "end_line", 1)


@R.add("SELECT path, CAST(sum(hits) AS BIGINT) AS uses, max(epoch_us(accessed_at)) AS last_us FROM (SELECT DISTINCT * FROM evidence) GROUP BY 1 ORDER BY last_us DESC, uses DESC, path LIMIT 100")
def a33_hot_paths(spark, base):
    e = table(spark, base, "evidence").select("id", "path", "hits", "accessed_at").dropDuplicates(["id"])
    return e.groupBy("path").agg(F.sum("hits").alias("uses"), F.max(F.unix_micros("accessed_at")).alias("last_us")).orderBy(F.desc("last_us"), F.desc("uses"), "path").limit(100)


@R.add("SELECT count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, min(epoch_us(created_at)) AS first_us, max(epoch_us(accessed_at)) AS last_us FROM (SELECT DISTINCT * FROM evidence)")
def a36_cache_stats(spark, base):
    e = table(spark, base, "evidence").dropDuplicates(["id"])
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.min(F.unix_micros("created_at")).alias("first_us"), F.max(F.unix_micros("accessed_at")).alias("last_us"))


@R.add("""SELECT CASE WHEN path LIKE '%.md' THEN 1 WHEN path LIKE 'archive/%' THEN 2 ELSE 0 END AS tier, path, max(hits) AS hits FROM evidence GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2 LIMIT 200""")
def l13_source_first(spark, base):
    """Sources before documents before old paths, each by hits."""
    p = F.col("path")
    tier = F.when(p.endswith(".md"), 1).when(p.startswith("archive/"), 2).otherwise(0)
    return table(spark, base, "evidence").groupBy(tier.alias("tier"), "path").agg(F.max("hits").alias("hits")).orderBy("tier", F.desc("hits"), "path").limit(200)


@R.add("""SELECT path, CAST(sum(w) AS BIGINT) AS score FROM (SELECT path, 4 AS w FROM evidence WHERE contains(text, 'class ') UNION ALL SELECT path, 2 FROM evidence WHERE contains(text, 'import ') UNION ALL SELECT path, 1 FROM evidence WHERE contains(text, 'return ')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 64""")
def l14_related_paths(spark, base):
    """Paths by the weighted number of facts in their texts."""
    e = table(spark, base, "evidence")
    weight = sum((F.when(F.col("text").contains(w), n).otherwise(0) for w, n in (("class ", 4), ("import ", 2), ("return ", 1))), F.lit(0))
    return e.groupBy("path").agg(F.sum(weight).cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(64)


@R.add("SELECT vec_id, score FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE score END AS score FROM (" + _nearest_sql(60) + ")) ORDER BY score DESC NULLS LAST, vec_id LIMIT 40")
def l12_valid_first(spark, base):
    """Rows without a score come last."""
    n = T.nearest(table(spark, base, "embeddings").where("vec_id <> 0"), "vec_id", "embedding", _probe(spark, base), 60)
    return n.select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("score")).alias("score")).orderBy(F.desc_nulls_last("score"), "vec_id").limit(40)


def _expected_sql():
    return f"""WITH rel AS (SELECT doc_id FROM documents WHERE doc_kind = 'code'), got AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM a)
SELECT (SELECT count(*) FROM got JOIN rel USING (doc_id)) AS hits, (SELECT count(*) FROM got) AS retrieved, (SELECT count(*) FROM rel) AS relevant"""


@R.add(_expected_sql(), "a")
def u05_expected_vs_retrieved(spark, base):
    rel = table(spark, base, "documents").where("doc_kind = 'code'").select("doc_id", F.lit(1).alias("rel"))
    got = _bm25(spark, base, LEXICAL, 60).select("doc_id", F.lit(1).alias("got"))
    both = rel.join(got, "doc_id", "full")
    c = lambda e: F.count(F.when(e, 1))
    return both.agg(c(F.col("rel").isNotNull() & F.col("got").isNotNull()).alias("hits"), c(F.col("got").isNotNull()).alias("retrieved"), c(F.col("rel").isNotNull()).alias("relevant"))


_METRICS = """WITH j AS (SELECT d.lang AS case_id, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY a.score DESC, a.doc_id) AS r, CASE WHEN d.doc_kind = 'note' THEN 1 ELSE 0 END AS rel FROM a JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL)
SELECT case_id, round(sum(CASE WHEN r <= 10 THEN rel END) * 1.0 / 10, 6) AS precision10, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN r END), 0), 6) AS rr,
round(coalesce(sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) END) / nullif(list_sum(list_transform(range(1, CAST(least(10, sum(rel)) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 0), 6) AS ndcg10 FROM j GROUP BY 1"""


@R.add(_METRICS, "a")
def v02_ranking_metrics(spark, base):
    """Precision at 10, reciprocal rank and NDCG at 10 of each case's ranked hits."""
    from sparkloom.operators import quality

    d = table(spark, base, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("case_id"), (F.col("doc_kind") == "note").cast("int").alias("rel"))
    hits = _bm25(spark, base, LEXICAL, 60).join(d, "doc_id")
    r = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "doc_id"))
    return quality.ranking_metrics(hits.withColumn("r", r), "case_id", "r", F.coalesce("rel", F.lit(0)), 10)


QUERIES, ORACLE = R.queries, R.sql
