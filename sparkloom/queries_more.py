"""Further scalar functions, pages, metrics, retrieval scores and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import graph, retrieval, stats
from sparkloom.plans.registry import Registry
from sparkloom.queries_retrieval import COSINE, LEXICAL, _bm25, _bm25_sql, _probe
from sparkloom.sources import files
from sparkloom.sources.tables import table

R = Registry(a=_bm25_sql(LEXICAL, 60), d="SELECT doc_id, text, path, source, lang, doc_kind FROM documents WHERE text IS NOT NULL", ev="SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events")


def docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text IS NOT NULL")


def events(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"), "value")


@R.add("SELECT doc_id, CASE WHEN regexp_matches(path, '^[\\w.-]+(/[\\w.-]+)+$') THEN 'lexical' ELSE 'hybrid' END AS mode FROM d", "d")
def x05_search_mode(spark, base):
    return docs(spark, base).select("doc_id", F.when(F.col("path").rlike(r"^[\w.-]+(/[\w.-]+)+$"), "lexical").otherwise("hybrid").alias("mode"))


@R.add("SELECT doc_id FROM d WHERE regexp_matches(lower(text), 'def |class |import ') AND NOT regexp_matches(lower(text), 'changelog|## ')", "d")
def x07_source_intent(spark, base):
    t = F.lower("text")
    return docs(spark, base).where(t.rlike("def |class |import ") & ~t.rlike("changelog|## ")).select("doc_id")


@R.add("SELECT event_id, us // 86400000000 AS day, (us // 86400000000) * 86400000000 AS day_us, (us // 86400000000 + 1) * 86400000000 AS next_us FROM ev", "ev")
def m01_m02_days(spark, base):
    """The day of an event and its bounds, in UTC."""
    d = F.expr("us div 86400000000")
    return events(spark, base).select("event_id", d.alias("day"), (d * 86_400_000_000).alias("day_us"), ((d + 1) * 86_400_000_000).alias("next_us"))


@R.add("SELECT doc_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 8) AS rr FROM a", "a")
def m05_reciprocal_rank(spark, base):
    ranked = retrieval.ranked(_bm25(spark, base, LEXICAL, 60), "doc_id", [F.desc("score"), F.col("doc_id")])
    return ranked.select("doc_id", F.round(1 / (60 + F.col("rank")), 8).alias("rr"))


@R.add(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def m07_cosine(spark, base):
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, base)])
    return table(spark, base, "embeddings").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("score"))


@R.add("SELECT event_id, CAST(epoch_us(TRY_CAST(strftime(make_timestamp(us), '%Y-%m-%d') AS TIMESTAMP)) AS BIGINT) AS lower_us FROM ev", "ev")
def m10_parsed_bounds(spark, base):
    """A day written as text, parsed to its first microsecond."""
    day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    return events(spark, base).select("event_id", F.unix_micros(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).alias("lower_us"))


@R.add(r"""SELECT event_id, json_extract_string(regexp_extract('note: ' || props || ' end', '\{[^{}]*\}'), '$.k') AS k FROM events""")
def y10_lenient_json(spark, base):
    """The first JSON object inside a text."""
    t = F.concat(F.lit("note: "), "props", F.lit(" end"))
    return table(spark, base, "events").select("event_id", F.get_json_object(F.regexp_extract(t, r"\{[^{}]*\}", 0), "$.k").alias("k"))


@R.add("SELECT doc_id, regexp_replace(regexp_replace(path, '[0-9]{2,}', '#', 'g'), '[^a-zA-Z#/]', '_', 'g') AS label FROM d", "d")
def p15_safe_labels(spark, base):
    return docs(spark, base).select("doc_id", F.regexp_replace(F.regexp_replace("path", "[0-9]{2,}", "#"), "[^a-zA-Z#/]", "_").alias("label"))


@R.add("""SELECT doc_id, '{"doc_kind":' || to_json(doc_kind) || ',"lang":' || to_json(lang) || '}' AS payload FROM d WHERE doc_kind IS NOT NULL AND lang IS NOT NULL""", "d")
def p12_payload(spark, base):
    return docs(spark, base).where("doc_kind IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.to_json(F.struct("doc_kind", "lang")).alias("payload"))


@R.add("SELECT event_id, (SELECT count(*) FROM ev WHERE event_type = 'signup') > 25 AS has_more FROM ev WHERE event_type = 'signup' ORDER BY event_id LIMIT 25", "ev")
def l02_has_more(spark, base):
    """A page of 25 and whether there is more, from one row beyond it."""
    page = events(spark, base).where("event_type = 'signup'").orderBy("event_id").limit(26)
    return page.withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy()) > 25).orderBy("event_id").limit(25).select("event_id", "has_more")


@R.add("""SELECT event_id, replace(replace(rtrim(to_base64(encode('[' || event_id || ',"' || event_type || '"]')), '='), '+', '-'), '/', '_') AS cursor FROM ev""", "ev")
def l05_cursors(spark, base):
    """An opaque cursor: base64url of a JSON array."""
    raw = F.concat(F.lit("["), "event_id", F.lit(',"'), "event_type", F.lit('"]'))
    b = F.base64(F.encode(raw, "utf-8"))
    return events(spark, base).select("event_id", F.translate(F.rtrim(F.regexp_replace(b, "=+$", "")), "+/", "-_").alias("cursor"))


@R.add("SELECT event_id FROM ev WHERE event_type = 'error' AND value > 1 ORDER BY event_id LIMIT 20 OFFSET 20", "ev")
def l10_scoped_page(spark, base):
    return events(spark, base).where("event_type = 'error' AND value > 1").orderBy("event_id").offset(20).limit(20).select("event_id")


@R.add(f"SELECT vec_id, label, score FROM (SELECT e.vec_id, e.label, round({COSINE}, 6) AS score, row_number() OVER (PARTITION BY e.label ORDER BY round({COSINE}, 6) DESC, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE r <= 3")
def l11_top_per_label(spark, base):
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, base)])
    s = table(spark, base, "embeddings").select("vec_id", "label", F.round(retrieval.cosine(F.col("embedding"), q), 6).alias("score"))
    return stats.top_per_group(s, ["label"], [F.desc("score"), F.col("vec_id")], 3).select("vec_id", "label", "score")


@R.add("SELECT doc_id, round(CASE WHEN doc_kind = 'code' THEN 1 + 0.3 / (1 + score) ELSE 0.3 / (1 + score) END, 6) AS score FROM a JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 30", "a")
def r06_hybrid_score(spark, base):
    """An exact match (here: of the kind) beats any lexical score, which decides the rest."""
    j = _bm25(spark, base, LEXICAL, 60).join(table(spark, base, "documents").select("doc_id", "doc_kind"), "doc_id")
    f = F.lit(0.3) / (1 + F.col("score"))
    return j.select("doc_id", F.round(F.when(F.col("doc_kind") == "code", 1 + f).otherwise(f), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(30)


@R.add("SELECT coalesce(embedding_space_id, '') AS space, dimension, count(DISTINCT record_id) AS n FROM agent_memory_embeddings GROUP BY 1, 2")
def r14_spaces(spark, base):
    e = table(spark, base, "agent_memory_embeddings")
    return e.groupBy(F.coalesce("embedding_space_id", F.lit("")).alias("space"), "dimension").agg(F.count_distinct("record_id").alias("n"))


@R.add("SELECT artifact_id, i AS chunk, substr(text, CAST(i * 4050 + 1 AS BIGINT), 4500) AS chunk_text FROM (SELECT DISTINCT artifact_id, text FROM artifacts WHERE length(text) > 0), unnest(range(0, greatest(1, (length(text) - 450 + 4049) // 4050))) AS t(i)")
def r15_fixed_chunks(spark, base):
    """Chunks of 4500 characters, 450 of them shared with the one before."""
    a = table(spark, base, "artifacts").where("length(text) > 0").select("artifact_id", "text").distinct()
    n = F.greatest(F.lit(1).cast("long"), F.expr("(length(text) - 450 + 4049) div 4050"))
    return a.select("artifact_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk")).select("artifact_id", "chunk", F.expr("substring(text, int(chunk * 4050 + 1), 4500)").alias("chunk_text"))


@R.add("SELECT user_id, list(event_id ORDER BY us, event_id) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM ev) WHERE r <= 5 GROUP BY 1", "ev")
def c13_last_turns(spark, base):
    """The last five turns of each conversation, in order."""
    e = stats.top_per_group(events(spark, base), ["user_id"], [F.desc("us"), F.desc("event_id")], 5)
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id"))), lambda x: x["event_id"]).alias("turns"))


@R.add("SELECT DISTINCT id FROM telemetry_events")
def t14_distinct_calls(spark, base):
    return table(spark, base, "telemetry_events").select("id").distinct()


@R.add("""WITH j AS (SELECT d.lang AS case_id, row_number() OVER (PARTITION BY d.lang ORDER BY a.score DESC, a.doc_id) AS r, CASE WHEN d.doc_kind = 'note' THEN 1 ELSE 0 END AS rel FROM a JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL)
SELECT case_id, round(sum(CASE WHEN r <= 5 THEN rel END) / sum(rel), 6) AS recall5 FROM j GROUP BY 1 HAVING sum(rel) > 0""", "a")
def v01_recall(spark, base):
    """The share of a case's relevant hits that stand among its first five."""
    d = table(spark, base, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("case_id"), F.coalesce((F.col("doc_kind") == "note").cast("int"), F.lit(0)).alias("rel"))
    j = _bm25(spark, base, LEXICAL, 60).join(d, "doc_id").withColumn("r", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "doc_id")))
    g = j.groupBy("case_id").agg(F.sum(F.when(F.col("r") <= 5, F.col("rel"))).alias("got"), F.sum("rel").alias("all")).where("`all` > 0")
    return g.select("case_id", F.round(F.col("got") / F.col("all"), 6).alias("recall5"))


@R.add("SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def v03_percentile_disc(spark, base):
    """The value at rank ceil(0.9 n)."""
    return table(spark, base, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@R.add("SELECT c.repository_scope, round(avg(CASE WHEN a.group_id = c.group_id THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM (SELECT DISTINCT candidate_id, group_id FROM laya_dataset_assignments WHERE split_name = 'test') a JOIN (SELECT DISTINCT candidate_id, group_id, repository_scope FROM laya_candidates) c USING (candidate_id) GROUP BY 1")
def v07_accuracy_per_category(spark, base):
    """How often a prediction (the assigned group) is the stored label, for each category."""
    a = table(spark, base, "laya_dataset_assignments").where("split_name = 'test'").select("candidate_id", F.col("group_id").alias("said")).distinct()
    c = table(spark, base, "laya_candidates").select("candidate_id", "group_id", "repository_scope").distinct()
    return a.join(c, "candidate_id").groupBy("repository_scope").agg(F.round(F.avg(F.when(F.col("said") == F.col("group_id"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT metric, value, value < 0.97 AS fails FROM (SELECT 'success' AS metric, round(avg(CAST(success AS DOUBLE)), 6) AS value FROM (SELECT DISTINCT id, success FROM telemetry_events) UNION ALL SELECT 'cache', round(avg(CAST(cache_hit AS DOUBLE)), 6) FROM (SELECT DISTINCT id, cache_hit FROM telemetry_events))")
def v08_quality_floor(spark, base):
    """Metrics against a floor."""
    t = table(spark, base, "telemetry_events").dropDuplicates(["id"]).agg(F.round(F.avg("success"), 6).alias("success"), F.round(F.avg("cache_hit"), 6).alias("cache"))
    return t.unpivot([], ["success", "cache"], "metric", "value").withColumn("fails", F.col("value") < 0.97)


@R.add("""WITH e AS (SELECT DISTINCT id, path, hits, least(start_line, end_line) AS a, greatest(start_line, end_line) AS z FROM evidence WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY path ORDER BY a, z, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY a, z, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM m)
SELECT path, min(a) AS start, max(z) AS "end", max(hits) AS best FROM g GROUP BY path, no HAVING count(*) > 1""")
def w09_grouped_evidence(spark, base):
    """Touching ranges of a path as one, with the best score among them."""
    e = table(spark, base, "evidence").where("start_line IS NOT NULL AND end_line IS NOT NULL").select("id", "path", "hits", F.least("start_line", "end_line").alias("a"), F.greatest("start_line", "end_line").alias("z")).distinct()
    w = W.partitionBy("path").orderBy("a", "z", "id")
    m = e.withColumn("f", F.when(F.col("a") <= F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    g = m.withColumn("no", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("path", "no").agg(F.min("a").alias("start"), F.max("z").alias("end"), F.max("hits").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("no", "n")


@R.add("SELECT count(*) > 0 AS waits_in_circles FROM (SELECT DISTINCT n_regionkey AS src, (n_nationkey * 3) % 5 AS dst FROM nation WHERE n_nationkey % 2 = 0) a JOIN (SELECT DISTINCT n_regionkey AS src, (n_nationkey * 3) % 5 AS dst FROM nation WHERE n_nationkey % 2 = 0) b ON a.dst = b.src AND b.dst = a.src AND a.src < a.dst")
def g11_wait_circles(spark, base):
    """Whether two owners wait for each other."""
    n = table(spark, base, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("src"), ((F.col("n_nationkey") * 3) % 5).alias("dst"))
    return graph.cycles(n, 2).agg((F.count(F.lit(1)) > 0).alias("waits_in_circles"))


def _vowels(s: pd.Series) -> pd.Series:
    return s.str.count("[aeiou]").astype("int64")


@R.add("SELECT doc_id, CAST(length(lower(path)) - length(regexp_replace(lower(path), '[aeiou]', '', 'g')) AS BIGINT) AS n FROM d WHERE path IS NOT NULL", "d")
def f01_vectorised_function(spark, base):
    """A user's function over whole columns."""
    f = F.pandas_udf(_vowels, "long")
    return docs(spark, base).where("path IS NOT NULL").select("doc_id", f(F.lower("path")).alias("n"))


@R.add("SELECT doc_id, split_part(path, '/', 1) || ':' || length(path) AS tag FROM d WHERE path IS NOT NULL", "d")
def f02_sql_function(spark, base):
    """A user's function in SQL, inlined by the optimizer."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION path_tag(p STRING) RETURNS STRING RETURN concat(split_part(p, '/', 1), ':', length(p))")
    return docs(spark, base).where("path IS NOT NULL").select("doc_id", F.expr("path_tag(path)").alias("tag"))


RELEVANCE = "(CASE WHEN doc_kind = 'note' THEN 1 ELSE 0 END) + 10 * (CASE WHEN contains(lower(text), 'snapshot') THEN 1 ELSE 0 END) + 10 * (CASE WHEN contains(lower(text), 'broker') THEN 1 ELSE 0 END)"


@R.add(f"SELECT doc_id, {RELEVANCE} AS relevance FROM d WHERE {RELEVANCE} > 0 ORDER BY 2 DESC, 1 LIMIT 50", "d")
def f03_scored_filter(spark, base):
    """A score computed once, used in the filter and the order."""
    t = F.lower("text")
    score = F.when(F.col("doc_kind") == "note", 1).otherwise(0) + 10 * F.when(t.contains("snapshot"), 1).otherwise(0) + 10 * F.when(t.contains("broker"), 1).otherwise(0)
    return docs(spark, base).select("doc_id", score.alias("relevance")).where("relevance > 0").orderBy(F.desc("relevance"), "doc_id").limit(50)


@R.add("SELECT doc_id, i AS n, trim(string_split(path, '/')[i]) AS part FROM d, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(i) WHERE path IS NOT NULL", "d")
def f06_table_function(spark, base):
    """A text to many rows."""
    return docs(spark, base).where("path IS NOT NULL").select("doc_id", F.posexplode(F.split("path", "/")).alias("i", "part")).select("doc_id", (F.col("i") + 1).alias("n"), F.trim("part").alias("part"))


@R.add("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def s18_statements(spark, base):
    """The SELECT among the statements of a text, run read-only (its limit is far above the table's filter)."""
    script = "SELECT 1; -- first\nSELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000; SELECT ';'"
    return files.read_only_sql(spark, base, ["supplier"], files.split_statements(script)[1], most=1 << 30)


@R.add()
def s07_inventory(spark, base):
    """The files of a folder with their sizes; contents aren't read."""
    return files.inventory(spark, base, "*.parquet")


@R.add("SELECT split, count(*) AS n FROM (SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT CAST('0x' || substr(sha256(g), 1, 8) AS BIGINT) % 100 AS b FROM (SELECT min(candidate_id) OVER (PARTITION BY task_id) AS g FROM (SELECT DISTINCT candidate_id, task_id FROM laya_candidates WHERE task_id IS NOT NULL)))) GROUP BY 1")
def c04_group_split(spark, base):
    """All candidates of a task in one split, by the digest of the task's smallest candidate."""
    c = table(spark, base, "laya_candidates").where("task_id IS NOT NULL").select("candidate_id", "task_id").distinct()
    root = F.min("candidate_id").over(W.partitionBy("task_id"))
    return c.select(X.split_of(root).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


MEM = "(SELECT DISTINCT record_id, status, kind, scope, scope_id, quarantine_reason FROM agent_memory_records WHERE record_id IS NOT NULL)"


@R.add(f"SELECT record_id, status = 'active' AND coalesce(quarantine_reason, '') = '' AS live FROM {MEM}")
def p08_status_with_reason(spark, base):
    """A status that counts only without a reason against it."""
    m = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL").select("record_id", "status", "kind", "scope", "scope_id", "quarantine_reason").distinct()
    return m.select("record_id", ((F.col("status") == "active") & (F.coalesce("quarantine_reason", F.lit("")) == "")).alias("live"))


@R.add("SELECT a.doc_id, d.source, d.doc_kind, a.score FROM a JOIN documents d USING (doc_id)", "a")
def j06_join_to_ranked(spark, base):
    """A ranked page joined to its rows."""
    return table(spark, base, "documents").select("doc_id", "source", "doc_kind").join(_bm25(spark, base, LEXICAL, 60), "doc_id").select("doc_id", "source", "doc_kind", "score")


@R.add("SELECT artifact_id, 'viewport.' || k AS name, json_extract_string(v, '$.' || k) AS value FROM (SELECT DISTINCT artifact_id, json_extract(identity_json, '$.capture.viewport') AS v FROM artifacts WHERE json_valid(identity_json) AND json_type(identity_json) = 'OBJECT' AND json_type(identity_json, '$.capture.viewport') = 'OBJECT'), unnest(json_keys(v)) AS t(k)")
def y03_flattened_settings(spark, base):
    """The members of a nested object as dotted names with their values."""
    a = table(spark, base, "artifacts").select("artifact_id", F.try_variant_get(F.try_parse_json("identity_json"), "$.capture.viewport", "map<string,string>").alias("m")).where("m IS NOT NULL")
    return a.select("artifact_id", F.explode("m").alias("k", "value")).select("artifact_id", F.concat(F.lit("viewport."), "k").alias("name"), "value").distinct()


@R.add(f"""WITH q AS (SELECT vec_id, embedding, sha256(CAST(label AS VARCHAR) || ':' || (vec_id % 5)) AS h FROM embeddings), probe AS (SELECT * FROM q WHERE vec_id = 7),
x AS (SELECT min(q.vec_id) AS vec_id FROM q, probe WHERE q.h = probe.h AND q.vec_id <> 7), n AS (SELECT e.vec_id, round({COSINE}, 6) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT CASE WHEN (SELECT vec_id FROM x) IS NOT NULL THEN 'exact' ELSE 'near' END AS how, coalesce((SELECT vec_id FROM x), (SELECT vec_id FROM n WHERE s >= 0.1)) AS vec_id""")
def r18_cache_lookup(spark, base):
    """The stored entry with the same digest, else the nearest one above a threshold."""
    e = table(spark, base, "embeddings").withColumn("h", F.sha2(F.concat_ws(":", "label", (F.col("vec_id") % 5)), 256))
    probe = e.where("vec_id = 7").select("embedding", "h").first()
    exact = e.where((F.col("h") == probe.h) & (F.col("vec_id") != 7)).agg(F.min("vec_id").alias("x"))
    near = retrieval.nearest(e.where("vec_id <> 7"), "vec_id", "embedding", probe.embedding, 1).where("score >= 0.1").agg(F.min("vec_id").alias("n"))
    both = exact.crossJoin(F.broadcast(near))  # a row each
    return both.select(F.when(F.col("x").isNotNull(), "exact").otherwise("near").alias("how"), F.coalesce("x", "n").alias("vec_id"))


@R.add("SELECT coalesce(a.column_name, b.column_name) AS name, CASE WHEN b.column_name IS NULL THEN 'missing' WHEN a.column_name IS NULL THEN 'extra' ELSE 'same' END AS state FROM (SELECT unnest(['s_suppkey', 's_name', 's_phone']) AS column_name) a FULL JOIN (SELECT unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS column_name) b USING (column_name)")
def k10_schema_drift(spark, base):
    """Wanted columns against those a table has."""
    wanted = spark.createDataFrame([("s_suppkey",), ("s_name",), ("s_phone",)], "name string").withColumn("w", F.lit(True))
    there = spark.createDataFrame([(c,) for c in table(spark, base, "supplier").columns], "name string").withColumn("t", F.lit(True))
    state = F.when(F.col("t").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("same")
    return wanted.join(there, "name", "full").select("name", state.alias("state"))


@R.add("SELECT doc_id, contains(text, 'snapshot') AS has_fact, contains(text, 'TODO') AS has_forbidden, CASE WHEN contains(text, 'snapshot') AND NOT contains(text, 'TODO') THEN 1.0 ELSE 0.0 END AS score FROM d", "d")
def v06_prediction_score(spark, base):
    """Texts scored by a fact they must hold and a claim they mustn't."""
    fact, bad = F.col("text").contains("snapshot"), F.col("text").contains("TODO")
    return docs(spark, base).select("doc_id", fact.alias("has_fact"), bad.alias("has_forbidden"), F.when(fact & ~bad, 1.0).otherwise(0.0).alias("score"))


@R.add("SELECT root, path, id FROM (SELECT root, path, id, row_number() OVER (PARTITION BY root, path ORDER BY accessed_at DESC, id) AS r FROM (SELECT DISTINCT root, path, id, accessed_at FROM evidence)) WHERE r <= 2")
def d07_scoped_eviction(spark, base):
    """The two last used rows of each scoped key stay."""
    e = table(spark, base, "evidence").select("root", "path", "id", "accessed_at").distinct()
    return stats.top_per_group(e, ["root", "path"], [F.desc("accessed_at"), F.col("id")], 2).select("root", "path", "id")


@R.add("SELECT event_id, greatest(1, least(200, user_id * 10)) AS page_limit, greatest(0, least(2048 - greatest(1, least(200, user_id * 10)), event_id)) AS page_offset FROM ev", "ev")
def l08_page_clamps(spark, base):
    """Limits held to 1 to 200, and limit + offset to 2048."""
    limit = F.greatest(F.lit(1), F.least(F.lit(200), F.col("user_id") * 10))
    return events(spark, base).select("event_id", limit.alias("page_limit"), F.greatest(F.lit(0), F.least(F.lit(2048) - limit, F.col("event_id"))).alias("page_offset"))


@R.add()
def k05_api_routes(spark, base):
    """Decorated routes in Python texts."""
    from sparkloom.functions import code

    e = table(spark, base, "evidence").where("path LIKE '%.py'").select("id", "text").dropDuplicates(["id"])
    return code.table_function(e, "id", "text", "method string, route string", code.routes)


@R.add()
def k08_diff_lines(spark, base):
    """Changed lines of the unified diffs among the artifacts."""
    from sparkloom.functions import code

    a = table(spark, base, "artifacts").select("artifact_id", "text").dropDuplicates(["artifact_id"])
    return code.table_function(a, "artifact_id", "text", "path string, hunk long, sign string, line long, content string", code.diff_lines)


QUERIES, ORACLE = R.queries, R.sql
