"""The registered queries of this subpackage, and the SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chunking, credentials, leakage, overlaps, percentiles, similar, tokenizer, truncation
from sparkloom.sources.tables import table


# --- 1: most similar vectors -----------------------------------------------------------------------------------------
#: Neighbours of each record, and the similarity below which a record counts as unlike.
NEIGHBOURS, LIKE = 5, 0.8


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """space, n, id, neighbour, similarity: the five most similar records of each, of similarity 0.8 or more.

    Vectors are held in single precision, so similarities are good to about 1e-7 and reported to 4 decimals.
    """
    return _neighbours(spark, base).withColumn("similarity", F.round("similarity", 4))


def _neighbours(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "agent_memory_embeddings")
    usable = similar.vectors(rows, "record_id", "embedding", "embedding_space_id", "dimension", "created_at")
    return similar.most_similar(usable, NEIGHBOURS, LIKE)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    near = _neighbours(spark, base)
    return near.select(F.least("id", "neighbour").alias("record_id_a"), F.greatest("id", "neighbour").alias("record_id_b")).distinct()


# --- 2: overlaps across splits ---------------------------------------------------------------------------------------
def _overlaps(spark: SparkSession, base: str) -> DataFrame:
    return overlaps.overlaps(table(spark, base, "laya_candidates"), table(spark, base, "laya_dataset_assignments"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _overlaps(spark, base).select("snapshot_id", F.least("eval_id", "train_id").alias("candidate_id_a"), F.greatest("eval_id", "train_id").alias("candidate_id_b")).distinct()


def p2_counts(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping pairs and evaluation candidates for each split and repository scope."""
    met = _overlaps(spark, base).groupBy("split_name", F.col("scope").alias("repository_scope"), "snapshot_id", "eval_id").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("split_name", "repository_scope").agg(F.sum("n").alias("n_pairs"), F.count_distinct("eval_id").alias("n_candidates"))


# --- 3: credentials --------------------------------------------------------------------------------------------------
#: The tables with texts that may hold credentials, with key and text.
TEXTS = {"evidence": ("id", "text"), "agent_memory_records": ("record_id", "value")}


def p3_places(spark: SparkSession, base: str) -> DataFrame:
    """Every find with its kind, the layers of encoding around it, and its place in characters."""
    parts = [credentials.find_credentials(table(spark, base, t), k, c).withColumn("source_table", F.lit(t)) for t, (k, c) in TEXTS.items()]
    return parts[0].unionByName(parts[1]).distinct()


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p3_places(spark, base).select("source_table", "row_key", "line_no").distinct()


def p3_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every row's text once more, with only its credentials replaced."""
    parts = [credentials.redacted(table(spark, base, t), k, c).withColumn("source_table", F.lit(t)) for t, (k, c) in TEXTS.items()]
    return parts[0].unionByName(parts[1])


# --- 6: pieces of oversized texts -----------------------------------------------------------------------------------
def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    return chunking.split_oversized(table(spark, base, "artifacts"), "artifact_id", "text", table(spark, base, "artifact_paging_metadata"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pieces(spark, base).where(F.col("piece_no") == 0).select("artifact_id")


# --- 7: percentiles --------------------------------------------------------------------------------------------------
def measured(spark: SparkSession, base: str, *also: str) -> DataFrame:
    """activity and model in their plain form and duration_ms of every measured step, each id once; ``also`` may name day."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c)
    rows = table(spark, base, "telemetry_events").select("id", plain("activity"), plain("model"), "duration_ms", *[F.date_format("created_at", "yyyy-MM-dd").alias(c) for c in also])
    d = F.col("duration_ms")
    return rows.where(d.isNotNull() & ~F.isnan(d) & (d > 0)).dropDuplicates(["id"])


GROUPS = ["activity", "model"]
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return percentiles.groups_above(measured(spark, base), GROUPS, "duration_ms", 0.95, 2500.0)


def p7_sketch(spark: SparkSession, base: str) -> DataFrame:
    return percentiles.sketch(measured(spark, base), GROUPS, "duration_ms")


def p7_daily(spark: SparkSession, base: str) -> DataFrame:
    """The sketch of each day; all repeats of a row lie on one day, so days computed apart can be combined."""
    return percentiles.sketch(measured(spark, base, "day"), ["day", *GROUPS], "duration_ms")


def p7_merged(spark: SparkSession, base: str) -> DataFrame:
    """The days' sketches combined: the sketch of the whole table."""
    return percentiles.merge(p7_daily(spark, base), GROUPS)


def p7_within(spark: SparkSession, base: str) -> DataFrame:
    """Whether the estimates of each group lie within the stated error of the exact percentiles."""
    rows = measured(spark, base)
    exact = rows.groupBy(*GROUPS).agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY duration_ms)").alias(f"e{n}") for n, s in SHARES.items()])
    est = percentiles.estimates(percentiles.sketch(rows, GROUPS, "duration_ms"), GROUPS, SHARES)
    near = [F.abs(F.col(n) - F.col(f"e{n}")) <= (percentiles.RELATIVE_ERROR + 1e-9) * F.col(f"e{n}") for n in SHARES]
    return est.join(exact, GROUPS).select(*GROUPS, (near[0] & near[1] & near[2] & near[3]).alias("within"))


def p7_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return percentiles.estimates(p7_sketch(spark, base), GROUPS, SHARES).select(*GROUPS, "n", *[F.round(c, 6).alias(c) for c in SHARES])


MEASURED_SQL = """measured AS (
  SELECT id, lower(trim(coalesce(activity, ''))) AS activity, lower(trim(coalesce(model, ''))) AS model,
         any_value(duration_ms) AS duration_ms
  FROM telemetry_events WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) AND duration_ms > 0
  GROUP BY 1, 2, 3)"""
GAMMA_SQL = "(1.01 / 0.99)"
SKETCH_SQL = f"""sketch AS (
  SELECT activity, model, CAST(sign(duration_ms) AS INTEGER) AS sign,
         CAST(ceil(ln(abs(duration_ms)) / ln{GAMMA_SQL}) AS INTEGER) AS bucket, count(*) AS n
  FROM measured GROUP BY 1, 2, 3, 4)"""
P7 = {
    "p7_found": f"""WITH {MEASURED_SQL}, ranked AS (
  SELECT activity, model, duration_ms, row_number() OVER (PARTITION BY activity, model ORDER BY duration_ms) AS r,
         count(*) OVER (PARTITION BY activity, model) AS n FROM measured)
SELECT activity, model FROM ranked WHERE r = CAST(ceil(n * 95 / 100.0) AS BIGINT) AND duration_ms > 2500""",
    "p7_sketch": f"WITH {MEASURED_SQL}, {SKETCH_SQL} SELECT activity, model, sign, bucket, n FROM sketch",
    "p7_merged": f"WITH {MEASURED_SQL}, {SKETCH_SQL} SELECT activity, model, sign, bucket, n FROM sketch",
    "p7_daily": f"""WITH measured AS (SELECT DISTINCT id, strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d') AS day, lower(trim(coalesce(activity, ''))) AS activity, lower(trim(coalesce(model, ''))) AS model, duration_ms
  FROM telemetry_events WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) AND duration_ms > 0)
SELECT day, activity, model, CAST(sign(duration_ms) AS INTEGER) AS sign, CAST(ceil(ln(abs(duration_ms)) / ln{GAMMA_SQL}) AS INTEGER) AS bucket, count(*) AS n FROM measured GROUP BY 1, 2, 3, 4, 5""",
    "p7_within": f"WITH {MEASURED_SQL} SELECT activity, model, true AS within FROM measured GROUP BY 1, 2",
    "p7_percentiles": f"""WITH {MEASURED_SQL}, {SKETCH_SQL}, run AS (
  SELECT *, sum(n) OVER (PARTITION BY activity, model ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY activity, model) AS total FROM sketch)
SELECT activity, model, CAST(max(total) AS BIGINT) AS n, """
    + ", ".join(
        f"round(max(CASE WHEN upto - n < ceil(total * {s} / 100.0) AND ceil(total * {s} / 100.0) <= upto THEN 2 * pow({GAMMA_SQL}, bucket) / ({GAMMA_SQL} + 1) END), 6) AS p{s}"
        for s in (50, 90, 95, 99)
    )
    + " FROM run GROUP BY 1, 2",
}


# --- 8: token ids ----------------------------------------------------------------------------------------------------
def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, base, "documents"), "doc_id", "text")


# --- 9: evaluation texts in training texts -----------------------------------------------------------------------------
def _leak_args(spark: SparkSession, base: str) -> tuple:
    return table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_items"), "item_id", "text"


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leakage.find_leaks(*_leak_args(spark, base))


def p9_kept(spark: SparkSession, base: str) -> DataFrame:
    """The documents that share no passage with any evaluation item."""
    return leakage.drop_leaking(*_leak_args(spark, base)).select("doc_id")


def p9_clean(spark: SparkSession, base: str) -> DataFrame:
    return leakage.remove_leaks(*_leak_args(spark, base))


# --- 10: texts that were cut off ---------------------------------------------------------------------------------------
def _truncated(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncated(table(spark, base, "documents"), "doc_id", "text", "doc_kind", "source")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _truncated(spark, base).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, base: str) -> DataFrame:
    """Texts, cut texts and their share for each source."""
    n = F.count(F.lit(1))
    cut = F.count(F.when(F.col("cut"), 1))
    return _truncated(spark, base).groupBy("source").agg(n.alias("n_texts"), cut.alias("n_cut"), F.round(cut / n, 6).alias("share"))


WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
P9 = {
    "p9_found": f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS t(i)),
ew AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM e, unnest(range(1, len(w) - 10)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
P9["p9_kept"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (" + P9["p9_found"] + "))"

_VECTORS = """v AS (SELECT id, space, n, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (
  SELECT *, len(e) AS n, row_number() OVER (PARTITION BY id, space, len(e) ORDER BY created_at DESC) AS r FROM (
    SELECT DISTINCT record_id AS id, coalesce(embedding_space_id, '') AS space, dimension, created_at, TRY_CAST(CASE WHEN json_valid(embedding) THEN embedding END AS DOUBLE[]) AS e
    FROM agent_memory_embeddings WHERE record_id IS NOT NULL AND starts_with(ltrim(embedding), '['))
  WHERE len(e) > 0 AND (coalesce(dimension, 0) = 0 OR dimension = len(e)) AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0) WHERE r = 1),
near AS (SELECT space, n, id, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY space, n, id ORDER BY similarity DESC, neighbour) AS r FROM (
  SELECT a.space, a.n, a.id, b.id AS neighbour, round(list_dot_product(a.u, b.u), 6) AS similarity FROM v a JOIN v b ON a.space = b.space AND a.n = b.n AND a.id <> b.id)) WHERE r <= 5 AND similarity >= 0.8)"""
_STATES = """j AS (SELECT DISTINCT candidate_id, repository_scope, CASE WHEN json_valid(candidate_json) THEN CASE WHEN json_type(candidate_json) = 'VARCHAR' THEN json_extract_string(candidate_json, '$') ELSE candidate_json END END AS o FROM laya_candidates),
s AS (SELECT candidate_id, repository_scope, CASE WHEN json_valid(o) AND json_type(o, '$.state') = 'OBJECT' THEN json_extract(o, '$.state') END AS st FROM j),
t AS (SELECT candidate_id, repository_scope, array_to_string(regexp_extract_all(lower(array_to_string(list_transform(list_sort(json_keys(st)), lambda k: k || ' ' || coalesce(json_extract_string(st, '$."' || k || '"'), '')), ' ')), '[\\p{L}\\p{N}]+'), ' ') AS x FROM s),
g AS (SELECT candidate_id, repository_scope, CASE WHEN length(x) >= 3 THEN list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) END AS w FROM t),
m AS (SELECT DISTINCT a.snapshot_id, a.candidate_id, a.split_name, nullif(trim(a.content_hash), '') AS h, g.w, g.repository_scope FROM laya_dataset_assignments a LEFT JOIN g USING (candidate_id)),
met AS (SELECT e.snapshot_id, e.candidate_id AS eval_id, t.candidate_id AS train_id, e.split_name, e.repository_scope FROM m e JOIN m t ON e.snapshot_id = t.snapshot_id AND e.split_name IN ('calibration', 'test') AND t.split_name = 'train' AND e.candidate_id <> t.candidate_id
  WHERE e.h = t.h OR (len(e.w) >= 0.8 * len(t.w) AND len(t.w) >= 0.8 * len(e.w) AND len(list_intersect(e.w, t.w)) >= 0.8 * (len(e.w) + len(t.w) - len(list_intersect(e.w, t.w)))))"""
P1_P2 = {
    "p1_found": f"WITH {_VECTORS} SELECT DISTINCT least(id, neighbour) AS record_id_a, greatest(id, neighbour) AS record_id_b FROM near",
    "p1_neighbours": f"WITH {_VECTORS} SELECT space, CAST(n AS INTEGER) AS n, id, neighbour, round(similarity, 4) AS similarity FROM near",
    "p2_found": f"WITH {_STATES} SELECT DISTINCT snapshot_id, least(eval_id, train_id) AS candidate_id_a, greatest(eval_id, train_id) AS candidate_id_b FROM met",
    "p2_counts": f"WITH {_STATES} SELECT split_name, repository_scope, CAST(sum(n) AS BIGINT) AS n_pairs, count(DISTINCT eval_id) AS n_candidates FROM (SELECT split_name, repository_scope, snapshot_id, eval_id, count(*) AS n FROM met GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_counts, p3_found, p3_places, p3_redacted, p6_found, p6_pieces, p7_found, p7_sketch, p7_daily, p7_merged, p7_within, p7_percentiles, p8_ids, p9_found, p9_kept, p9_clean, p10_found, p10_sources)}
ORACLE = {"p6_found": "SELECT DISTINCT artifact_id FROM artifacts WHERE length(text) > 4000"} | P1_P2 | P7 | P9
