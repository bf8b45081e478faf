"""Text functions over documents, evidence and records, and corpus curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import curation
from sparkloom.plans.registry import Registry
from sparkloom.sources.tables import table

DOCS = "SELECT doc_id, text, path, source, lang, doc_kind FROM documents WHERE text IS NOT NULL"
R = Registry(d=DOCS)


def docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", "text", "path", "source", "lang", "doc_kind")


def _each(spark, base, name, column, of="text"):
    return docs(spark, base).select("doc_id", column(F.col(of)).alias(name))


@R.add(r"""SELECT doc_id, regexp_replace(trim(regexp_replace(replace(path, '\', '/'), '\s+', ' ', 'g')), '^[\s,;:!?.]+|[\s,;:!?.]+$', '', 'g') AS q FROM d""", "d")
def x01_normalize_query(spark, base):
    return _each(spark, base, "q", X.normalize_query, "path")


@R.add(r"""SELECT doc_id, array_to_string((list_distinct_ordered)[1:24], ' ') AS terms FROM (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered
FROM (SELECT doc_id, list_filter(list_concat(regexp_extract_all(lower(path), '[\p{L}\p{N}_]+'), regexp_extract_all(lower(regexp_replace(path, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[\p{L}\p{N}]+')), lambda x: length(x) >= 2) AS w FROM d))""", "d")
def x02_query_terms(spark, base):
    return docs(spark, base).select("doc_id", F.array_join(X.query_terms(F.col("path")), " ").alias("terms"))


@R.add(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(trim(path), '\s') AND regexp_full_match(trim(path), '[\w.-]+(?:/[\w.-]+)+|[\w-]+\.(?:py|js|ts|md|json|yaml|toml|sh)') THEN 'file_path' ELSE 'natural_language' END AS class FROM d WHERE path LIKE '%/%'""", "d")
def x03_query_class(spark, base):
    return docs(spark, base).where("path LIKE '%/%'").select("doc_id", X.query_class(F.col("path")).alias("class"))


@R.add(r"""SELECT doc_id, a[1] AS anchor FROM (SELECT doc_id, list_distinct(regexp_extract_all(path, '[a-z]+-[0-9]+')) AS a FROM d) WHERE len(a) = 1""", "d")
def x04_single_anchor(spark, base):
    """The anchor of a text that holds exactly one."""
    a = F.array_distinct(F.regexp_extract_all("path", F.lit("[a-z]+-[0-9]+"), F.lit(0)))
    return docs(spark, base).select("doc_id", a.alias("a")).where(F.size("a") == 1).select("doc_id", F.col("a")[0].alias("anchor"))


TIER_SQL = r"CASE WHEN regexp_matches(path, '(?i)(^|/)(archive|old|history|legacy)(/|$)') THEN 2 WHEN regexp_matches(path, '(?i)\.(md|rst|txt)$|(^|/)(docs|notes)/') THEN 1 ELSE 0 END"


@R.add(f"SELECT doc_id, {TIER_SQL} AS tier FROM d", "d")
def x08_path_tier(spark, base):
    return _each(spark, base, "tier", X.path_tier, "path")


@R.add(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(p, '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') THEN array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path FROM (SELECT doc_id, replace('./' || path || '//x', '\', '/') AS p FROM d)""", "d")
def x09_canonical_path(spark, base):
    return docs(spark, base).select("doc_id", X.canonical_path(F.concat(F.lit("./"), "path", F.lit("//x"))).alias("path"))


@R.add(r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(authorization:\s*(?:bearer|basic)\s+)[^\s''"]+', '\1***', 'g'), '(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)[^\s''",;&]+', '\1***', 'g'), '(?i)(--(?:password|token|secret|api-key)[ =])[^\s''"]+', '\1***', 'g') AS text
FROM (SELECT DISTINCT id, text AS t FROM evidence WHERE text IS NOT NULL AND NOT contains(text, '://'))""")
def x10_redact(spark, base):
    e = table(spark, base, "evidence").where("text IS NOT NULL AND NOT contains(text, '://')").select("id", "text").distinct()
    return e.select("id", X.redact(F.col("text")).alias("text"))


@R.add(r"""SELECT doc_id, regexp_replace(text, chr(27) || '\[[0-9;?]*[ -/]*[@-~]', '', 'g') AS text FROM d""", "d")
def x11_strip_ansi(spark, base):
    return _each(spark, base, "text", X.strip_ansi)


@R.add(r"""SELECT doc_id, CAST(greatest(1, list_sum(list_transform(regexp_extract_all(text, '\w+|[^\w\s]'), lambda p: ceil(strlen(p) / 4))), ceil(strlen(text) / CAST(3.4 AS DOUBLE))) AS BIGINT) AS n FROM (SELECT * FROM d WHERE regexp_full_match(text, '[ -~\n]+'))""", "d")
def x12_code_tokens(spark, base):
    """Over plain ASCII texts; word characters are ASCII in both engines there."""
    return docs(spark, base).where(F.col("text").rlike(r"^[ -~\n]+$")).select("doc_id", X.estimate_code_tokens(F.col("text")).alias("n"))


@R.add("SELECT doc_id, CAST(greatest(1, ceil(strlen(text) / CAST(3.4 AS DOUBLE))) AS BIGINT) AS n FROM d", "d")
def x13_token_estimate(spark, base):
    return _each(spark, base, "n", X.estimate_tokens)


@R.add(r"""SELECT doc_id, CASE WHEN n <= 5 THEN text ELSE array_to_string(list_concat(l[1:3], ['... ' || (n - 5) || ' lines ...'], l[n - 1:n]), chr(10)) END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM d)""", "d")
def x15_head_tail(spark, base):
    return docs(spark, base).select("doc_id", X.head_tail(F.col("text"), 3, 2).alias("text"))


@R.add("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN contains(substr(text, 1, 300), chr(10)) THEN substr(text, 1, 300 - instr(reverse(substr(text, 1, 300)), chr(10))) ELSE substr(text, 1, 300) END AS text FROM (SELECT * FROM d WHERE regexp_full_match(text, '[ -~\\n]+'))""", "d")
def x16_cut_at_line(spark, base):
    """Over ASCII texts, as the other engine reverses by visible characters."""
    return docs(spark, base).where(F.col("text").rlike(r"^[ -~\n]+$")).select("doc_id", X.cut_at_line(F.col("text"), 300).alias("text"))


@R.add("""SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE doc_kind = 'log') WHERE contains(line, 'level=error') GROUP BY 1 HAVING count(*) > 1""", "d")
def x17_repeated_diagnostics(spark, base):
    """Error lines that stand more than once, with their number."""
    lines = docs(spark, base).where("doc_kind = 'log'").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("level=error"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


@R.add("""WITH l AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE doc_kind = 'log')
SELECT doc_id, line_no, (CASE WHEN contains(line, 'snapshot') THEN 3.0 ELSE 0 END) + (CASE WHEN contains(line, 'level=error') THEN 2.5 ELSE 0 END) AS score FROM l WHERE contains(line, 'snapshot') OR contains(line, 'level=error')""", "d")
def x18_line_scores(spark, base):
    l = docs(spark, base).where("doc_kind = 'log'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    score = F.when(F.col("line").contains("snapshot"), 3.0).otherwise(0.0) + F.when(F.col("line").contains("level=error"), 2.5).otherwise(0.0)
    return l.select("doc_id", (F.col("i") + 1).alias("line_no"), score.alias("score")).where("score > 0")


@R.add(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM (SELECT * FROM d WHERE regexp_full_match(text, '[ -~\n\t\r]+'))", "d")
def x19_compact(spark, base):
    return docs(spark, base).where(F.col("text").rlike(r"^[ -~\n\t\r]+$")).select("doc_id", X.compact(F.col("text")).alias("text"))


INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{n}'" for n, w in X.INTENTS) + " ELSE 'general' END"


@R.add(f"SELECT doc_id, {INTENT_SQL} AS intent FROM d", "d")
def x20_intent(spark, base):
    return _each(spark, base, "intent", X.intent)


@R.add(r"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda w: NOT list_contains(['the', 'and', 'a', 'of'], w))) AS n FROM d", "d")
def x21_noise_filter(spark, base):
    words = F.array_except(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(*map(F.lit, ("the", "and", "a", "of"))))
    return docs(spark, base).select("doc_id", F.size(words).alias("n"))


@R.add("SELECT doc_id, substr(sha256(lower(doc_kind) || '|' || lower(source)), 1, 16) AS mark FROM d WHERE doc_kind IS NOT NULL AND source IS NOT NULL", "d")
def x22_fingerprint(spark, base):
    return docs(spark, base).where("doc_kind IS NOT NULL AND source IS NOT NULL").select("doc_id", X.fingerprint(F.col("doc_kind"), F.col("source")).alias("mark"))


@R.add("SELECT doc_id, sha256(text) AS digest FROM d", "d")
def x23_content_hash(spark, base):
    return _each(spark, base, "digest", lambda c: F.sha2(c, 256))


@R.add("SELECT id, line_no, kind FROM (SELECT id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT DISTINCT id, text FROM evidence), unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)) l JOIN (VALUES ('todo', 'TODO'), ('print', 'print('), ('sleep', 'sleep'), ('secret', 'password')) p(kind, needle) ON contains(line, needle)")
def x24_line_scan(spark, base):
    """Every line against a table of patterns."""
    needles = {"todo": "TODO", "print": "print(", "sleep": "sleep", "secret": "password"}
    l = table(spark, base, "evidence").select("id", "text").distinct().select("id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = F.filter(F.array(*[F.when(F.col("line").contains(v), k) for k, v in needles.items()]), lambda x: x.isNotNull())
    return l.select("id", (F.col("i") + 1).alias("line_no"), F.explode(hits).alias("kind"))


@R.add("SELECT record_id, round(pow(CAST(0.5 AS DOUBLE), ((1771113600000000 - us) / CAST(86400000000 AS DOUBLE)) / 90), 6) AS weight FROM (SELECT record_id, max(epoch_us(updated_at)) AS us FROM agent_memory_records WHERE record_id IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1)")
def m03_half_life(spark, base):
    m = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL AND updated_at IS NOT NULL").groupBy("record_id").agg(F.max(F.unix_micros("updated_at")).alias("us"))
    return m.select("record_id", F.round(F.pow(F.lit(0.5), (F.lit(1_771_113_600_000_000) - F.col("us")) / 86_400_000_000 / 90), 6).alias("weight"))


@R.add("SELECT path, round(n * log2(1 + lines), 2) AS hotspot, CASE WHEN round(n * log2(1 + lines), 2) >= 50 THEN 'critical' WHEN round(n * log2(1 + lines), 2) >= 20 THEN 'high' ELSE 'low' END AS risk FROM (SELECT path, count(*) AS n, max(end_line) AS lines FROM evidence WHERE end_line >= 0 GROUP BY 1)")
def m04_hotspots(spark, base):
    g = table(spark, base, "evidence").where("end_line >= 0").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("lines"))
    h = F.round(F.col("n") * F.log2(1 + F.col("lines")), 2)
    return g.select("path", h.alias("hotspot"), F.when(h >= 50, "critical").when(h >= 20, "high").otherwise("low").alias("risk"))


@R.add("SELECT doc_id, least(greatest(coalesce(n_chars, 0), 10), 1000) AS n FROM documents")
def m06_clamp(spark, base):
    return table(spark, base, "documents").select("doc_id", F.least(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(10)), F.lit(1000)).alias("n"))


@R.add("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) % 100 AS b FROM documents WHERE source IS NOT NULL)")
def m08_hash_split(spark, base):
    return table(spark, base, "documents").where("source IS NOT NULL").select("doc_id", X.split_of(F.col("source")).alias("split"))


@R.add("SELECT doc_id, CASE WHEN n <= 255 THEN '<=255' WHEN n <= 1023 THEN '<=1023' WHEN n <= 4095 THEN '<=4095' ELSE '>4095' END AS size FROM (SELECT doc_id, strlen(text) AS n FROM d)", "d")
def m09_size_labels(spark, base):
    n = F.octet_length("text")
    return docs(spark, base).select("doc_id", F.when(n <= 255, "<=255").when(n <= 1023, "<=1023").when(n <= 4095, "<=4095").otherwise(">4095").alias("size"))


# --- curation --------------------------------------------------------------------------------------------------------------
@R.add()
def c01_simhash(spark, base):
    return curation.simhashes(docs(spark, base), "doc_id", "text")


@R.add()
def c02_simhash_classes(spark, base):
    """The class (smallest id) of every document among those linked by a Hamming distance of 3 or less."""
    d = c01_simhash(spark, base)
    return curation.simhash_classes(d, "doc_id", "simhash", 3)


@R.add("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id FROM d", "d")
def c07_exact_dedup(spark, base):
    return docs(spark, base).select("doc_id", F.min("doc_id").over(W.partitionBy(F.sha2("text", 256))).alias("kept_id"))


@R.add("""WITH g AS (SELECT source, count(*) AS n, sha256('7' || chr(0) || source) AS h FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT source, CASE WHEN before < round((SELECT sum(n) FROM g) * 0.2) THEN 'eval' ELSE 'train' END AS split FROM r""")
def c06_group_held_out(spark, base):
    """Whole groups, in order of a seeded hash, until a fifth of the rows is held out."""
    return curation.held_out_groups(table(spark, base, "documents").where("source IS NOT NULL"), "source", 0.2, "7")


@R.add("SELECT DISTINCT sha256(text) AS digest FROM d WHERE source LIKE '%-core' INTERSECT SELECT DISTINCT sha256(text) FROM d WHERE source LIKE '%-docs'", "d")
def c08_leaking_digests(spark, base):
    d = docs(spark, base)
    part = lambda s: d.where(F.col("source").endswith(s)).select(F.sha2("text", 256).alias("digest"))
    return part("-core").intersect(part("-docs"))


@R.add("SELECT split_name, count(*) AS n, count(DISTINCT group_id) AS groups, count(DISTINCT content_hash) AS hashes FROM (SELECT DISTINCT * FROM laya_dataset_assignments) GROUP BY 1")
def c09_manifest(spark, base):
    a = table(spark, base, "laya_dataset_assignments").distinct()
    return a.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"), F.count_distinct("content_hash").alias("hashes"))


@R.add("SELECT a.candidate_id FROM (SELECT DISTINCT candidate_id FROM laya_dataset_assignments WHERE split_name = 'train') a JOIN (SELECT DISTINCT candidate_id FROM laya_candidates WHERE repository_scope = '/ws/vorlum') c USING (candidate_id)")
def c10_train_export(spark, base):
    a = table(spark, base, "laya_dataset_assignments").where("split_name = 'train'").select("candidate_id").distinct()
    return a.join(table(spark, base, "laya_candidates").where("repository_scope = '/ws/vorlum'").select("candidate_id"), "candidate_id", "left_semi")


@R.add("SELECT repository_scope, content_hash, min(candidate_id) AS candidate_id, count(*) AS n FROM (SELECT DISTINCT candidate_id, repository_scope, content_hash FROM laya_candidates WHERE content_hash <> '') GROUP BY 1, 2")
def c11_unique_hashes(spark, base):
    c = table(spark, base, "laya_candidates").where("content_hash <> ''").select("candidate_id", "repository_scope", "content_hash").distinct()
    return c.groupBy("repository_scope", "content_hash").agg(F.min("candidate_id").alias("candidate_id"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT category, split_name, groups, CASE WHEN groups < 2 THEN 'insufficient' ELSE 'ok' END AS verdict FROM (SELECT c.status AS category, split_name, count(DISTINCT a.group_id) AS groups FROM (SELECT DISTINCT * FROM laya_dataset_assignments) a JOIN (SELECT DISTINCT candidate_id, status FROM laya_candidates) c USING (candidate_id) GROUP BY 1, 2)")
def c05_sufficiency(spark, base):
    a = table(spark, base, "laya_dataset_assignments").distinct().join(table(spark, base, "laya_candidates").select("candidate_id", F.col("status").alias("category")).distinct(), "candidate_id")
    g = a.groupBy("category", "split_name").agg(F.count_distinct("group_id").alias("groups"))
    return g.withColumn("verdict", F.when(F.col("groups") < 2, "insufficient").otherwise("ok"))


QUERIES, ORACLE = R.queries, R.sql
