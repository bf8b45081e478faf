"""Joins, mutations, queues and JSON over memory records, candidates, artifacts and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import mutations as M
from sparkloom.operators import quality, stats
from sparkloom.plans.registry import Registry
from sparkloom.sources.tables import table

MEMORY_SQL = """SELECT record_id, kind, scope, scope_id, key, coalesce(value, '') AS value, status, confidence, coalesce(evidence_ids, '') AS evidence_ids, provenance, epoch_us(updated_at) AS us, epoch_us(expires_at) AS expires_us FROM
(SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC NULLS LAST, coalesce(value, '') DESC, coalesce(status, '') DESC) AS r FROM agent_memory_records WHERE record_id IS NOT NULL) WHERE r = 1"""
EV_SQL = "SELECT DISTINCT id, root, path, hits, epoch_us(created_at) AS us, coalesce(length(text), 0) AS size FROM evidence"
R = Registry(mem=MEMORY_SQL, ev=EV_SQL)


def memory(spark: SparkSession, base: str) -> DataFrame:
    """The latest state of every memory record."""
    t = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL")
    t = stats.latest(t, ["record_id"], [F.desc_nulls_last("updated_at"), F.desc(F.coalesce("value", F.lit(""))), F.desc(F.coalesce("status", F.lit("")))])
    return t.select(
        "record_id", "kind", "scope", "scope_id", "key", F.coalesce("value", F.lit("")).alias("value"), "status", "confidence", F.coalesce("evidence_ids", F.lit("")).alias("evidence_ids"), "provenance",
        F.unix_micros("updated_at").alias("us"), F.unix_micros("expires_at").alias("expires_us"),
    )


def evidence(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "evidence").dropDuplicates(["id"])
    return e.select("id", "root", "path", "hits", F.unix_micros("created_at").alias("us"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))


def n_of(cond=None):
    return F.count(F.lit(1)) if cond is None else F.count(F.when(cond, 1))


# --- predicates -----------------------------------------------------------------------------------------------------------
@R.add("SELECT record_id FROM mem WHERE contains(lower(key), 'a_') OR contains(lower(value), '100%')", "mem")
def p06_literal_like(spark, base):
    """A needle with the signs of LIKE in it, taken literally, in two columns."""
    return memory(spark, base).where(F.lower("key").contains("a_") | F.lower("value").contains("100%")).select("record_id")


@R.add("SELECT record_id FROM mem WHERE expires_us IS NULL OR expires_us > 1771113600000000", "mem")
def p07_live_rows(spark, base):
    return memory(spark, base).where(F.col("expires_us").isNull() | (F.col("expires_us") > 1_771_113_600_000_000)).select("record_id")


@R.add("SELECT record_id, CASE WHEN json_valid(provenance) THEN json_extract_string(provenance, '$.actor') END AS actor FROM mem", "mem")
def p09_guarded_json_path(spark, base):
    return memory(spark, base).select("record_id", F.try_variant_get(F.try_parse_json("provenance"), "$.actor", "string").alias("actor"))


@R.add("SELECT record_id FROM mem WHERE (scope = 'repository' AND scope_id = '/ws/vorlum') OR (scope = 'task' AND scope_id LIKE 'task_1%') OR scope = 'global'", "mem")
def p10_scope_filter(spark, base):
    s, i = F.col("scope"), F.col("scope_id")
    return memory(spark, base).where(((s == "repository") & (i == "/ws/vorlum")) | ((s == "task") & i.startswith("task_1")) | (s == "global")).select("record_id")


@R.add("SELECT record_id FROM mem WHERE json_valid(evidence_ids) AND len(list_filter(CAST(evidence_ids AS VARCHAR[]), lambda x: starts_with(x, 'E0'))) > 0 AND starts_with(evidence_ids, '[')", "mem")
def p11_exists_in_array(spark, base):
    ids = F.from_json("evidence_ids", "array<string>")
    return memory(spark, base).where(F.exists(ids, lambda x: x.startswith("E0"))).select("record_id")


@R.add("SELECT record_id, substr(value, 1, 40) AS value, length(value) > 40 AS cut, len(string_split(value, ' ')) AS n_parts FROM mem", "mem")
def p14_compact(spark, base):
    """Values cut to 40 characters, with a flag and a count of what there was."""
    return memory(spark, base).select("record_id", F.substring("value", 1, 40).alias("value"), (F.length("value") > 40).alias("cut"), F.size(F.split("value", " ")).alias("n_parts"))


# --- joins ----------------------------------------------------------------------------------------------------------------
CAND_SQL = "(SELECT DISTINCT candidate_id, repository_scope, status, group_id FROM laya_candidates)"
ASSIGN_SQL = "(SELECT DISTINCT snapshot_id, candidate_id, group_id, split_name FROM laya_dataset_assignments)"


def candidates(spark, base):
    return table(spark, base, "laya_candidates").select("candidate_id", "repository_scope", "status", "group_id").distinct()


def assignments(spark, base):
    return table(spark, base, "laya_dataset_assignments").select("snapshot_id", "candidate_id", "group_id", "split_name").distinct()


@R.add(f"SELECT a.snapshot_id, a.candidate_id, c.repository_scope, a.split_name FROM {ASSIGN_SQL} a JOIN {CAND_SQL} c ON a.candidate_id = c.candidate_id")
def j01_inner(spark, base):
    return assignments(spark, base).drop("group_id").join(candidates(spark, base).select("candidate_id", "repository_scope"), "candidate_id").select("snapshot_id", "candidate_id", "repository_scope", "split_name")


@R.add(f"SELECT DISTINCT a.snapshot_id, c.repository_scope FROM {ASSIGN_SQL} a JOIN {CAND_SQL} c ON a.candidate_id = c.candidate_id")
def j02_inner_distinct(spark, base):
    return assignments(spark, base).join(candidates(spark, base).select("candidate_id", "repository_scope"), "candidate_id").select("snapshot_id", "repository_scope").distinct()


@R.add("SELECT a.artifact_id, m.artifact_id IS NOT NULL AS has_paging FROM (SELECT DISTINCT artifact_id FROM artifacts) a LEFT JOIN (SELECT DISTINCT artifact_id FROM artifact_paging_metadata) m ON a.artifact_id = m.artifact_id")
def j03_left(spark, base):
    m = table(spark, base, "artifact_paging_metadata").select("artifact_id").distinct().withColumn("m", F.lit(True))
    return table(spark, base, "artifacts").select("artifact_id").distinct().join(m, "artifact_id", "left").select("artifact_id", F.col("m").isNotNull().alias("has_paging"))


@R.add("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_returnflag = 'R' AND l.l_linenumber = 1")
def j04_left_on_several(spark, base):
    right = table(spark, base, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return table(spark, base, "orders").select("o_orderkey").join(right, "o_orderkey", "left")


@R.add("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def j05_left_and_count(spark, base):
    n = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_of().alias("n"))
    return table(spark, base, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@R.add("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def j07_semi(spark, base):
    return table(spark, base, "part").select("p_partkey", "p_name").join(table(spark, base, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@R.add("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def j08_anti(spark, base):
    return table(spark, base, "customer").select("c_custkey").join(table(spark, base, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@R.add("WITH x AS (SELECT record_id, unnest(CAST(evidence_ids AS VARCHAR[])) AS id FROM mem WHERE starts_with(evidence_ids, '[') AND json_valid(evidence_ids)) SELECT DISTINCT record_id, id FROM x WHERE id NOT IN (SELECT id FROM evidence)", "mem")
def j09_orphans(spark, base):
    """Evidence named by memory records that isn't stored."""
    x = memory(spark, base).select("record_id", F.explode(F.from_json("evidence_ids", "array<string>")).alias("id")).where("id IS NOT NULL").distinct()
    return x.join(table(spark, base, "evidence").select("id"), "id", "left_anti").select("record_id", "id")


@R.add("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 5)")
def j10_anti_on_condition(spark, base):
    return table(spark, base, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, base, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@R.add("""WITH s AS (SELECT c_nationkey AS k, min(c_custkey) AS a, min(c_custkey) + 40 AS z FROM customer GROUP BY 1)
SELECT s.k, count(*) AS n, CAST(sum(o.o_custkey) AS BIGINT) AS keys FROM s JOIN orders o ON o.o_custkey BETWEEN s.a AND s.z GROUP BY 1""")
def j11_interval(spark, base):
    """Points in intervals: both sides meet in the blocks an interval covers, so it is an equality join."""
    block = 32
    s = table(spark, base, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("a")).withColumn("z", F.col("a") + 40)
    s = s.withColumn("b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("z") / block))))
    o = table(spark, base, "orders").select("o_custkey", F.floor(F.col("o_custkey") / block).alias("b"))
    met = o.join(s, "b").where(F.col("o_custkey").between(F.col("a"), F.col("z")))
    return met.groupBy("k").agg(n_of().alias("n"), F.sum("o_custkey").alias("keys"))


@R.add("SELECT a.candidate_id, b.candidate_id AS other FROM (SELECT DISTINCT candidate_id, task_id FROM laya_candidates) a JOIN (SELECT DISTINCT candidate_id, task_id FROM laya_candidates) b ON a.task_id = b.task_id AND a.candidate_id < b.candidate_id")
def j12_self(spark, base):
    """Candidates of one task, in pairs (tasks are small groups by their nature)."""
    c = table(spark, base, "laya_candidates").select("candidate_id", "task_id").distinct()
    return c.join(c.select(F.col("candidate_id").alias("other"), "task_id"), "task_id").where("candidate_id < other").select("candidate_id", "other")


@R.add("SELECT m.record_id, coalesce(n, 0) AS n_relations FROM mem m LEFT JOIN (SELECT supersedes_record_id AS record_id, count(*) AS n FROM agent_memory_records WHERE supersedes_record_id IS NOT NULL GROUP BY 1) x USING (record_id) WHERE m.kind = 'fact'", "mem")
def j13_enriched_hits(spark, base):
    n = table(spark, base, "agent_memory_records").where("supersedes_record_id IS NOT NULL").groupBy(F.col("supersedes_record_id").alias("record_id")).agg(n_of().alias("n_relations"))
    return memory(spark, base).where("kind = 'fact'").select("record_id").join(n, "record_id", "left").na.fill(0)


_PAIR = "SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer WHERE c_mktsegment = '{}' GROUP BY 1"


def _segment(spark, base, name):
    return table(spark, base, "customer").where(F.col("c_mktsegment") == name).groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("bal"), F.count(F.lit(1)).cast("double").alias("n"))


@R.add("SELECT k, CAST(max(CASE WHEN g = 'a' THEN n END) AS BIGINT) AS a, CAST(max(CASE WHEN g = 'b' THEN n END) AS BIGINT) AS b FROM (SELECT c_nationkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'a' ELSE 'b' END AS g, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2")
def j14_matched_pairs(spark, base):
    """Groups that stand on both sides."""
    c = table(spark, base, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    g = c.groupBy(F.col("c_nationkey").alias("k")).agg(n_of(F.col("c_mktsegment") == "BUILDING").alias("a"), n_of(F.col("c_mktsegment") == "MACHINERY").alias("b"))
    return g.where("a > 0 AND b > 0")


_DELTA = """WITH x AS (SELECT c_nationkey AS k, avg(c_acctbal) AS bal, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), y AS (SELECT c_nationkey AS k, avg(c_acctbal) AS bal, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1)
SELECT count(*) AS matched, round(avg(y.bal - x.bal), 6) AS bal, round(avg(y.n - x.n), 6) AS n FROM x JOIN y USING (k)"""


@R.add(_DELTA)
def j15_paired_deltas(spark, base):
    return quality.paired_deltas(_segment(spark, base, "BUILDING"), _segment(spark, base, "MACHINERY"), "k", ["bal", "n"])


@R.add(_DELTA)
def v04_signed_deltas(spark, base):
    return quality.paired_deltas(_segment(spark, base, "BUILDING"), _segment(spark, base, "MACHINERY"), "k", ["bal", "n"])


@R.add("SELECT n.n_name, coalesce(x.n, 0) AS n FROM nation n LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) x ON x.k = n.n_nationkey")
def j16_catalog(spark, base):
    """Every entry of the catalogue, unused ones with zero."""
    x = table(spark, base, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(n_of().alias("n"))
    return table(spark, base, "nation").select("n_nationkey", "n_name").join(x, "n_nationkey", "left").na.fill(0, ["n"]).select("n_name", "n")


@R.add("""SELECT o_orderkey, seen FROM (SELECT o.o_orderkey, max(e.event_id) AS seen FROM (SELECT o_orderkey, o_custkey % 50 AS u, o_orderkey % 10000 AS at FROM orders) o LEFT JOIN events e ON e.user_id = o.u AND e.event_id <= o.at GROUP BY 1)""")
def j17_as_of(spark, base):
    """For each order the last event of its user up to a point: both sides in one ordered window, no range join."""
    o = table(spark, base, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("u"), (F.col("o_orderkey") % 10000).alias("at"))
    e = table(spark, base, "events").select(F.lit(None).cast("long").alias("o_orderkey"), F.col("user_id").alias("u"), F.col("event_id").alias("at"), F.col("event_id").alias("v"))
    both = e.unionByName(o.withColumn("v", F.lit(None).cast("long")))
    w = W.partitionBy("u").orderBy("at", F.col("o_orderkey").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("seen", F.last("v", ignorenulls=True).over(w)).where("o_orderkey IS NOT NULL").select("o_orderkey", "seen")


@R.add("""WITH p AS (SELECT DISTINCT path FROM evidence), f AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM evidence WHERE hits > 20)
SELECT p.path, f.folder FROM p JOIN f ON p.path = f.folder OR starts_with(p.path, f.folder || '/')""")
def j18_prefix_overlap(spark, base):
    """Paths under held folders: each path meets its own prefixes by equality."""
    e = table(spark, base, "evidence")
    s = F.split("path", "/")
    f = e.where("hits > 20").select(F.array_join(F.slice(s, 1, 2), "/").alias("folder")).distinct()
    p = e.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, 1, n), "/"))).alias("folder"))
    return p.join(f, "folder").select("path", "folder")


# --- aggregations and windows ----------------------------------------------------------------------------------------------
@R.add("SELECT status, count(*) AS n FROM mem GROUP BY 1", "mem")
def a32_status_counts(spark, base):
    return memory(spark, base).groupBy("status").agg(n_of().alias("n"))


@R.add("SELECT count(*) AS n FROM (SELECT DISTINCT kind, scope, scope_id, status FROM mem)", "mem")
def a35_count_of_groups(spark, base):
    return memory(spark, base).select("kind", "scope", "scope_id", "status").distinct().agg(n_of().alias("n"))


@R.add("""SELECT scope, scope_id, kind, count(*) AS n, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) AS confidence_milli, min(record_id) AS first_id, max(record_id) AS last_id FROM mem GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND scope_id <> ''""", "mem")
def a37_compaction(spark, base):
    """Groups of two or more records; members are named by their first and last id, as a hot scope may hold any number."""
    g = memory(spark, base).where("scope_id <> ''").groupBy("scope", "scope_id", "kind")
    milli = F.sum(F.round(F.col("confidence") * 1000).cast("long"))
    return g.agg(n_of().alias("n"), milli.alias("confidence_milli"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")).where("n >= 2")


@R.add("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 0 GROUP BY 1, 2 ORDER BY 4 DESC, 1, 2 LIMIT 20")
def a38_json_totals(spark, base):
    e = table(spark, base, "events").where("value > 0")
    g = e.groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(n_of().alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.orderBy(F.desc("total"), "event_type", "k").limit(20)


@R.add("SELECT split_part(path, '/', 1) AS module, count(DISTINCT path) AS files, CAST(sum(size) AS BIGINT) AS chars, max(hits) AS hits FROM ev GROUP BY 1", "ev")
def a39_module_cards(spark, base):
    return evidence(spark, base).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).agg(F.count_distinct("path").alias("files"), F.sum("size").alias("chars"), F.max("hits").alias("hits"))


@R.add("SELECT split_name, round(avg(CASE WHEN content_hash <> '' THEN 1.0 ELSE 0 END), 6) AS with_hash, count(DISTINCT group_id) AS groups FROM laya_dataset_assignments GROUP BY 1")
def a40_rates(spark, base):
    a = table(spark, base, "laya_dataset_assignments")
    return a.groupBy("split_name").agg(F.round(F.avg(F.when(F.col("content_hash") != "", 1.0).otherwise(0.0)), 6).alias("with_hash"), F.count_distinct("group_id").alias("groups"))


@R.add("SELECT 'lineitem' AS t, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def a41_row_counts(spark, base):
    """Counts from the footers of the files."""
    parts = [table(spark, base, t).agg(n_of().alias("n")).select(F.lit(t).alias("t"), "n") for t in ("lineitem", "orders", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add(f"SELECT c.status, count(DISTINCT CASE WHEN split_name = 'train' THEN a.group_id END) AS train, count(DISTINCT CASE WHEN split_name = 'calibration' THEN a.group_id END) AS calibration, count(DISTINCT CASE WHEN split_name = 'test' THEN a.group_id END) AS test FROM {ASSIGN_SQL} a JOIN {CAND_SQL} c ON a.candidate_id = c.candidate_id GROUP BY 1")
def a42_matrix(spark, base):
    j = assignments(spark, base).join(candidates(spark, base).select("candidate_id", "status"), "candidate_id")
    return j.groupBy("status").agg(*[F.count_distinct(F.when(F.col("split_name") == s, F.col("group_id"))).alias(s) for s in ("train", "calibration", "test")])


@R.add("SELECT record_id, key, us FROM (SELECT *, row_number() OVER (PARTITION BY kind, scope, scope_id, key ORDER BY us DESC, record_id DESC) AS r FROM mem) WHERE r = 1", "mem")
def w01_latest_per_key(spark, base):
    return stats.latest(memory(spark, base), ["kind", "scope", "scope_id", "key"], [F.desc("us"), F.desc("record_id")]).select("record_id", "key", "us")


@R.add("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS total FROM lineitem")
def w02_sum_over(spark, base):
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(W.partitionBy("l_orderkey")), 2).alias("total"))


@R.add("SELECT path, id, hits FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us DESC, id) AS r FROM ev WHERE root IN ('/ws/vorlum', '/ws/quitamlum')) WHERE r = 1", "ev")
def w04_windowed_by_path(spark, base):
    e = evidence(spark, base).where(F.col("root").isin("/ws/vorlum", "/ws/quitamlum"))
    return stats.latest(e, ["path"], [F.desc("us"), F.col("id")]).select("path", "id", "hits")


@R.add("""WITH g AS (SELECT l_suppkey AS k, l_orderkey AS a, max(l_linenumber) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY k ORDER BY a) + 1 THEN 0 ELSE 1 END AS f FROM g),
n AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM m) SELECT k, min(a) AS start, max(a) AS "end", count(*) AS n FROM n GROUP BY k, no HAVING count(*) > 1""")
def w08_number_runs(spark, base):
    """Runs of consecutive numbers."""
    g = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("a"), F.col("l_orderkey").alias("b")).distinct()
    return stats.islands(g, ["k"], "a", "b", 1).where("n > 1")


@R.add("""WITH r AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY first) AS rank FROM (SELECT source, path, min(doc_id) AS first FROM documents WHERE source IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)) SELECT * FROM r WHERE rank <= 5""")
def w12_rank_within_source(spark, base):
    d = table(spark, base, "documents").where("source IS NOT NULL AND path IS NOT NULL").groupBy("source", "path").agg(F.min("doc_id").alias("first"))
    return stats.top_per_group(d, ["source"], [F.col("first")], 5).select("source", "path", "rank")


@R.add("""SELECT record_id, CAST(100 * confidence AS INTEGER) + least(9, (1771113600000000 - us) // 1800000000) AS p FROM mem WHERE us < 1771113600000000 AND confidence IS NOT NULL ORDER BY p DESC, record_id LIMIT 100""", "mem")
def w15_aged_priority(spark, base):
    """Priority that grows by one each half hour of waiting, by nine at most."""
    m = memory(spark, base).where("us < 1771113600000000 AND confidence IS NOT NULL")
    age = F.floor((F.lit(1_771_113_600_000_000) - F.col("us")) / 1_800_000_000)
    return m.select("record_id", (F.rint(100 * F.col("confidence")).cast("long") + F.least(F.lit(9), age)).alias("p")).orderBy(F.desc("p"), "record_id").limit(100)


# --- mutations ---------------------------------------------------------------------------------------------------------------
@R.add("SELECT root, path, CAST(sum(hits) AS BIGINT) AS hits FROM ev GROUP BY 1, 2", "ev")
def d01_counter_upsert(spark, base):
    e = evidence(spark, base).withColumn("half", F.crc32("id") % 2)
    return M.upsert_counters(e.where("half = 0"), e.where("half = 1"), ["root", "path"], ["hits"])


@R.add("SELECT scope, scope_id, key, record_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, scope_id, key ORDER BY us DESC, record_id DESC) AS r FROM mem) WHERE r = 1", "mem")
def d02_replace_upsert(spark, base):
    m = memory(spark, base).withColumn("half", F.crc32("record_id") % 2)
    return M.upsert_latest(m.where("half = 0"), m.where("half = 1"), ["scope", "scope_id", "key"], [F.desc("us"), F.desc("record_id")]).select("scope", "scope_id", "key", "record_id")


@R.add("SELECT DISTINCT id FROM evidence")
def d03_insert_or_ignore(spark, base):
    e = table(spark, base, "evidence").select("id")
    return M.insert_or_ignore(e.distinct(), e, ["id"])


@R.add("""SELECT record_id, v, v = 1 OR gap > 0 AS taken FROM (SELECT record_id, row_number() OVER w AS v, us - lag(us) OVER w AS gap FROM (SELECT DISTINCT record_id, epoch_us(updated_at) AS us FROM agent_memory_records WHERE record_id IS NOT NULL AND updated_at IS NOT NULL) WINDOW w AS (PARTITION BY record_id ORDER BY us))""")
def d04_compare_and_swap(spark, base):
    """Versions of each record in order, and whether each write found the version before it."""
    m = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL AND updated_at IS NOT NULL").select("record_id", F.unix_micros("updated_at").alias("us")).distinct()
    w = W.partitionBy("record_id").orderBy("us")
    v = m.select("record_id", F.row_number().over(w).alias("v"), (F.col("us") - F.lag("us").over(w)).alias("gap"))
    return v.select("record_id", "v", ((F.col("v") == 1) | (F.col("gap") > 0)).alias("taken"))


@R.add("SELECT id FROM ev WHERE us >= 1771113600000000", "ev")
def d05_ttl(spark, base):
    return evidence(spark, base).where("us >= 1771113600000000").select("id")


@R.add("SELECT root, id FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY us DESC, id) AS r FROM ev) WHERE r <= 10", "ev")
def d06_lru(spark, base):
    """The ten most recent rows of each root stay."""
    return M.keep_newest(evidence(spark, base), ["root"], [F.desc("us"), F.col("id")], 10).select("root", "id")


@R.add("SELECT root, path FROM (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY h DESC, last DESC, path) AS r FROM (SELECT root, path, sum(hits) AS h, max(us) AS last FROM ev GROUP BY 1, 2)) WHERE r <= 5", "ev")
def d08_bounded_retention(spark, base):
    g = evidence(spark, base).groupBy("root", "path").agg(F.sum("hits").alias("h"), F.max("us").alias("last"))
    return M.keep_newest(g, ["root"], [F.desc("h"), F.desc("last"), F.col("path")], 5).select("root", "path")


@R.add("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000")
def d09_count_bound(spark, base):
    return table(spark, base, "events").select("event_id").orderBy(F.desc("event_id")).limit(2000)


@R.add("SELECT record_id, CASE WHEN us < 1769904000000000 AND status = 'active' THEN 'stale' ELSE status END AS status FROM mem", "mem")
def d10_stale_marking(spark, base):
    s = F.when((F.col("us") < 1_769_904_000_000_000) & (F.col("status") == "active"), "stale").otherwise(F.col("status"))
    return memory(spark, base).select("record_id", s.alias("status"))


@R.add("""SELECT DISTINCT a.record_id FROM mem a JOIN mem b ON a.scope = b.scope AND a.scope_id = b.scope_id AND a.key = b.key AND a.record_id <> b.record_id AND a.value <> b.value WHERE a.confidence >= 0.8 AND b.confidence >= 0.8 AND a.us > b.us""", "mem")
def d11_conflicts(spark, base):
    """Confident records later than a confident one of the same key and another value: an aggregate, not a self join."""
    m = memory(spark, base).where("confidence >= 0.8")
    g = ["scope", "scope_id", "key"]
    per = m.groupBy(*g, "value").agg(F.min("us").alias("first")).withColumn("least", F.min(F.struct("first", "value")).over(W.partitionBy(*g)))
    second = per.where(F.col("value") != F.col("least.value")).groupBy(*g).agg(F.min("first").alias("second"), F.first("least").alias("least"))
    j = m.join(second, g)
    other = F.when(F.col("value") != F.col("least.value"), F.col("least.first")).otherwise(F.col("second"))
    return j.where(F.col("us") > other).select("record_id").distinct()


@R.add("SELECT root, id FROM (SELECT root, id, sum(size) OVER (PARTITION BY root ORDER BY hits DESC, us DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ev) WHERE run <= 5000", "ev")
def d12_budget_eviction(spark, base):
    return M.keep_within_budget(evidence(spark, base), ["root"], [F.desc("hits"), F.desc("us"), F.col("id")], "size", 5000).select("root", "id")


# --- queues --------------------------------------------------------------------------------------------------------------------
JOBS = "SELECT o_orderkey AS id, o_custkey % 7 AS model, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, o_orderkey // 10 AS due FROM orders"
R.views["jobs"] = JOBS


def jobs(spark, base):
    o = table(spark, base, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("model"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), F.expr("o_orderkey div 10").alias("due"))


@R.add("SELECT id FROM jobs WHERE status = 'O' ORDER BY p + least(9, (10000 - due) // 300) DESC, due, id LIMIT 1", "jobs")
def q01_next_job(spark, base):
    aged = F.col("p") + F.least(F.lit(9), F.floor((F.lit(10000) - F.col("due")) / 300))
    return jobs(spark, base).where("status = 'O'").orderBy(F.desc(aged), "due", "id").limit(1).select("id")


@R.add("SELECT model, count(*) AS n, max(p) AS p FROM jobs WHERE status = 'O' GROUP BY 1 ORDER BY -(2 * count(*) + max(p)), min(due), -count(*), model LIMIT 1", "jobs")
def q02_affinity(spark, base):
    g = jobs(spark, base).where("status = 'O'").groupBy("model").agg(n_of().alias("n"), F.max("p").alias("p"), F.min("due").alias("due"))
    return g.orderBy(-(2 * F.col("n") + F.col("p")), "due", -F.col("n"), "model").limit(1).select("model", "n", "p")


@R.add("SELECT model, max(10000 - due) >= 9990 AS starving, min(id) AS oldest FROM jobs WHERE status = 'O' GROUP BY 1", "jobs")
def q03_starvation(spark, base):
    return jobs(spark, base).where("status = 'O'").groupBy("model").agg((F.max(F.lit(10000) - F.col("due")) >= 9990).alias("starving"), F.min("id").alias("oldest"))


@R.add("SELECT id, CASE WHEN status = 'O' AND due < 500 THEN 'queued' ELSE status END AS status FROM jobs", "jobs")
def q04_lease_expiry(spark, base):
    return jobs(spark, base).select("id", F.when((F.col("status") == "O") & (F.col("due") < 500), "queued").otherwise(F.col("status")).alias("status"))


@R.add("SELECT model, due, min(id) AS id FROM jobs WHERE status = 'O' GROUP BY 1, 2", "jobs")
def q05_active_unique(spark, base):
    return jobs(spark, base).where("status = 'O'").groupBy("model", "due").agg(F.min("id").alias("id"))


@R.add("SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY due, id) AS token FROM jobs", "jobs")
def q06_fencing_tokens(spark, base):
    return jobs(spark, base).select("id", "model", F.row_number().over(W.partitionBy("model").orderBy("due", "id")).alias("token"))


@R.add("SELECT record_id, max(us) AS us, max(updates) AS updates FROM (SELECT record_id, epoch_us(updated_at) AS us, count(*) OVER (PARTITION BY record_id, source) AS updates FROM agent_memory_records WHERE record_id IS NOT NULL) GROUP BY 1")
def q07_clock_merge(spark, base):
    """The element-wise maximum of the clocks of a record's writers."""
    m = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL")
    g = m.groupBy("record_id", "source").agg(F.count(F.lit(1)).alias("c"), F.max(F.unix_micros("updated_at")).alias("us"))
    return g.groupBy("record_id").agg(F.max("us").alias("us"), F.max("c").alias("updates"))


@R.add("SELECT model, CAST(sum(CASE WHEN status = 'O' THEN 1 WHEN status = 'F' THEN -1 ELSE 0 END) AS BIGINT) AS held FROM jobs GROUP BY 1", "jobs")
def q08_semaphore(spark, base):
    return jobs(spark, base).groupBy("model").agg(F.sum(F.when(F.col("status") == "O", 1).when(F.col("status") == "F", -1).otherwise(0)).alias("held"))


@R.add("SELECT id FROM (SELECT id, sum(p) OVER (PARTITION BY model ORDER BY due, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM jobs) WHERE run <= 100", "jobs")
def q09_reservations(spark, base):
    return M.keep_within_budget(jobs(spark, base), ["model"], [F.col("due"), F.col("id")], "p", 100).select("id")


# --- JSON ----------------------------------------------------------------------------------------------------------------------
@R.add("SELECT candidate_id, coalesce(CASE WHEN json_valid(candidate_json) THEN json_extract_string(candidate_json, '$.category') END, 'none') AS category FROM (SELECT DISTINCT candidate_id, candidate_json FROM laya_candidates)")
def y01_safe_json(spark, base):
    c = table(spark, base, "laya_candidates").select("candidate_id", "candidate_json").distinct()
    return c.select("candidate_id", F.coalesce(F.try_variant_get(F.try_parse_json("candidate_json"), "$.category", "string"), F.lit("none")).alias("category"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events ORDER BY k DESC, event_id LIMIT 100")
def y04_json_cast_order(spark, base):
    return table(spark, base, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).orderBy(F.desc("k"), "event_id").limit(100)


@R.add("SELECT record_id, coalesce(CASE WHEN json_valid(provenance) THEN nullif(trim(json_extract_string(provenance, '$.actor')), '') END, CASE WHEN json_valid(provenance) THEN nullif(trim(json_extract_string(provenance, '$.run')), '') END, 'unknown') AS who FROM mem", "mem")
def y05_paths_coalesced(spark, base):
    v = F.try_parse_json("provenance")
    at = lambda p: F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit(""))
    return memory(spark, base).select("record_id", F.coalesce(at("$.actor"), at("$.run"), F.lit("unknown")).alias("who"))


@R.add("SELECT record_id, unnest(CAST(evidence_ids AS VARCHAR[])) AS id FROM mem WHERE starts_with(evidence_ids, '[') AND json_valid(evidence_ids)", "mem")
def y06_json_array_explode(spark, base):
    return memory(spark, base).select("record_id", F.explode(F.from_json("evidence_ids", "array<string>")).alias("id"))


@R.add("SELECT record_id, sha256('{\"key\":' || to_json(key) || ',\"kind\":' || to_json(kind) || '}') AS digest FROM mem WHERE key IS NOT NULL AND kind IS NOT NULL", "mem")
def y07_canonical_digest(spark, base):
    """The digest of a canonical form: members in order of name, no blanks."""
    return memory(spark, base).where("key IS NOT NULL AND kind IS NOT NULL").select("record_id", F.sha2(F.to_json(F.struct("key", "kind")), 256).alias("digest"))


@R.add("""WITH v AS (SELECT record_id, status, coalesce(value, '') AS value, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC NULLS LAST, coalesce(value, '') DESC, coalesce(status, '') DESC) AS r FROM (SELECT DISTINCT record_id, status, value, updated_at FROM agent_memory_records WHERE record_id IS NOT NULL))
SELECT a.record_id, a.status IS DISTINCT FROM b.status AS status_changed, a.value <> b.value AS value_changed FROM v a JOIN v b ON a.record_id = b.record_id AND a.r = 1 AND b.r = 2""")
def y08_delta(spark, base):
    """What changed between the last two states of a record."""
    m = table(spark, base, "agent_memory_records").where("record_id IS NOT NULL").select("record_id", "status", "value", "updated_at").distinct().withColumn("value", F.coalesce("value", F.lit("")))
    w = W.partitionBy("record_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("value"), F.desc(F.coalesce("status", F.lit(""))))
    v = m.withColumns({"r": F.row_number().over(w), "s2": F.lead("status").over(w), "v2": F.lead("value").over(w)}).where("r = 1 AND v2 IS NOT NULL")
    return v.select("record_id", (~F.col("status").eqNullSafe(F.col("s2"))).alias("status_changed"), (F.col("value") != F.col("v2")).alias("value_changed"))


@R.add("SELECT candidate_id, json_extract_string(candidate_json, '$.preprocessing.version') AS version FROM (SELECT DISTINCT candidate_id, candidate_json FROM laya_candidates WHERE json_valid(candidate_json))")
def y11_dotted_lookup(spark, base):
    c = table(spark, base, "laya_candidates").select("candidate_id", F.try_parse_json("candidate_json").alias("v"), "candidate_json").where("v IS NOT NULL").dropDuplicates(["candidate_id", "candidate_json"])
    return c.select("candidate_id", F.try_variant_get("v", "$.preprocessing.version", "string").alias("version"))


QUERIES, ORACLE = R.queries, R.sql
