"""Reports over telemetry_events: scans, aggregations, percentiles, rollups, windows and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import stats
from sparkloom.plans.registry import Registry
from sparkloom.sources.tables import table

DAY = 86_400_000_000
#: Fixed value: start of the reports' window, 2026-02-15 00:00 UTC in microseconds.
CUTOFF = 1_771_113_600_000_000

STEPS = """SELECT DISTINCT id, epoch_us(created_at) AS us, strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d') AS day,
  lower(trim(coalesce(activity, ''))) AS activity, coalesce(event_type, '') AS event_type, lower(trim(coalesce(model, ''))) AS model,
  coalesce(agent, '') AS agent, coalesce(root, '') AS root, CASE WHEN duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms) THEN duration_ms END AS d,
  CASE WHEN queue_wait_ms >= 0 AND NOT isnan(queue_wait_ms) THEN queue_wait_ms END AS q, coalesce(input_tokens, 0) AS tin, coalesce(output_tokens, 0) AS tout,
  coalesce(success, 0) AS success, coalesce(cache_hit, 0) AS cache_hit, coalesce(error_type, '') AS error_type FROM telemetry_events"""
R = Registry(steps=STEPS)


def steps(spark: SparkSession, base: str) -> DataFrame:
    """The measured steps, each delivered once, with empty names for absent ones and null for what wasn't measured."""
    t = table(spark, base, "telemetry_events").dropDuplicates(["id"])
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    d, q = F.col("duration_ms"), F.col("queue_wait_ms")
    return t.select(
        "id", F.unix_micros("created_at").alias("us"), F.date_format("created_at", "yyyy-MM-dd").alias("day"), low("activity"), plain("event_type"), low("model"), plain("agent"), plain("root"),
        F.when((d > 0) & ~F.isnan(d) & (d < float("inf")), d).alias("d"), F.when((q >= 0) & ~F.isnan(q), q).alias("q"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("input_tokens", "tin"), ("output_tokens", "tout"), ("success", "success"), ("cache_hit", "cache_hit"))], plain("error_type"),
    )


def n_of(cond=None):
    return F.count(F.lit(1)) if cond is None else F.count(F.when(cond, 1))


# --- scans and projections --------------------------------------------------------------------------------------------
@R.add(f"SELECT id, activity, tin FROM steps WHERE us >= {CUTOFF}", "steps")
def s01_time_pruned_scan(spark, base):
    return steps(spark, base).where(F.col("us") >= CUTOFF).select("id", "activity", "tin")


@R.add("SELECT id, root FROM steps WHERE us >= (SELECT max(us) FROM steps WHERE event_type = 'maintenance') - 3600000000", "steps")
def s02_scoped_scan(spark, base):
    """The rows since an hour before the last maintenance: the bound is a scalar of the data."""
    s = steps(spark, base)
    start = s.where("event_type = 'maintenance'").agg(F.max("us").alias("m"))
    return s.join(F.broadcast(start), F.col("us") >= F.col("m") - 3_600_000_000).select("id", "root")  # a one-row side


@R.add("SELECT id, activity, d FROM steps ORDER BY id DESC LIMIT 10000", "steps")
def s03_recent_sample(spark, base):
    """The latest 10,000 rows (the limit is the feature)."""
    return steps(spark, base).orderBy(F.desc("id")).limit(10_000).select("id", "activity", "d")


@R.add("SELECT id, us FROM steps ORDER BY us DESC, id DESC LIMIT 1000", "steps")
def s04_latest_by_time(spark, base):
    return steps(spark, base).orderBy(F.desc("us"), F.desc("id")).limit(1000).select("id", "us")


@R.add("SELECT id, CASE WHEN agent = '' THEN 'uncategorized' ELSE agent END AS agent FROM steps", "steps")
def p01_conditional_projection(spark, base):
    return steps(spark, base).select("id", F.coalesce(F.nullif("agent", F.lit("")), F.lit("uncategorized")).alias("agent"))


DOMAIN_SQL = """CASE WHEN event_type = 'inference' THEN 'generation' WHEN activity = 'command_run' OR event_type = 'tool' THEN 'command'
  WHEN activity LIKE '%search%' OR activity LIKE '%index%' THEN 'repository' ELSE 'other' END"""


def domain():
    a = F.col("activity")
    return (
        F.when(F.col("event_type") == "inference", "generation").when((a == "command_run") | (F.col("event_type") == "tool"), "command").when(a.contains("search") | a.contains("index"), "repository").otherwise("other")
    )


@R.add(f"SELECT id, {DOMAIN_SQL} AS domain FROM steps", "steps")
def p02_domain(spark, base):
    return steps(spark, base).select("id", domain().alias("domain"))


COHORT_SQL = "CASE WHEN event_type = 'inference' THEN 'inference' WHEN error_type = 'unavailable' THEN 'unavailable' WHEN error_type <> '' THEN 'failed' WHEN event_type = 'tool' THEN 'tool' ELSE 'internal' END"


def cohort():
    e = F.col("error_type")
    return F.when(F.col("event_type") == "inference", "inference").when(e == "unavailable", "unavailable").when(e != "", "failed").when(F.col("event_type") == "tool", "tool").otherwise("internal")


@R.add(f"SELECT {COHORT_SQL} AS cohort, count(*) AS n FROM steps GROUP BY 1", "steps")
def p03_cohorts(spark, base):
    return steps(spark, base).groupBy(cohort().alias("cohort")).agg(n_of().alias("n"))


@R.add("SELECT id FROM steps WHERE root LIKE '/ws/%' AND activity NOT IN ('embed', 'command_run', '')", "steps")
def p05_prefix_and_not_in(spark, base):
    return steps(spark, base).where(F.col("root").startswith("/ws/") & ~F.col("activity").isin("embed", "command_run", "")).select("id")


# --- aggregations ------------------------------------------------------------------------------------------------------
@R.add("""SELECT count(*) AS n, CAST(sum(tin) AS BIGINT) AS tin, CAST(sum(tout) AS BIGINT) AS tout, round(avg(d), 3) AS avg_ms, CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
  CAST(sum(cache_hit) AS BIGINT) AS hits FROM steps""", "steps")  # fmt: skip
def a01_totals(spark, base):
    return steps(spark, base).agg(n_of().alias("n"), F.sum("tin").alias("tin"), F.sum("tout").alias("tout"), F.round(F.avg("d"), 3).alias("avg_ms"), n_of(F.col("success") == 0).alias("failures"), F.sum("cache_hit").alias("hits"))


@R.add("SELECT activity, round(avg(CASE WHEN q > 0 THEN q END), 3) AS avg_wait FROM steps GROUP BY 1", "steps")
def a02_average_without_zeros(spark, base):
    return steps(spark, base).groupBy("activity").agg(F.round(F.avg(F.when(F.col("q") > 0, F.col("q"))), 3).alias("avg_wait"))


@R.add("SELECT activity, count(*) AS n, CAST(sum(CAST(floor(d * 1000) AS BIGINT)) AS BIGINT) AS total_us, round(avg(d), 3) AS avg_ms FROM steps GROUP BY 1 ORDER BY n DESC, activity LIMIT 20", "steps")
def a03_top_activities(spark, base):
    g = steps(spark, base).groupBy("activity").agg(n_of().alias("n"), F.sum(F.floor(F.col("d") * 1000).cast("long")).alias("total_us"), F.round(F.avg("d"), 3).alias("avg_ms"))
    return g.orderBy(F.desc("n"), "activity").limit(20)


@R.add("SELECT model, count(*) AS n FROM steps WHERE cache_hit = 1 GROUP BY 1 ORDER BY n DESC, model LIMIT 100", "steps")
def a04_cache_hits_by_model(spark, base):
    return steps(spark, base).where("cache_hit = 1").groupBy("model").agg(n_of().alias("n")).orderBy(F.desc("n"), "model").limit(100)


@R.add(f"SELECT {DOMAIN_SQL} AS domain, count(*) AS n, CAST(sum(cache_hit) AS BIGINT) AS hits, round(sum(cache_hit) * 1.0 / count(*), 4) AS hit_rate FROM steps GROUP BY 1", "steps")
def a05_by_domain(spark, base):
    g = steps(spark, base).groupBy(domain().alias("domain")).agg(n_of().alias("n"), F.sum("cache_hit").alias("hits"))
    return g.withColumn("hit_rate", F.round(F.col("hits") / F.col("n"), 4))


@R.add("SELECT cache_hit, error_type, count(*) AS n FROM steps GROUP BY 1, 2", "steps")
def a06_cache_decisions(spark, base):
    return steps(spark, base).groupBy("cache_hit", "error_type").agg(n_of().alias("n"))


@R.add("SELECT success, error_type, count(*) AS n, CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM steps GROUP BY 1, 2", "steps")
def a07_outcomes(spark, base):
    return steps(spark, base).groupBy("success", "error_type").agg(n_of().alias("n"), n_of(F.col("success") == 0).alias("failures"))


@R.add("SELECT event_type, count(DISTINCT CASE WHEN agent <> '' THEN agent END) AS agents FROM steps GROUP BY 1", "steps")
def a08_distinct_agents(spark, base):
    return steps(spark, base).groupBy("event_type").agg(F.count_distinct(F.when(F.col("agent") != "", F.col("agent"))).alias("agents"))


@R.add("SELECT day, count(DISTINCT root) AS roots FROM steps GROUP BY 1", "steps")
def a09_distinct_roots(spark, base):
    return steps(spark, base).groupBy("day").agg(F.count_distinct("root").alias("roots"))


@R.add("""WITH g AS (SELECT root, count(*) AS n, CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures, round(avg(d), 3) AS avg_ms FROM steps GROUP BY 1 ORDER BY n DESC, root LIMIT 25)
SELECT *, (SELECT count(*) FROM g) > 24 AS truncated FROM g ORDER BY n DESC, root LIMIT 24""", "steps")
def a10_routes(spark, base):
    """The 24 busiest roots, and whether there are more."""
    g = steps(spark, base).groupBy("root").agg(n_of().alias("n"), n_of(F.col("success") == 0).alias("failures"), F.round(F.avg("d"), 3).alias("avg_ms"))
    page = g.orderBy(F.desc("n"), "root").limit(25)
    return page.withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy()) > 24).orderBy(F.desc("n"), "root").limit(24)


@R.add("SELECT event_type, error_type, count(*) AS n FROM steps WHERE error_type <> '' GROUP BY 1, 2", "steps")
def a11_error_reasons(spark, base):
    return steps(spark, base).where("error_type <> ''").groupBy("event_type", "error_type").agg(n_of().alias("n"))


@R.add("""SELECT activity, CAST(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN success = 0 AND error_type <> '' THEN 1 ELSE 0 END) AS BIGINT) AS bad,
  CAST(sum(CASE WHEN success = 0 AND error_type = '' THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM steps GROUP BY 1""", "steps")  # fmt: skip
def a12_tri_state(spark, base):
    ok, err = F.col("success") == 1, F.col("error_type") != ""
    return steps(spark, base).groupBy("activity").agg(n_of(ok).alias("good"), n_of(~ok & err).alias("bad"), n_of(~ok & ~err).alias("unknown"))


@R.add("""WITH a AS (SELECT q FROM steps WHERE q > 0 ORDER BY us DESC, id DESC LIMIT 1000), r AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM a)
SELECT count(*) AS n, round(avg(q), 3) AS avg_wait, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN q END), 1) AS p95, round(max(q), 3) AS max_wait FROM r""", "steps")
def a13_queue_ages(spark, base):
    """Over the last 1000 waits above 0 (the limit is the feature)."""
    a = steps(spark, base).where("q > 0").orderBy(F.desc("us"), F.desc("id")).limit(1000).withColumn("k", F.lit(1))
    p = stats.ranked_percentiles(a, ["k"], "q", {"p95": 0.95})
    return a.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 3).alias("avg_wait"), F.round(F.max("q"), 3).alias("max_wait")).join(p.drop("n"), "k").drop("k")


@R.add("SELECT activity, event_type, model, count(*) AS n, CAST(sum(tin + tout) AS BIGINT) AS tokens FROM steps GROUP BY 1, 2, 3 ORDER BY n DESC, activity, event_type, model LIMIT 50", "steps")
def a14_usage_groups(spark, base):
    g = steps(spark, base).groupBy("activity", "event_type", "model").agg(n_of().alias("n"), F.sum(F.col("tin") + F.col("tout")).alias("tokens"))
    return g.orderBy(F.desc("n"), "activity", "event_type", "model").limit(50)


FINGERPRINT_SQL = "substr(sha256(lower(error_type) || '|' || activity || '|' || lower(event_type)), 1, 16)"


@R.add(f"SELECT {FINGERPRINT_SQL} AS fingerprint, error_type, activity, event_type, count(*) AS n, max(us) AS last_us FROM steps WHERE error_type <> '' GROUP BY 1, 2, 3, 4", "steps")
def a15_error_fingerprints(spark, base):
    s = steps(spark, base).where("error_type <> ''")
    mark = F.substring(F.sha2(F.concat_ws("|", F.lower("error_type"), "activity", F.lower("event_type")), 256), 1, 16)
    return s.groupBy(mark.alias("fingerprint"), "error_type", "activity", "event_type").agg(n_of().alias("n"), F.max("us").alias("last_us"))


@R.add("SELECT count(*) AS n_groups FROM (SELECT DISTINCT activity, event_type, error_type FROM steps WHERE error_type <> '')", "steps")
def a16_count_of_groups(spark, base):
    return steps(spark, base).where("error_type <> ''").select("activity", "event_type", "error_type").distinct().agg(n_of().alias("n_groups"))


ROLLUP_KEYS = ["day", "event_type", "activity", "agent", "model", "success"]
ROLLUP_SQL = """SELECT day, event_type, activity, agent, model, success, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tin, CAST(sum(tout) AS BIGINT) AS tout, CAST(sum(cache_hit) AS BIGINT) AS hits,
  CAST(sum(CAST(floor(coalesce(d, 0) * 1000) AS BIGINT)) AS BIGINT) AS d_us FROM steps GROUP BY ALL"""


def rollup(s: DataFrame) -> DataFrame:
    """Additive daily sums; unions of rollups are summed again with ``merge_rollups``."""
    d_us = F.floor(F.coalesce("d", F.lit(0.0)) * 1000).cast("long")
    return s.groupBy(*ROLLUP_KEYS).agg(n_of().alias("n"), F.sum("tin").alias("tin"), F.sum("tout").alias("tout"), F.sum("cache_hit").alias("hits"), F.sum(d_us).alias("d_us"))


def merge_rollups(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "tin", "tout", "hits", "d_us")])


@R.add(ROLLUP_SQL, "steps")
def a17_daily_rollup(spark, base):
    """Rolled up in two halves and merged, as separate runs would."""
    s = steps(spark, base)
    return merge_rollups(rollup(s.where("id % 2 = 0")).unionByName(rollup(s.where("id % 2 <> 0"))))


@R.add(f"SELECT activity, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tin FROM steps WHERE us >= {CUTOFF + DAY // 2} GROUP BY 1", "steps")
def a18_rollup_and_boundary(spark, base):
    """Whole days from the rollup, the part of the first day from the rows; no row counts twice."""
    s = steps(spark, base)
    first = F.date_format(F.timestamp_micros(F.lit(CUTOFF)), "yyyy-MM-dd")
    whole = rollup(s).where(F.col("day") > first).groupBy("activity").agg(F.sum("n").alias("n"), F.sum("tin").alias("tin"))
    part = s.where((F.col("us") >= CUTOFF + DAY // 2) & (F.col("day") == first)).groupBy("activity").agg(n_of().alias("n"), F.sum("tin").alias("tin"))
    return whole.unionByName(part).groupBy("activity").agg(F.sum("n").alias("n"), F.sum("tin").alias("tin"))


@R.add("""SELECT day, CAST(sum(CASE WHEN activity LIKE '%search%' THEN tin ELSE 0 END) AS BIGINT) AS discovery, CAST(sum(CASE WHEN event_type = 'inference' THEN tin ELSE 0 END) AS BIGINT) AS inference,
  CAST(sum(CASE WHEN event_type = 'maintenance' THEN tin ELSE 0 END) AS BIGINT) AS system FROM steps GROUP BY 1""", "steps")  # fmt: skip
def a19_category_rollup(spark, base):
    part = lambda c: F.sum(F.when(c, F.col("tin")).otherwise(0))
    return steps(spark, base).groupBy("day").agg(part(F.col("activity").contains("search")).alias("discovery"), part(F.col("event_type") == "inference").alias("inference"), part(F.col("event_type") == "maintenance").alias("system"))


@R.add("SELECT side, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT 'input' AS side, tin AS tokens FROM steps UNION ALL SELECT 'output', tout FROM steps) GROUP BY 1", "steps")
def a20_tokens_by_side(spark, base):
    s = steps(spark, base).select("tin", "tout").unpivot([], ["tin", "tout"], "c", "tokens")
    return s.groupBy(F.when(F.col("c") == "tin", "input").otherwise("output").alias("side")).agg(F.sum("tokens").alias("tokens"))


@R.add("""WITH g AS (SELECT day, event_type, count(*) AS n FROM steps GROUP BY 1, 2)
SELECT day, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS r FROM g) WHERE r = 1""", "steps")
def a22_leading_type_per_day(spark, base):
    g = steps(spark, base).groupBy("day", "event_type").agg(n_of().alias("n"))
    return stats.latest(g, ["day"], [F.desc("n"), F.col("event_type")])


def _percentiles_sql(key: str, col: str) -> str:
    return f"""WITH r AS (SELECT {key} AS k, {col} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {col}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM steps WHERE {col} IS NOT NULL)
SELECT k AS {key}, max(n) AS n, round((max(CASE WHEN i = (n - 1) // 2 THEN v END) + max(CASE WHEN i = n // 2 THEN v END)) / 2, 1) AS p50,
  round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN v END), 1) AS p95, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.99, 0) AS BIGINT) THEN v END), 1) AS p99 FROM r GROUP BY 1"""


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@R.add(_percentiles_sql("activity", "d"), "steps")
def a23_exact_percentiles(spark, base):
    return stats.ranked_percentiles(steps(spark, base), ["activity"], "d", SHARES)


@R.add(
    f"""WITH p AS ({_percentiles_sql("activity", "d")}), g AS (SELECT activity, count(*) AS events, round(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) * 1.0 / count(*), 4) AS failure_rate FROM steps GROUP BY 1)
SELECT substr(CASE WHEN g.activity = '' THEN 'uncategorized' ELSE g.activity END, 1, 160) AS activity, events, failure_rate, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99 FROM g LEFT JOIN p USING (activity)""",
    "steps",
)
def a24_tail_latency(spark, base):
    """Events, failure rate and latency percentiles of each activity; 0 where nothing was measured."""
    s = steps(spark, base)
    g = s.groupBy("activity").agg(n_of().alias("events"), F.round(n_of(F.col("success") == 0) / n_of(), 4).alias("failure_rate"))
    p = stats.ranked_percentiles(s, ["activity"], "d", SHARES).drop("n")
    name = F.substring(F.coalesce(F.nullif("activity", F.lit("")), F.lit("uncategorized")), 1, 160)
    return g.join(p, "activity", "left").select(name.alias("activity"), "events", "failure_rate", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SHARES]).orderBy(F.desc("p99"), F.desc("events"), "activity")


COHORTS = ("inference", "unavailable", "failed", "tool", "internal", "external")


@R.add(f"""SELECT c.cohort, coalesce(n, 0) AS n, coalesce(failures, 0) AS failures FROM (SELECT unnest({list(COHORTS)}) AS cohort) c
LEFT JOIN (SELECT {COHORT_SQL} AS cohort, count(*) AS n, CAST(sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM steps GROUP BY 1) g USING (cohort)""", "steps")
def a25_cohort_summary(spark, base):
    """Every cohort, those without rows too."""
    g = steps(spark, base).groupBy(cohort().alias("cohort")).agg(n_of().alias("n"), n_of(F.col("success") == 0).alias("failures"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, COHORTS))).alias("cohort"))
    return names.join(g, "cohort", "left").na.fill(0, ["n", "failures"])


BUCKET_SQL = "CASE " + " ".join(f"WHEN d < {b} THEN {i}" for i, b in enumerate(stats.LATENCY_BOUNDS)) + f" ELSE {len(stats.LATENCY_BOUNDS)} END"
HIST_COLS = ", ".join(f"CAST(sum(CASE WHEN b = {i} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}" for i in range(14))


def _hist_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS calls, {HIST_COLS} FROM (SELECT *, {BUCKET_SQL} AS b FROM steps WHERE d IS NOT NULL) GROUP BY 1"


@R.add(_hist_sql("activity"), "steps")
def a26_latency_histogram(spark, base):
    return stats.latency_histogram(steps(spark, base), ["activity"], "d")


def _hist_p_sql(share: float) -> str:
    low, high, before, out = [0, *stats.LATENCY_BOUNDS], [*stats.LATENCY_BOUNDS, stats.LATENCY_TOP], "0", []
    for i in range(14):
        out.append(f"WHEN b{i} > 0 AND {before} + b{i} >= {share} * calls THEN {low[i]} + ({share} * calls - ({before})) / b{i} * {high[i] - low[i]}")
        before += f" + b{i}"
    return "round(CASE " + " ".join(out) + " END, 1)"


@R.add(f"SELECT activity, calls, {_hist_p_sql(0.5)} AS p50, {_hist_p_sql(0.95)} AS p95, {_hist_p_sql(0.99)} AS p99 FROM ({_hist_sql('activity')})", "steps")
def a27_histogram_percentiles(spark, base):
    h = stats.latency_histogram(steps(spark, base), ["activity"], "d")
    return h.select("activity", "calls", *[stats.histogram_percentile(s).alias(c) for c, s in SHARES.items()])


@R.add(_hist_sql("activity"), "steps")
def a28_merged_histograms(spark, base):
    """Histograms of each root, added up over the roots."""
    h = stats.latency_histogram(steps(spark, base), ["activity", "root"], "d")
    return h.groupBy("activity").agg(*[F.sum(c).alias(c) for c in ("calls", *[f"b{i}" for i in range(14)])])


@R.add(f"""WITH h AS ({_hist_sql("activity")}), g AS (SELECT activity, count(*) AS total, sum(success) AS ok FROM steps GROUP BY 1)
SELECT activity, total AS calls, round(ok * 100.0 / total, 1) AS success_rate, CASE WHEN round(ok * 100.0 / total, 1) < 97 THEN 'failing' WHEN {_hist_p_sql(0.95)} >= 1000 THEN 'slow' ELSE 'active' END AS status
FROM g LEFT JOIN h USING (activity)""", "steps")
def a29_endpoint_health(spark, base):
    s = steps(spark, base)
    g = s.groupBy("activity").agg(n_of().alias("total"), F.round(F.sum("success") * 100 / n_of(), 1).alias("success_rate"))
    h = stats.latency_histogram(s, ["activity"], "d")
    status = F.when(F.col("success_rate") < 97, "failing").when(stats.histogram_percentile(0.95) >= 1000, "slow").otherwise("active")
    return g.join(h, "activity", "left").select("activity", F.col("total").alias("calls"), "success_rate", status.alias("status"))


@R.add("""SELECT day, activity, CASE WHEN d IS NULL THEN 'none' WHEN floor(d) <= 50 THEN '<=50' WHEN floor(d) <= 250 THEN '<=250' WHEN floor(d) <= 500 THEN '<=500' WHEN floor(d) <= 2000 THEN '<=2000' ELSE '>2000' END AS bucket,
count(*) AS n FROM steps GROUP BY 1, 2, 3""", "steps")
def a30_daily_buckets(spark, base):
    f = F.floor("d")
    label = F.when(F.col("d").isNull(), "none").when(f <= 50, "<=50").when(f <= 250, "<=250").when(f <= 500, "<=500").when(f <= 2000, "<=2000").otherwise(">2000")
    return steps(spark, base).groupBy("day", "activity", label.alias("bucket")).agg(n_of().alias("n"))


@R.add("""WITH b AS (SELECT min(us // 86400000000) AS a, max(us // 86400000000) AS z FROM steps), days AS (SELECT unnest(range(a, z + 1)) AS dn FROM b)
SELECT strftime(make_timestamp(dn * 86400000000), '%Y-%m-%d') AS day, CAST(coalesce(sum(CASE WHEN success = 1 THEN 1 END), 0) AS BIGINT) AS good, CAST(coalesce(sum(CASE WHEN success = 0 THEN 1 END), 0) AS BIGINT) AS bad
FROM days LEFT JOIN (SELECT us // 86400000000 AS dn, success FROM steps WHERE error_type <> '' OR event_type = 'search') s USING (dn) GROUP BY 1""", "steps")
def a31_dense_days(spark, base):
    """A row for every day of the span, with zeros where nothing happened."""
    s = steps(spark, base).withColumn("dn", F.floor(F.col("us") / DAY))
    days = s.agg(F.min("dn").alias("a"), F.max("dn").alias("z")).select(F.explode(F.sequence("a", "z")).alias("dn"))
    part = s.where((F.col("error_type") != "") | (F.col("event_type") == "search")).groupBy("dn").agg(n_of(F.col("success") == 1).alias("good"), n_of(F.col("success") == 0).alias("bad"))
    return days.join(part, "dn", "left").na.fill(0).select(F.date_format(F.timestamp_micros(F.col("dn") * DAY), "yyyy-MM-dd").alias("day"), "good", "bad")


@R.add("SELECT root, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM steps GROUP BY 1", "steps")
def a34_span_per_stream(spark, base):
    return steps(spark, base).groupBy("root").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), n_of().alias("n"))


# --- windows -----------------------------------------------------------------------------------------------------------
@R.add("SELECT root, activity, id, n FROM (SELECT root, activity, id, row_number() OVER (PARTITION BY root, activity ORDER BY us DESC, id DESC) AS r, count(*) OVER (PARTITION BY root) AS n FROM steps WHERE error_type <> '') WHERE r = 1", "steps")
def w03_two_partitions(spark, base):
    """The latest failure of each root and activity, with the failures of the whole root."""
    s = steps(spark, base).where("error_type <> ''").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("root")))
    return stats.latest(s, ["root", "activity"], [F.desc("us"), F.desc("id")]).select("root", "activity", "id", "n")


@R.add("SELECT agent, event_type, id AS last_id, success FROM (SELECT *, row_number() OVER (PARTITION BY agent, event_type ORDER BY us DESC, id DESC) AS r FROM steps) WHERE r = 1", "steps")
def w05_latest_per_agent(spark, base):
    return stats.latest(steps(spark, base), ["agent", "event_type"], [F.desc("us"), F.desc("id")]).select("agent", "event_type", F.col("id").alias("last_id"), "success")


@R.add("SELECT root, b + 1 AS gap_start, id - 1 AS gap_end FROM (SELECT root, id, lag(id) OVER (PARTITION BY root ORDER BY id) AS b FROM steps) WHERE id > b + 1", "steps")
def w06_sequence_gaps(spark, base):
    return stats.gaps(steps(spark, base), ["root"], "id")


@R.add("""SELECT id, round(s * 1.0 / c, 4) AS rate FROM (SELECT id, sum(success) OVER w AS s, count(*) OVER w AS c FROM steps WINDOW w AS (PARTITION BY activity ORDER BY us, id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) WHERE c >= 10""", "steps")
def w10_last_64_rate(spark, base):
    w = W.partitionBy("activity").orderBy("us", "id").rowsBetween(-63, 0)
    s = steps(spark, base).withColumns({"s": F.sum("success").over(w), "c": F.count(F.lit(1)).over(w)})
    return s.where("c >= 10").select("id", F.round(F.col("s") / F.col("c"), 4).alias("rate"))


@R.add("SELECT id, CAST(sum(tin + tout) OVER (PARTITION BY root ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens FROM steps", "steps")
def w11_rolling_hour(spark, base):
    w = W.partitionBy("root").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return steps(spark, base).select("id", F.sum(F.col("tin") + F.col("tout")).over(w).alias("tokens"))


# --- pages ---------------------------------------------------------------------------------------------------------------
@R.add("SELECT activity, model, count(*) AS n FROM steps GROUP BY 1, 2 ORDER BY n DESC, activity, model LIMIT 20 OFFSET 10", "steps")
def l03_offset_page(spark, base):
    return steps(spark, base).groupBy("activity", "model").agg(n_of().alias("n")).orderBy(F.desc("n"), "activity", "model").offset(10).limit(20)


@R.add("SELECT activity, error_type, agent, count(*) AS n FROM steps WHERE error_type <> '' AND (activity, error_type, agent) > ('command_run', 'timeout', 'coder') GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 25", "steps")
def l04_keyset_page(spark, base):
    """The page after a composite key."""
    after = F.struct("activity", "error_type", "agent") > F.struct(F.lit("command_run").alias("activity"), F.lit("timeout").alias("error_type"), F.lit("coder").alias("agent"))
    g = steps(spark, base).where((F.col("error_type") != "") & after).groupBy("activity", "error_type", "agent").agg(n_of().alias("n"))
    return g.orderBy("activity", "error_type", "agent").limit(25)


@R.add("SELECT * FROM (SELECT id, activity FROM steps WHERE id < 500 ORDER BY id DESC LIMIT 50) ORDER BY id", "steps")
def l06_timeline_page(spark, base):
    """The 50 rows before an id, in order of time."""
    return steps(spark, base).where("id < 500").orderBy(F.desc("id")).limit(50).orderBy("id").select("id", "activity")


@R.add("SELECT * FROM (SELECT 'forward' AS way, id FROM steps WHERE id > 500 ORDER BY id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'backward', id FROM steps WHERE id < 500 ORDER BY id DESC LIMIT 20)", "steps")
def l07_both_ways(spark, base):
    s = steps(spark, base).select("id")
    forward = s.where("id > 500").orderBy("id").limit(20).select(F.lit("forward").alias("way"), "id")
    return forward.unionByName(s.where("id < 500").orderBy(F.desc("id")).limit(20).select(F.lit("backward").alias("way"), "id"))


@R.add("SELECT id, count(*) OVER () AS total FROM steps WHERE error_type = 'timeout' ORDER BY id LIMIT 30", "steps")
def l09_slice_and_total(spark, base):
    """A page with the number of all rows; the count is an aggregate of its own, joined as a one-row side."""
    s = steps(spark, base).where("error_type = 'timeout'").select("id")
    return s.orderBy("id").limit(30).crossJoin(F.broadcast(s.agg(n_of().alias("total"))))  # a page and one row


@R.add("SELECT id, b FROM (SELECT id, sum(length(activity) + length(root) + 24) OVER (ORDER BY id) AS b FROM (SELECT * FROM steps WHERE id > 100 ORDER BY id LIMIT 2000)) WHERE b <= 20000", "steps")
def l15_byte_budget(spark, base):
    """Rows of a page until their size exceeds a budget."""
    page = steps(spark, base).where("id > 100").orderBy("id").limit(2000).withColumn("g", F.lit(1))
    run = F.sum(F.length("activity") + F.length("root") + 24).over(W.partitionBy("g").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return page.withColumn("b", run.cast("long")).where("b <= 20000").select("id", "b")


# --- sets ------------------------------------------------------------------------------------------------------------------
@R.add("SELECT activity AS name FROM steps UNION SELECT model FROM steps", "steps")
def u01_union_distinct(spark, base):
    s = steps(spark, base)
    return s.select(F.col("activity").alias("name")).union(s.select("model")).distinct()


@R.add("SELECT 'in' AS side, id, tin AS tokens FROM steps UNION ALL SELECT 'out', id, tout FROM steps", "steps")
def u02_union_all(spark, base):
    s = steps(spark, base)
    side = lambda n, c: s.select(F.lit(n).alias("side"), "id", F.col(c).alias("tokens"))
    return side("in", "tin").unionByName(side("out", "tout"))


@R.add("SELECT DISTINCT root, agent FROM steps", "steps")
def u03_distinct(spark, base):
    return steps(spark, base).select("root", "agent").distinct()


@R.add("SELECT 'both' AS part, root FROM (SELECT root FROM steps WHERE event_type = 'search' INTERSECT SELECT root FROM steps WHERE error_type = 'cancelled') UNION ALL SELECT 'first', root FROM (SELECT root FROM steps WHERE event_type = 'search' EXCEPT SELECT root FROM steps WHERE error_type = 'cancelled')", "steps")
def u04_intersect_and_difference(spark, base):
    s = steps(spark, base)
    a, b = s.where("event_type = 'search'").select("root"), s.where("error_type = 'cancelled'").select("root")
    return a.intersect(b).select(F.lit("both").alias("part"), "root").unionByName(a.subtract(b).select(F.lit("first").alias("part"), "root"))


QUERIES, ORACLE = R.queries, R.sql
