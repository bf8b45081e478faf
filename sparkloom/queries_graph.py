"""Graphs, code facts, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import code
from sparkloom.operators import graph, stats
from sparkloom.plans.registry import Registry
from sparkloom.sources import files
from sparkloom.sources.tables import table
from sparkloom.streaming import event_log as L

#: Edges between suppliers and customers' nations by the parts they trade: a graph of a few hundred nodes in the star schema.
EDGES_SQL = "SELECT DISTINCT l_suppkey AS src, l_partkey % 200 + 1000 AS dst FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45"
FOREST_SQL = "SELECT DISTINCT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_suppkey % 7 <> 0"
R = Registry(e=EDGES_SQL, f=FOREST_SQL)


def edges(spark: SparkSession, base: str) -> DataFrame:
    l = table(spark, base, "lineitem").where("l_linenumber = 1 AND l_quantity > 45")
    return l.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200 + 1000).alias("dst")).distinct()


def forest(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "supplier").where("s_suppkey % 7 <> 0")
    return s.select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 3").alias("dst")).distinct()


@R.add("""WITH RECURSIVE both_ways AS (SELECT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f), w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN both_ways ON a = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""".replace("WITH RECURSIVE both_ways", "WITH RECURSIVE f AS (" + FOREST_SQL + "), both_ways"))
def g01_bounded_traversal(spark, base):
    """Nodes within three steps of node 1, along edges in both directions."""
    f = forest(spark, base)
    both = f.unionByName(f.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return graph.reach(both, spark.range(1, 2).select(F.col("id").alias("node")), 3)


@R.add("SELECT 'out' AS way, dst AS node FROM e WHERE src = 1 UNION SELECT 'in', src FROM e WHERE dst = 1001", "e")
def g02_neighbours(spark, base):
    e = edges(spark, base)
    return e.where("src = 1").select(F.lit("out").alias("way"), F.col("dst").alias("node")).unionByName(e.where("dst = 1001").select(F.lit("in").alias("way"), F.col("src").alias("node"))).distinct()


@R.add("""WITH RECURSIVE f AS (""" + FOREST_SQL + """), w AS (SELECT src AS node FROM f WHERE src % 5 = 0 UNION SELECT f.dst FROM w JOIN f ON f.src = w.node) SELECT DISTINCT src AS node FROM f WHERE src NOT IN (SELECT node FROM w)""")
def g03_unreached(spark, base):
    """Nodes that no entry point (those divisible by 5) leads to."""
    f = forest(spark, base)
    seen = graph.reach(f, f.where("src % 5 = 0").select(F.col("src").alias("node")), 64)
    return f.select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti")


NATIONS = "SELECT DISTINCT n1.n_regionkey AS src, (n1.n_nationkey * 3) % 5 AS dst FROM nation n1 WHERE n1.n_nationkey % 2 = 0"


@R.add(f"""WITH RECURSIVE n AS ({NATIONS}), w AS (SELECT [src, dst] AS path FROM n WHERE src < dst UNION ALL SELECT list_append(path, n.dst) FROM w JOIN n ON n.src = path[len(path)] WHERE n.dst > path[1] AND NOT list_contains(path, n.dst) AND len(path) < 4)
SELECT array_to_string(path, '>') AS path FROM w JOIN n ON n.src = path[len(path)] AND n.dst = path[1]""")
def g04_cycles(spark, base):
    """Cycles of at most four nodes, each once."""
    n = table(spark, base, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("src"), ((F.col("n_nationkey") * 3) % 5).alias("dst"))
    return graph.cycles(n, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@R.add("""WITH w AS (SELECT src, dst, 0.5 + (src % 4) * 0.125 AS weight FROM f), one AS (SELECT dst AS node, max(weight) AS s FROM w WHERE src IN (30, 31, 32) GROUP BY 1), two AS (SELECT w.dst AS node, max(s * weight * 0.5) AS s FROM one JOIN w ON w.src = one.node GROUP BY 1)
SELECT node, round(CAST(max(s) AS DOUBLE), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE node NOT IN (30, 31, 32) GROUP BY 1""", "f")
def g05_two_hops(spark, base):
    w = forest(spark, base).withColumn("weight", 0.5 + (F.col("src") % 4) * 0.125)
    return graph.two_hops(w, spark.range(30, 33).select(F.col("id").alias("node")))


@R.add("SELECT dst AS node, count(DISTINCT src) AS n FROM e GROUP BY 1", "e")
def g06_in_degree(spark, base):
    return edges(spark, base).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("n"))


@R.add("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM e)", "e")
def g07_unreferenced(spark, base):
    return table(spark, base, "supplier").select("s_suppkey").join(edges(spark, base).select(F.col("src").alias("s_suppkey")), "s_suppkey", "left_anti")


@R.add("SELECT DISTINCT e.src, e.dst FROM e JOIN part p ON p.p_partkey = e.dst WHERE p.p_size > 25", "e")
def g08_callers_of_changed(spark, base):
    p = table(spark, base, "part").where("p_size > 25").select(F.col("p_partkey").alias("dst"))
    return edges(spark, base).join(p, "dst").select("src", "dst")


@R.add("""WITH RECURSIVE f AS (""" + FOREST_SQL + """), b AS (SELECT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f), w AS (SELECT a AS node, a AS seen FROM b UNION SELECT w.node, b.b FROM w JOIN b ON b.a = w.seen)
SELECT node, min(seen) AS component FROM w GROUP BY 1""")
def g09_components(spark, base):
    f = forest(spark, base)
    nodes = f.select(F.col("src").alias("node")).union(f.select("dst")).distinct()
    return graph.components(f.select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes)


@R.add("""WITH RECURSIVE f AS (""" + FOREST_SQL + """ AND s_suppkey // 3 <> s_suppkey), w AS (SELECT src AS node, 0 AS layer FROM f WHERE src NOT IN (SELECT dst FROM f) UNION SELECT f.dst, layer + 1 FROM w JOIN f ON f.src = w.node WHERE layer < 64)
SELECT node, max(layer) AS layer FROM w GROUP BY 1""")
def g10_layers(spark, base):
    """The longest way to each node from a node without incoming edges."""
    return graph.layers(forest(spark, base).where("src <> dst"))


# --- code facts ----------------------------------------------------------------------------------------------------------
def python_texts(spark, base):
    return table(spark, base, "evidence").where("path LIKE '%.py' AND text IS NOT NULL").select("id", "text").dropDuplicates(["id"])


_LINES = r"(SELECT id, i AS line, string_split(text, chr(10))[i] AS t FROM (SELECT DISTINCT id, text FROM evidence WHERE path LIKE '%.py' AND text IS NOT NULL), unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))"


@R.add(rf"SELECT id, regexp_extract(t, '^(\s*)(?:export\s+)?(?:async\s+)?(def|class|function|const)\s+([A-Za-z_]\w*)', 2) AS kind, regexp_extract(t, '^(\s*)(?:export\s+)?(?:async\s+)?(def|class|function|const)\s+([A-Za-z_]\w*)', 3) AS name, line FROM {_LINES} WHERE regexp_matches(t, '^(\s*)(?:export\s+)?(?:async\s+)?(def|class|function|const)\s+([A-Za-z_]\w*)')")
def k01_symbols(spark, base):
    return code.table_function(python_texts(spark, base), "id", "text", "kind string, name string, line long, indent long", code.symbols).drop("indent")


@R.add()
def k02_python_relations(spark, base):
    return code.table_function(python_texts(spark, base), "id", "text", "caller string, callee string, line long", code.relations)


@R.add(rf"SELECT id, count(*) AS n_lines, CAST(sum(CASE WHEN regexp_matches(t, '^\s*(import|from)\s') THEN 1 ELSE 0 END) AS BIGINT) AS imports, CAST(sum(CASE WHEN regexp_matches(t, '^\s*#') THEN 1 ELSE 0 END) AS BIGINT) AS comments FROM {_LINES} GROUP BY 1")
def k03_source_facts(spark, base):
    l = python_texts(spark, base).select("id", F.explode(F.split("text", "\n")).alias("t"))
    n = lambda rx: F.count(F.when(F.col("t").rlike(rx), 1))
    return l.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), n(r"^\s*(import|from)\s").alias("imports"), n(r"^\s*#").alias("comments"))


@R.add(r"SELECT id, i AS line, regexp_extract(t, '^([A-Za-z_][\w-]*):', 1) AS key FROM (SELECT id, i, string_split(text, chr(10))[i] AS t FROM (SELECT DISTINCT id, text FROM evidence WHERE path LIKE '%.yaml' AND text IS NOT NULL), unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)) WHERE regexp_matches(t, '^([A-Za-z_][\w-]*):')")
def k04_infra_keys(spark, base):
    """Top keys of YAML texts with their lines."""
    y = table(spark, base, "evidence").where("path LIKE '%.yaml' AND text IS NOT NULL").select("id", "text").dropDuplicates(["id"]).select("id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    key = F.regexp_extract("t", r"^([A-Za-z_][\w-]*):", 1)
    return y.where(key != "").select("id", (F.col("i") + 1).cast("long").alias("line"), key.alias("key"))


@R.add()
def k06_complexity(spark, base):
    return code.table_function(python_texts(spark, base), "id", "text", "function string, line long, cyclomatic long, cognitive long, risk string", code.complexity)


@R.add("SELECT CASE WHEN path LIKE '%.md' THEN 'docs' WHEN regexp_matches(path, '\\.(yaml|toml|json|env|xml)$') THEN 'config' WHEN contains(path, 'test') THEN 'tests' WHEN path LIKE 'src/%' THEN 'core' ELSE 'other' END AS cluster, count(DISTINCT path) AS n FROM evidence GROUP BY 1")
def k13_change_clusters(spark, base):
    p = F.col("path")
    c = F.when(p.endswith(".md"), "docs").when(p.rlike(r"\.(yaml|toml|json|env|xml)$"), "config").when(p.contains("test"), "tests").when(p.startswith("src/"), "core").otherwise("other")
    return table(spark, base, "evidence").groupBy(c.alias("cluster")).agg(F.count_distinct("path").alias("n"))


# --- event log -------------------------------------------------------------------------------------------------------------
EVENTS = "SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events"
R.views["ev"] = EVENTS


def log(spark, base):
    e = table(spark, base, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"), "value")
    return L.sequence(e, "user_id", [F.col("us"), F.col("event_id")])


@R.add("SELECT DISTINCT event_id FROM events")
def t01_append_once(spark, base):
    """A stream in which every event comes once, whatever is delivered twice."""
    s = L.read(spark, base, "events").select("event_id", "ts")
    return L.drain(L.append_once(s, ["event_id"], "ts", "1 hour").select("event_id"), "append")


@R.add("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM ev", "ev")
def t02_sequences(spark, base):
    return log(spark, base).select("event_id", "user_id", "seq")


@R.add("SELECT event_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM ev) WHERE user_id = 3 AND seq > 20 AND seq <= 90 ORDER BY seq LIMIT 50", "ev")
def t03_replay_page(spark, base):
    return L.page(log(spark, base).where("user_id = 3"), 20, 90, 50).select("event_id", "seq")


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def t04_bounded_replay(spark, base):
    """A stream over what is there when it starts, counted."""
    s = L.read(spark, base, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return L.latest_updates(L.drain(s, "update"), ["event_type"])


@R.add("SELECT event_id FROM ev WHERE event_type = 'purchase' AND us > 1704100000000000 ORDER BY us, event_id LIMIT 1000", "ev")
def t06_topic_poll(spark, base):
    return log(spark, base).where("event_type = 'purchase' AND us > 1704100000000000").orderBy("us", "event_id").limit(1000).select("event_id")


@R.add("SELECT event_id FROM ev WHERE us >= (SELECT max(us) FROM ev) - 432000000000", "ev")
def t08_age_eviction(spark, base):
    e = log(spark, base)
    return e.crossJoin(F.broadcast(e.agg((F.max("us") - 432_000_000_000).alias("cut")))).where("us >= cut").select("event_id")  # one row


@R.add("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM ev) SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN us >= 1706000000000000 THEN seq END) OVER (PARTITION BY user_id) AS f FROM s) WHERE seq >= f""", "ev")
def t09_retention(spark, base):
    return L.retained(log(spark, base), "user_id", F.col("us"), F.lit(1_706_000_000_000_000)).select("user_id", "event_id")


@R.add("SELECT user_id, max(us) AS us, max_by(event_type, struct_pack(u := us, e := event_id)) AS last_type FROM ev GROUP BY 1", "ev")
def t10_snapshots(spark, base):
    return log(spark, base).groupBy("user_id").agg(F.max("us").alias("us"), F.max_by("event_type", F.struct("us", "event_id")).alias("last_type"))


@R.add("SELECT event_id FROM events WHERE event_id > 500 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def t11_delta(spark, base):
    """What is new after a point and isn't there yet."""
    e = table(spark, base, "events").select("event_id")
    return e.where("event_id > 500").join(e.where("event_id % 3 = 0"), "event_id", "left_anti")


@R.add("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t13_streaming_rollup(spark, base):
    """A daily rollup kept up to date by a stream."""
    s = L.read(spark, base, "events").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    s = s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
    return L.latest_updates(L.drain(s, "update"), ["day", "event_type"])


@R.add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 3 AS over FROM ev", "ev")
def t15_rolling_quota(spark, base):
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return log(spark, base).select("event_id", (F.count(F.lit(1)).over(w) > 3).alias("over"))


@R.add("""WITH s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 60000000 THEN 1 ELSE 0 END AS close FROM ev) SELECT event_id FROM s WHERE close = 0""", "ev")
def t17_cooldown(spark, base):
    """Events that come a minute or more after the one before."""
    gap = F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("us", "event_id"))
    return log(spark, base).withColumn("gap", gap).where("gap IS NULL OR gap >= 60000000").select("event_id")


@R.add("""WITH s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 1800000000 THEN 0 ELSE 1 END AS f FROM ev), n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM s)
SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM n GROUP BY user_id, no""", "ev")
def t18_sessions(spark, base):
    """Sessions of a user: events at most half an hour apart."""
    return stats.islands(log(spark, base).withColumn("us2", F.col("us")), ["user_id"], "us", "us2", 1_800_000_000).select("user_id", F.col("start").alias("first_us"), F.col("end").alias("last_us"), "n")


# --- sources and sinks --------------------------------------------------------------------------------------------------------
@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 100")
def s05_read_only_sql(spark, base):
    """A SELECT given as text, over views of the tables, held to 100 rows (its feature)."""
    return files.read_only_sql(spark, base, ["events"], "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type")


@R.add("SELECT count(*) AS n, CAST(sum(CASE WHEN starts_with(split_name, 'train') THEN 1 ELSE 0 END) AS BIGINT) AS train FROM laya_dataset_assignments")
def s08_jsonl_round_trip(spark, base):
    """Rows written as JSON lines and read again with their schema."""
    a = files.json_lines_round_trip(table(spark, base, "laya_dataset_assignments"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split_name").startswith("train"), 1)).alias("train"))


@R.add("SELECT DISTINCT candidate_id, group_id FROM laya_dataset_assignments WHERE split_name = 'train'")
def s11_merged_archives(spark, base):
    """Training rows of several sources, each once."""
    a = table(spark, base, "laya_dataset_assignments").select("snapshot_id", "candidate_id", "group_id", "split_name")
    parts = [a.where(F.crc32("snapshot_id") % 3 == i) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("split_name = 'train'").select("candidate_id", "group_id").distinct()


@R.add("SELECT artifact_id, i AS page, substr(text, CAST(i * 4000 + 1 AS BIGINT), 4000) AS slice FROM (SELECT DISTINCT artifact_id, text FROM artifacts WHERE length(text) > 0), unnest(range(0, (length(text) + 3999) // 4000)) AS t(i)")
def s19_artifact_slices(spark, base):
    a = table(spark, base, "artifacts").where("length(text) > 0").select("artifact_id", "text").distinct()
    n = F.ceil(F.length("text") / 4000).cast("long")
    return a.select("artifact_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("page")).select("artifact_id", "page", F.expr("substring(text, int(page * 4000 + 1), 4000)").alias("slice"))


@R.add("SELECT 'INSERT INTO nation VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')' AS statement FROM nation")
def s21_insert_statements(spark, base):
    return files.insert_statements(table(spark, base, "nation"), "nation")


@R.add("SELECT CAST(i * 10 AS BIGINT) AS count, round(10 + 3.5 * i, 2) AS price, 'user_' || i || '@example.com' AS email, 'Name_' || i AS name FROM range(1, 1001) AS t(i)")
def s22_generated_rows(spark, base):
    """Rows by rule: counts, prices, addresses and names."""
    i = F.col("id")
    return spark.range(1, 1001).select((i * 10).alias("count"), F.round(10 + i * 3.5, 2).alias("price"), F.concat(F.lit("user_"), i, F.lit("@example.com")).alias("email"), F.concat(F.lit("Name_"), i).alias("name"))


QUERIES, ORACLE = R.queries, R.sql
