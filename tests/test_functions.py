import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code
from sparkloom.functions import text as X
from sparkloom.operators import curation
from sparkloom.plans import durable
from sparkloom.sources import files
from sparkloom.streaming import event_log as L


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_text_functions(spark):
    assert one(spark, X.strip_ansi, "\x1b[31mred\x1b[0m", None) == ["red", None]
    assert one(spark, X.redact, "Authorization: Bearer abc def", "password=x1; y", "--token t0 z", "pg://u:pw@h/x", "plain") == ["Authorization: Bearer *** def", "password=***; y", "--token *** z", "pg://u:***@h/x", "plain"]
    assert one(spark, X.normalize_query, " a\\b  c?! ", "") == ["a/b c", ""]
    assert one(spark, X.query_terms, "getUserName snake_case x") == [["getusername", "snake_case", "get", "user", "name", "snake", "case"]]
    assert one(spark, X.query_class, "src/a.py", "get_user", "how does it work", "why does get_user fail") == ["file_path", "exact_symbol", "natural_language", "mixed"]
    assert one(spark, X.intent, "fix the SQL error", "a token leaks", "hello") == ["database", "security", "general"]
    assert one(spark, X.canonical_path, "./a//b\\c", "/abs", "C:/x", "a/../b", "a\x00b") == ["a/b/c", None, None, None, None]
    assert one(spark, X.path_tier, "src/a.py", "docs/a.py", "archive/a.md") == [0, 1, 2]
    assert one(spark, X.estimate_tokens, "", "x" * 34, "é") == [1, 10, 1]
    assert one(spark, X.estimate_code_tokens, "a = abcdef", "") == [4, 1]
    assert one(spark, lambda c: X.head_tail(c, 1, 1), "a\nb\nc\nd", "a\nb") == ["a\n... 2 lines ...\nd", "a\nb"]
    assert one(spark, lambda c: X.cut_at_line(c, 5), "ab\ncd\nef", "abcdefg", "ab") == ["ab", "abcde", "ab"]


def simhash(text):
    plain = " ".join(text.lower().split())
    votes = [0] * 64
    for i in range(max(1, len(plain) - 3)):
        h = int(hashlib.md5(plain[i : i + 4].encode()).hexdigest()[:16], 16)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    out = sum(1 << b for b in range(64) if votes[b] > 0)
    return out - (1 << 64) if out >> 63 else out


def test_simhash_and_splits(spark):
    texts = ["The quick  brown fox", "ab", "", "Snapshot of the archive " * 20]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i long, t string")
    assert {r.i: r.simhash for r in curation.simhashes(df, "i", "t").collect()} == {i: simhash(t) for i, t in enumerate(texts)} | {len(texts): None}
    got = one(spark, X.split_of, *[f"g{i}" for i in range(50)])
    of = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 100
    assert got == ["train" if of(f"g{i}") < 80 else "calibration" if of(f"g{i}") < 90 else "test" for i in range(50)]


SOURCE = "import os\n\nclass A:\n    def f(self, x):\n        if x and os or x:\n            for y in x:\n                g(y)\n        return self.h()\n\ndef g(y):\n    pass\n\ng(1)\n"


def test_code_facts(spark):
    df = spark.createDataFrame([("a", SOURCE), ("b", "def broken("), ("c", None), ("d", "")], "id string, text string")
    syms = code.table_function(df, "id", "text", "kind string, name string, line long, indent long", code.symbols)
    assert {(r.id, r.kind, r.name, r.line) for r in syms.collect()} == {("a", "class", "A", 3), ("a", "def", "f", 4), ("a", "def", "g", 10), ("b", "def", "broken", 1)}
    assert set(code.relations(SOURCE)) == {("A.f", "g", 7), ("A.f", "h", 8), ("<module>", "g", 13)} and list(code.relations("def broken(")) == []
    assert {r[0]: r[2:] for r in code.complexity(SOURCE)} == {"f": (5, 5, "low"), "g": (1, 0, "low")}
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n"
    assert list(code.diff_lines(diff)) == [("x.py", 1, "-", 2, "b"), ("x.py", 1, "+", 2, "c")]
    assert list(code.routes('@app.get("/a")\n@app.route("/b")')) == [("GET", "/a"), ("GET", "/b")]
    assert code.outline_change("def a(): return 1\ndef b(): return 2", "def a(): return 3\ndef c(): return 2") == [("changed", "FunctionDef", "a"), ("renamed", "FunctionDef", "b -> c")]


@pytest.mark.parametrize("text", ["DROP TABLE t", "SELECT 1; SELECT 2", "insert into t values (1)", "WITH a AS (SELECT 1) DELETE FROM a", "", "EXPLAIN SELECT 1"])
def test_only_select_is_allowed(text):
    with pytest.raises(ValueError):
        files.checked_select(text)


def test_files(spark, tmp_path):
    assert files.checked_select("SELECT 'drop; table' AS x -- delete\n;") and files.split_statements("a; b ';' ; -- c;\n") == ["a", "b ';'", "-- c;"]
    df = spark.createDataFrame([(1, "O'Hara", None), (2, None, 1.5)], "id long, name string, v double")
    assert [r.statement for r in files.insert_statements(df, "t").collect()] == ["INSERT INTO t VALUES (1, 'O''Hara', NULL)", "INSERT INTO t VALUES (2, NULL, 1.5)"]
    files.write_json_lines(df, f"{tmp_path}/x")
    assert sorted(map(str, files.read_json_lines(spark, f"{tmp_path}/x", df.schema).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text("{")
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/bad", df.schema).collect()
    assert files.inventory(spark, f"{tmp_path}/bad", "*.json").count() == 1
    assert [r.id for r in files.checked_ids(spark.createDataFrame([(1, "g"), (1, "g"), (2, " "), (3, "h")], "id long, g string"), "id", "g").orderBy("id").collect()] == [1, 2]


def test_streams_equal_to_batches(spark, tmp_path):
    rows = [(i % 40, 1_700_000_000 + i * 60, "a" if i % 3 else "b") for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, s long, kind string").select("event_id", F.timestamp_seconds("s").alias("ts"), "kind")
    df.repartition(4).write.parquet(f"{tmp_path}/ev.parquet")
    s = L.read(spark, str(tmp_path), "ev")
    counts = L.latest_updates(L.drain(s.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "update"), ["kind"])
    assert {(r.kind, r.n) for r in counts.collect()} == {("a", 53), ("b", 27)}
    once = L.drain(L.append_once(L.read(spark, str(tmp_path), "ev"), ["event_id"], "ts", "2 hours").select("event_id"), "append")
    assert sorted(r.event_id for r in once.collect()) == list(range(40))


def test_checkpoint_folder_comes_from_the_session(spark):
    where = durable.checkpoint_dir(spark)
    assert where and durable.durable(spark.range(3)).count() == 3
    assert json.dumps(where)
