"""Files as sources and sinks, and SQL as a read-only source."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.durable import checkpoint_dir
from sparkloom.sources.tables import table

#: Words that begin or stand in statements that change something.
WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|set|use|cache|uncache|refresh|grant|revoke|load|call|add)\b", re.I)


def checked_select(text: str) -> str:
    """The text, if it is one SELECT (or WITH ... SELECT); quoted literals and comments aren't looked into."""
    quoted = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
    bare = quoted.sub(lambda m: " " if m.group()[:2] in ("--", "/*") else "''", text).strip().rstrip(";").strip()
    if ";" in bare or not re.match(r"(select|with)\b", bare, re.I) or WRITES.search(bare):
        raise ValueError("only one SELECT statement is allowed")
    return text.strip().rstrip(";")


def read_only_sql(spark: SparkSession, base: str, tables: list[str], text: str, most: int = 100) -> DataFrame:
    """At most ``most`` rows of a SELECT over ``tables`` under ``base``; their views have names of their own afterwards."""
    checked = checked_select(text)
    tag = uuid.uuid4().hex[:8]
    for t in tables:
        table(spark, base, t).createOrReplaceTempView(f"{t}_{tag}")
        checked = re.sub(rf"\b{t}\b", f"{t}_{tag}", checked)
    return spark.sql(checked).limit(most)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; the committer makes the result visible as a whole."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a known schema; a line that isn't one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_round_trip(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession)}/jsonl-{uuid.uuid4().hex}"
    write_json_lines(df, path)
    return read_json_lines(df.sparkSession, path, df.schema)


def checked_ids(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that stand more than once or have no group, with their rows: none of a valid data set."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(group).isNull() | (F.trim(group) == ""), 1)).alias("without_group"))
    return bad.where("n > 1 OR without_group > 0")


def inventory(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 1 << 30) -> DataFrame:
    """path, bytes, modified of the files under ``path``; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """statement: an INSERT for each row; texts quoted, null as NULL."""
    shown = []
    for f in df.schema:
        c = F.col(f.name).cast("string")
        if isinstance(f.dataType, (T.StringType, T.TimestampType, T.DateType, T.TimestampNTZType)):
            c = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        shown.append(F.coalesce(c, F.lit("NULL")))
    return df.select(F.concat(F.lit(f"INSERT INTO {name} VALUES ("), F.concat_ws(", ", *shown), F.lit(")")).alias("statement"))


def split_statements(text: str) -> list[str]:
    """The statements of an SQL text; semicolons in quotes and comments don't end one."""
    out, start = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|;", text, re.S):
        if m.group() == ";":
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [s for s in (*out, text[start:].strip()) if s]
