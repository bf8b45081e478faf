"""Queries over nested records and record hierarchies, with the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import hierarchy as H
from sparkloom.operators import nested
from sparkloom.plans.durable import durable
from sparkloom.sources.tables import table

#: The members whose elements are rows, and the fields that hold them.
MEMBERS = ["events", "model_reviews", "checks", "spans", "sources", "tiles", "marks", "sections", "children"]
FIELDS = {"laya_candidates": ("candidate_id", "candidate_json"), "artifacts": ("artifact_id", "identity_json"), "artifact_paging_metadata": ("artifact_id", "section_json")}
RELATIONS = {"supersedes": "supersedes_record_id", "contradicts": "contradicts_record_id"}


def _objects(spark: SparkSession, base: str, attributes: bool = True, root_row: bool = False, sources: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    parts = [table(spark, base, t).select(F.lit(t).alias("source_table"), F.col(k).alias("k"), F.col(f).alias("f")) for t, (k, f) in FIELDS.items() if t in sources]
    return nested.nested_objects(reduce(DataFrame.unionByName, parts), "k", "f", MEMBERS, attributes, root_row, also=("source_table",))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _objects(spark, base, False).select("source_table", "row_key", "object_path", "parent_path")


def p4_schema(spark: SparkSession, base: str) -> DataFrame:
    """The merged schema of each source: its tables, their attributes and types."""
    objects = _objects(spark, base, root_row=True)
    return nested.merged_schema(objects.withColumn("table_path", F.concat_ws(":", "source_table", "table_path"))).select(
        F.substring_index("table_path", ":", 1).alias("source_table"), F.expr("substring(table_path, instr(table_path, ':') + 1)").alias("table_path"), "attribute", "type", "n_objects", "n_null"
    )


def _flat(objects: DataFrame, name: str) -> DataFrame:
    named = durable(objects.withColumn("table_path", F.lit(name)))
    found = nested.child_tables(named, also=("source_table",))
    return found[name] if name in found else named.select("source_table", "row_key", "object_id", "parent_id", "parent_path", "object_path", "ordinal")


def _root_table(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return _flat(_objects(spark, base, root_row=True, sources=(source,)).where(F.col("table_path") == "$"), source)

    return run


def _member_table(member: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return _flat(_objects(spark, base).where(F.substring_index("table_path", ".", -1) == member), member)

    return run


#: A flat table of the records of each source and of the elements of each member, wherever they stand.
TABLES = {f"p4_table_{t}": _root_table(t) for t in FIELDS} | {f"p4_table_{m}": _member_table(m) for m in MEMBERS}


def _links(spark: SparkSession, base: str) -> DataFrame:
    return H.links_of(table(spark, base, "agent_memory_records"), "record_id", "updated_at", RELATIONS)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return H.hierarchy(_links(spark, base)).select("relation", "record_id", "root_record_id", "depth")


def p5_paths(spark: SparkSession, base: str) -> DataFrame:
    tree = H.hierarchy(_links(spark, base), detail=True)
    return tree.select("relation", "record_id", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of the trees that end in a root; p5_circle_descendants has the others."""
    return H.descendants(H.hierarchy(_links(spark, base), detail=True).where(F.col("depth") >= 0))


def p5_circle_descendants(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of the trees that hang below a member of a circle."""
    return H.descendants(H.hierarchy(_links(spark, base), detail=True).where(F.col("depth") < 0))


def p5_circles(spark: SparkSession, base: str) -> DataFrame:
    return H.circles(H.hierarchy(_links(spark, base), detail=True)).select("relation", "root_record_id", F.col("position").cast("long").alias("position"), "record_id")


_WALK = """WITH RECURSIVE latest AS (
  SELECT record_id AS id, supersedes_record_id AS s, contradicts_record_id AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC NULLS LAST, supersedes_record_id DESC NULLS LAST, contradicts_record_id DESC NULLS LAST) AS r
    FROM agent_memory_records WHERE record_id IS NOT NULL) WHERE r = 1),
named AS (
  SELECT * FROM (SELECT 'supersedes' AS relation, id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS parent FROM latest
    UNION ALL SELECT 'contradicts', id, regexp_replace(c, '^\\s+|\\s+$', '', 'g') FROM latest) WHERE parent <> ''),
link AS (SELECT * FROM named WHERE parent IN (SELECT id FROM latest)),
node AS (SELECT relation, id FROM named UNION SELECT relation, parent FROM link),
walk AS (
  SELECT relation, id, id AS cur, [id] AS seen, false AS ring FROM node
  UNION ALL
  SELECT w.relation, w.id, l.parent, CASE WHEN list_contains(seen, l.parent) THEN list_slice(seen, list_position(seen, l.parent), len(seen)) ELSE list_append(seen, l.parent) END,
         list_contains(seen, l.parent)
  FROM walk w JOIN link l ON l.relation = w.relation AND l.id = w.cur WHERE NOT ring),
final AS (
  SELECT relation, id AS record_id, CASE WHEN ring THEN list_min(seen) ELSE cur END AS root_record_id,
         CASE WHEN ring THEN -1 ELSE len(seen) - 1 END AS depth, CASE WHEN ring THEN [] ELSE list_reverse(seen) END AS path, seen, ring
  FROM walk w WHERE ring OR NOT EXISTS (SELECT 1 FROM link l WHERE l.relation = w.relation AND l.id = w.cur))
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_schema, p5_found, p5_paths, p5_descendants, p5_circle_descendants, p5_circles)} | TABLES
ORACLE = {
    "p5_found": _WALK + "SELECT relation, record_id, root_record_id, CAST(depth AS BIGINT) AS depth FROM final",
    "p5_paths": _WALK + "SELECT relation, record_id, array_to_string(path, '/') AS path FROM final",
    "p5_descendants": _WALK
    + "SELECT relation, path[k] AS record_id, record_id AS descendant_id, CAST(depth + 1 - k AS BIGINT) AS distance FROM final, unnest(range(1, depth + 1)) AS t(k) WHERE depth > 0",
    "p5_circle_descendants": _WALK
    + """, member AS (SELECT relation, record_id AS id FROM final f WHERE ring AND EXISTS (SELECT 1 FROM link l WHERE l.relation = f.relation AND l.parent = f.record_id AND list_contains(f.seen, l.id))),
line AS (
  SELECT relation, record_id AS id, record_id AS cur, 0 AS n FROM final WHERE ring
  UNION ALL
  SELECT w.relation, w.id, l.parent, n + 1 FROM line w JOIN link l ON l.relation = w.relation AND l.id = w.cur
  WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.relation = w.relation AND m.id = w.cur))
SELECT relation, cur AS record_id, id AS descendant_id, CAST(n AS BIGINT) AS distance FROM line WHERE n > 0""",
    "p5_circles": _WALK
    + """, r AS (SELECT relation, root_record_id, seen FROM final WHERE ring AND record_id = root_record_id)
SELECT relation, root_record_id, CAST(k - 1 AS BIGINT) AS position, seen[k] AS record_id FROM r, unnest(range(1, len(seen) + 1)) AS t(k)""",
}
