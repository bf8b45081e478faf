"""Deeply nested JSON records as related flat tables.

1. Every field is parsed into a VARIANT (encoded once or more often; a string that holds JSON counts as what it holds).
2. Level by level the members of all objects are exploded: elements of an array become rows of a child table with a
   surrogate key, their parent's key and their ordinal; plain objects pass their members on to the row they stand in.
   A level is written before the next is made of it, so nothing is parsed twice and no level is shuffled.
3. The merged schema is an aggregate over the attributes of all rows, and each child table is a projection on its part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.durable import durable

#: Times a whole field may be encoded within itself.
ENCODINGS = 6
#: Levels of nesting that are followed; a record nested deeper is an error, nothing is left out in silence.
MAX_LEVELS = 64


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _opens(text: Column) -> Column:
    return F.ltrim(text).rlike(r"^[\{\[]")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _let(v: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(v), f), 1)


def _held(v: Column) -> Column:
    """A string that holds a JSON object or array as what it holds; every other value as it is."""

    def opened(x: Column) -> Column:
        return F.when(_array(x).isNull() & _object(x).isNull() & _opens(_text(x)), F.coalesce(F.try_parse_json(_text(x)), x)).otherwise(x)

    return _let(v, opened)


def parsed(text: Column) -> Column:
    """The object or array a field holds, encoded once or more often; null for anything else."""
    for _ in range(ENCODINGS - 1):
        text = _let(text, lambda t: F.when(F.ltrim(t).startswith('"'), _text(F.try_parse_json(t))).otherwise(t))
    return F.when(_opens(text), F.try_parse_json(text))


def _step(name: Column) -> Column:
    """A member in a path; names that hold a dot or bracket are quoted, so no two paths fall together."""
    return F.when(name.rlike(r"[.\[\]']"), F.concat(F.lit("['"), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))).otherwise(F.concat(F.lit("."), name))


def _key(path: Column, keys: list[str]) -> Column:
    """The surrogate key of an object: a digest of its record and place, the same in every run."""
    return F.md5(F.concat_ws("\x1f", *keys, path))


def nested_objects(df: DataFrame, key: str, field: str, members: list[str] | None = None, attributes: bool = True, root_row: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, row_key, object_id, parent_id, object_path, parent_path, table_path, ordinal, attributes: a row for each nested object.

    Rows are the objects that are elements of a member named in ``members`` (of any array, if that is None) and, with
    ``root_row``, the records themselves. Positions count from 0, with null elements. A bare object in a listed member
    counts as a list of one. Null, empty and invalid JSON give no rows, neither do rows without a key; of a row that
    stands twice the result stands once. Other columns aren't read, so clashing names do no harm. ``attributes`` are
    the object's own values as JSON text, those of nested plain objects by dotted name; arrays without objects are
    values. Of a member that stands twice in an object the last counts. ``also`` names columns that belong to the key.
    """
    spark = df.sparkSession
    flag = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(flag)
    spark.conf.set(flag, "true")  # read when the expressions are made
    try:
        return _objects(df, key, field, members, attributes, root_row, also)
    finally:
        spark.conf.set(flag, before)


def _objects(df: DataFrame, key: str, field: str, members: list[str] | None, attributes: bool, root_row: bool, also: tuple[str, ...]) -> DataFrame:
    keys = [*also, "row_key"]
    rows = df.select(*also, F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{field}`").cast("string").alias("j"))
    rows = rows.where(F.col("row_key").isNotNull() & (F.length("j") > 1)).select(*keys, parsed(F.col("j")).alias("v")).where(F.col("v").isNotNull())
    at = F.lit("$")
    #: path: of the node; own: of the row it belongs to; up: of that row's parent; table: path without positions; prefix: of its attributes
    level = rows.select(*keys, at.alias("path"), at.alias("own"), at.alias("up"), at.alias("table"), F.lit(0).cast("long").alias("ordinal"), F.lit("").alias("prefix"), F.lit(True).alias("row"), "v")
    levels = []
    for _ in range(MAX_LEVELS):
        level = durable(level)
        levels.append(level)
        if level.isEmpty():
            break
        level = _next(level, keys, members)
    else:
        raise ValueError(f"records nested deeper than {MAX_LEVELS} levels")
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.where(_array("v").isNull())  # the other containers are objects
    out = nodes.where("row").where(F.lit(True) if root_row else F.col("path") != "$")
    links = out.select(*keys, F.col("path").alias("object_path"), F.when(F.col("path") != "$", F.col("up")).otherwise(F.lit("")).alias("parent_path"), F.col("table").alias("table_path"), "ordinal").distinct()
    parent = F.when(F.col("object_path") != "$", _key(F.col("parent_path"), keys)).alias("parent_id")
    own = links.select(*keys, _key(F.col("object_path"), keys).alias("object_id"), parent, "object_path", "parent_path", "table_path", "ordinal")
    if not attributes:
        return own
    return own.join(_attributes(nodes, keys, members, root_row), "object_id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def _next(level: DataFrame, keys: list[str], members: list[str] | None) -> DataFrame:
    """The containers one level further in."""
    listed = F.col("name").isin(members) if members is not None else _array(F.col("c")).isNotNull()
    node = F.transform(F.map_entries(_object("v")), lambda e: F.struct(e["key"].alias("name"), F.lit(None).cast("int").alias("pos"), e["value"].alias("c")))
    elements = F.transform(_array("v"), lambda e, i: F.struct(F.lit(None).cast("string").alias("name"), i.alias("pos"), e.alias("c")))
    inner = level.select(*keys, "path", "own", "up", "table", "prefix", F.explode(F.coalesce(node, elements)).alias("e"))
    inner = inner.select(*keys, "path", "own", "up", "table", "prefix", "e.name", "e.pos", _held(F.col("e.c")).alias("c")).where(_array(F.col("c")).isNotNull() | _object(F.col("c")).isNotNull())
    inner = inner.withColumn("at", F.concat("path", F.when(F.col("name").isNotNull(), _step(F.col("name"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))))
    inner = inner.withColumns({"is_list": F.coalesce(F.col("name").isNotNull() & listed, F.lit(False)), "in": F.when(F.col("name").isNotNull(), F.concat("table", _step(F.col("name")))).otherwise(F.col("table"))})
    element = F.transform(F.coalesce(_array(F.col("c")), F.array("c")), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    single = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("c").alias("x")))
    each = inner.select(*keys, "at", "own", "up", "in", "prefix", "name", "pos", "is_list", F.explode(F.when(F.col("is_list"), element).otherwise(single)).alias("e"))
    each = each.select(*keys, "at", "own", "up", "in", "prefix", "name", "pos", "is_list", "e.i", F.when(F.col("is_list"), _held(F.col("e.x"))).otherwise(F.col("e.x")).alias("v"))
    each = each.withColumn("obj", _object(F.col("v")).isNotNull()).where(F.col("obj") | _array(F.col("v")).isNotNull())
    path = F.when(F.col("is_list"), F.concat("at", F.lit("["), "i", F.lit("]"))).otherwise(F.col("at"))
    each = each.withColumns({"path": path, "row": F.col("is_list") & F.col("obj")})
    inside = F.concat("prefix", F.coalesce(_step(F.col("name")), F.concat(F.lit("["), F.col("pos"), F.lit("]"))))
    return each.select(
        *keys, "path", F.when(F.col("row"), F.col("path")).otherwise(F.col("own")).alias("own"), F.when(F.col("row"), F.col("own")).otherwise(F.col("up")).alias("up"),
        F.col("in").alias("table"), F.coalesce(F.col("i"), F.lit(0)).cast("long").alias("ordinal"), F.when(F.col("is_list"), F.lit("")).otherwise(inside).alias("prefix"), "row", "v",
    )


def _attributes(nodes: DataFrame, keys: list[str], members: list[str] | None, root_row: bool) -> DataFrame:
    """object_id, attributes of the rows, gathered from their own objects and the plain ones in them."""

    def no_objects(v: Column) -> Column:
        return ~F.coalesce(F.exists(_array(v), lambda e: _object(_held(e)).isNotNull()), F.lit(False))

    one = nodes.where(F.lit(True) if root_row else F.col("own") != "$").select(*keys, "own", "prefix", F.explode(_object("v")).alias("name", "raw")).withColumn("c", _held(F.col("raw")))
    one = one.where(_object(F.col("c")).isNull() & no_objects(F.col("c")))
    if members is not None:
        one = one.where(~F.col("name").isin(members))
    label = F.regexp_replace(F.concat("prefix", _step(F.col("name"))), r"^\.", "")
    pairs = one.select(_key(F.col("own"), keys).alias("object_id"), label.alias("k"), F.when(F.try_variant_get("c", "$", "string").isNotNull() | _array(F.col("c")).isNotNull(), F.to_json("c")).alias("t"))
    return pairs.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("k", "t"))))).alias("attributes"))


def merged_schema(objects: DataFrame) -> DataFrame:
    """table_path, attribute, type, n_objects, n_null: what the rows of ``nested_objects`` hold between them.

    Types widen: boolean, bigint, decimal(38,0), double and string; what mixes others is a string. An attribute seen
    only as null is a string.
    """
    one = objects.select("table_path", F.explode("attributes").alias("attribute", "v"))
    v = F.col("v")
    kind = (
        F.when(v.isNull(), F.lit(0))
        .when(v.isin("true", "false"), F.lit(1))
        .when(v.rlike(r"^-?\d{1,18}$"), F.lit(2))
        .when(v.rlike(r"^-?\d{19,38}$"), F.lit(4))
        .when(v.rlike(r"^-?\d"), F.lit(8))
        .otherwise(F.lit(16))
    )
    bits = one.groupBy("table_path", "attribute").agg(F.bit_or(kind).alias("b"), F.count(F.lit(1)).alias("n_objects"), F.count(F.when(v.isNull(), 1)).alias("n_null"))
    b = F.col("b")
    name = F.when(b == 1, "boolean").when(b == 2, "bigint").when(b.isin(4, 6), "decimal(38,0)").when(b.isin(8, 10), "double").otherwise("string")
    return bits.select("table_path", "attribute", name.alias("type"), "n_objects", "n_null")


def child_tables(objects: DataFrame, max_columns: int = 2000, also: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A flat table for each table_path: ``also``, the links (row_key to ordinal) and its typed attributes.

    The merged schema is read to the driver: its size is that of the schema, not of the data, and more than
    ``max_columns`` attributes (data used as member names) or tables is an error.
    """
    columns = merged_schema(objects).orderBy("table_path", "attribute").limit(max_columns + 1).collect()
    names = objects.select("table_path").distinct().limit(max_columns + 1).collect()
    if max(len(columns), len(names)) > max_columns:
        raise ValueError(f"more than {max_columns} attributes or tables; list the members that are tables")
    by: dict[str, list] = {r.table_path: [] for r in names}
    for c in columns:
        v = F.col("attributes")[F.lit(c.attribute)]
        if c.type == "string":
            text = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
            v = F.when(v.startswith('"'), text).otherwise(v)
        else:
            v = v.cast(c.type)
        by[c.table_path].append(v.alias(f"a_{c.attribute}"))
    link = [*also, "row_key", "object_id", "parent_id", "parent_path", "object_path", "ordinal"]
    return {p: objects.where(F.col("table_path") == p).select(*link, *cols) for p, cols in by.items()}
