"""Full hierarchies from parent-child links of unknown depth.

1. Components: every node follows its parent link by pointer doubling (each round doubles the reach), which ends at
   the component's root, or, after enough rounds to exceed every chain there can be, runs in a circle.
2. Each component is brought into one task, many per task, and traversed depth first with node colouring; a link to
   a grey node is a back edge and closes a circle.
3. Components of more than ``MAX_COMPONENT`` nodes are never gathered: their depths and paths are taken from the
   doubling itself. What all circular nodes point to after its last round are the members of the circles; a second
   doubling, over each circle cut open at its smallest id, counts their positions.
Each round is checkpointed in the shared folder, so lost executors cost a round's tasks and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.durable import durable
from sparkloom.plans.skew import lookup

#: Nodes of a component that one task may hold.
MAX_COMPONENT = 100_000


def links_of(rows: DataFrame, key: str, order: str, relations: dict[str, str]) -> DataFrame:
    """relation, id, parent (null if none is stored): one row for each node of each relation.

    Of a key's rows the latest by ``order`` counts; of equally late ones the one with the larger link values. A blank
    link is none; white space around it is cut. A node is a stored key whose link is filled or that is the parent of
    a stored key. Rows without a key aren't stored.
    """
    clean = lambda c: F.nullif(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    picked = [clean(c).alias(f"l{i}") for i, c in enumerate(relations.values())]
    latest = (
        rows.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").cast("string").alias("id"))
        .agg(F.max(F.struct(F.col(f"`{order}`").alias("o"), *picked)).alias("x"))
    )
    pairs = [F.struct(F.lit(name).alias("relation"), F.col(f"x.l{i}").alias("parent")) for i, name in enumerate(relations)]
    latest = durable(latest.select("id", F.array(*pairs).alias("links")))
    named = latest.select("id", F.explode("links").alias("l")).select("l.relation", "id", "l.parent").where(F.col("parent").isNotNull())
    stored = latest.select(F.col("id").alias("parent"), F.lit(True).alias("kept"))
    named = durable(lookup(named, stored, ["parent"]))
    parents = named.where("kept").select("relation", F.col("parent").alias("id"))
    given = named.select("relation", "id", F.when(F.col("kept"), F.col("parent")).alias("parent"))
    both = given.unionByName(parents.distinct(), allowMissingColumns=True)
    return durable(both.groupBy("relation", "id").agg(F.max("parent").alias("parent")))


def _double(nodes: DataFrame, trail: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, circular, members) by pointer doubling over relation, id, parent.

    resolved: relation, id, ptr (the root), dist, trail; circular: the same with ptr the smallest id of the circle
    and dist -1; members: relation, id of those on a circle. With ``trail``, for ``nodes`` without circles only, each
    row holds the ids from itself to below its root, else an empty array.
    """
    own = F.array("id") if trail else F.array().cast("array<string>")
    start = nodes.select(
        "relation", "id", F.coalesce("parent", "id").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("id").alias("least"), F.when(F.col("parent").isNotNull(), own).otherwise(F.array().cast("array<string>")).alias("trail"), F.col("parent").isNull().alias("done"),
    )
    start = durable(start)
    resolved, active = start.where("done"), start.where("NOT done")
    left, reach, bound = active.count(), 1, float("inf")
    while left:
        bound = min(bound, left + reach)
        if reach >= bound:
            break
        known = resolved.unionByName(active).select(
            "relation", F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("least").alias("m2"), F.col("trail").alias("t2"), F.col("done").alias("e2")
        )
        moved = lookup(active, known, ["relation", "ptr"], "inner").select(
            "relation", "id", F.col("p2").alias("ptr"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("least", "m2").alias("least"),
            F.concat("trail", "t2").alias("trail") if trail else F.col("trail"), F.col("e2").alias("done"),
        )
        moved = durable(moved)
        resolved, active = resolved.unionByName(moved.where("done")), moved.where("NOT done")
        left, reach = active.count(), reach * 2
    ends = active.select("relation", F.col("id").alias("ptr"), F.col("least").alias("m2"))
    circular = lookup(active, ends, ["relation", "ptr"], "inner") if left else active.withColumn("m2", F.col("least"))
    circular = circular.select("relation", "id", F.col("m2").alias("ptr"), F.lit(-1).cast("long").alias("dist"), F.array().cast("array<string>").alias("trail"))
    members = active.select("relation", F.col("ptr").alias("id")).distinct()
    return resolved.select("relation", "id", "ptr", "dist", "trail"), circular, members


def _positions(links: DataFrame, members: DataFrame) -> DataFrame:
    """relation, id, comp (the smallest id of the circle), position (from it on along the links) of circle members.

    ``links`` (relation, id, parent) holds all links, ``members`` (relation, id, comp) those on a circle.
    """
    ring = durable(lookup(members, links, ["relation", "id"], "inner").select("relation", "id", "comp", "parent"))
    steps, _, _ = _double(ring.select("relation", "id", F.when(F.col("id") != F.col("comp"), F.col("parent")).alias("parent")))
    steps = durable(steps.select("relation", "id", F.col("ptr").alias("comp"), "dist"))
    sizes = steps.groupBy("relation", "comp").agg(F.count(F.lit(1)).alias("n"))
    place = ((F.col("n") - F.col("dist")) % F.col("n")).alias("position")
    return lookup(steps, sizes, ["relation", "comp"], "inner").select("relation", "id", "comp", place)


def traverse(ids: list[str], parents: list[str | None], detail: bool = True) -> Iterator[tuple[str, str, int, list[str], int | None, list[str]]]:
    """(id, root, depth, path, position, branch) of every node, depth first from the roots with node colouring.

    One node is held at a time, with one path that is kept up to date; without ``detail`` paths and branches are empty.

    path runs from the root to the node. What no root reaches lies on a circle or leads into one: depth -1, root the
    smallest id of the circle, path empty. Members of the circle have a position, counted from the smallest id along
    the links; the others have a branch, from the member they hang below to the node.
    """
    up = dict(zip(ids, parents))
    below: dict[str, list[str]] = {}
    for i, p in up.items():
        if p is not None:
            below.setdefault(p, []).append(i)
    rings: dict[str, tuple[str, int]] = {}
    black: set[str] = set()
    for begin in up:
        grey: dict[str, int] = {}
        node: str | None = begin
        while node is not None and node not in grey and node not in black:
            grey[node] = len(grey)
            node = up[node]
        if node in grey:  # a back edge
            members = list(grey)[grey[node] :]
            least = members.index(min(members))
            for n, m in enumerate(members[least:] + members[:least]):
                rings[m] = (members[least], n)
        black.update(grey)
    for root in (i for i, p in up.items() if p is None or i in rings):
        path: list[str] = []
        todo = [(root, 0)]
        while todo:
            node, depth = todo.pop()
            del path[depth:]
            path.append(node)
            line = list(path) if detail else []
            if root not in rings:
                yield node, root, depth, line, None, []
            elif depth:
                yield node, rings[root][0], -1, [], None, line
            else:
                yield node, rings[root][0], -1, [], rings[root][1], []
            todo += [(c, depth + 1) for c in below.get(node, ()) if c not in rings]


def hierarchy(links: DataFrame, detail: bool = False, max_component: int = MAX_COMPONENT) -> DataFrame:
    """relation, record_id, root_record_id, depth, path, position, branch of every node of ``links`` (relation, id, parent).

    depth is -1 for nodes on a circle or leading into one; their root is the smallest id on the circle. path (from
    the root to the node), position (of the members of a circle, in link order from the smallest id on, else null) and
    branch (of nodes leading into a circle: from the member they hang below to the node, no link of the circle in it)
    are filled with ``detail`` only. Components above ``max_component`` nodes are not gathered and come out alike.
    """
    resolved, circular, members = _double(links)
    label = durable(resolved.unionByName(circular).select("relation", "id", F.col("ptr").alias("comp"), "dist"))
    sizes = label.groupBy("relation", "comp").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > max_component).select("relation", "comp")
    if large.limit(1).count():
        small, big = lookup(label, large, ["relation", "comp"], "left_anti"), lookup(label, large, ["relation", "comp"], "left_semi")
    else:
        small, big = label, None
    schema = "relation string, record_id string, root_record_id string, depth long, path array<string>, position long, branch array<string>"

    names = ["relation", "record_id", "root_record_id", "depth", "path", "position", "branch"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"position": "Int64"})

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The rows of each component in turn; one component is held at a time."""
        held: list[tuple] = []

        def done() -> Iterator[tuple]:
            for t in traverse([h[2] for h in held], [h[3] for h in held], detail):
                yield (held[0][0], *t[:3], *(t[3:] if detail else (None, None, None)))

        for f in frames:
            for row in zip(f["relation"], f["comp"], f["id"], f["parent"].where(f["parent"].notna(), None)):
                if held and (held[0][0], held[0][1]) != (row[0], row[1]):
                    yield from done()
                    held.clear()
                held.append(row)
        if held:
            yield from done()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for r in walked(frames):
            rows.append(r)
            size += 1 + len(r[4] or ()) + len(r[6] or ())
            if size > 100_000:  # names in a batch, paths counted in full
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)

    placed = small.join(links, ["relation", "id"]).select("relation", "comp", "id", "parent")
    out = placed.repartition("relation", "comp").sortWithinPartitions("relation", "comp").mapInPandas(run, schema)
    if big is None:
        return out
    if not detail:
        rest = big.select(
            "relation", F.col("id").alias("record_id"), F.col("comp").alias("root_record_id"), F.col("dist").alias("depth"),
            F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("array<string>").alias("branch"),
        )
        return out.unionByName(rest)
    led = big.where(F.col("dist") < 0).select("relation", "id", "comp")
    spots = durable(_positions(links, lookup(led, members, ["relation", "id"], "left_semi")).drop("comp"))
    opened = lookup(lookup(big, links, ["relation", "id"], "inner"), spots, ["relation", "id"])
    far, _, _ = _double(opened.select("relation", "id", F.when(F.col("position").isNull(), F.col("parent")).alias("parent")), trail=True)
    down, none, straight = F.concat(F.array("ptr"), F.reverse("trail")), F.array().cast("array<string>"), F.col("l.dist") >= 0
    rest = far.alias("f").join(opened.select("relation", "id", "comp", F.col("dist"), "position").alias("l"), ["relation", "id"]).select(
        "relation", F.col("id").alias("record_id"), F.col("comp").alias("root_record_id"), F.col("l.dist").alias("depth"),
        F.when(straight, down).otherwise(none).alias("path"), "position",
        F.when(~straight & F.col("position").isNull(), down).otherwise(none).alias("branch"),
    )
    return out.unionByName(rest)


def descendants(tree: DataFrame) -> DataFrame:
    """relation, record_id, descendant_id, distance: every pair of a node and one below it (from a detailed hierarchy).

    Links of a circle are reported by ``circles`` and not followed: two members of a circle are no pair, and a record
    below one member is no descendant of the others.
    """
    lines = tree.withColumn("line", F.when(F.col("depth") < 0, F.col("branch")).otherwise(F.col("path"))).withColumn("far", F.size("line") - 1)
    pairs = lines.where(F.col("far") > 0).select("relation", "record_id", "far", F.posexplode(F.expr("slice(line, 1, far)")).alias("at", "above"))
    return pairs.select("relation", F.col("above").alias("record_id"), F.col("record_id").alias("descendant_id"), (F.col("far") - F.col("at")).cast("long").alias("distance"))


def circles(tree: DataFrame) -> DataFrame:
    """relation, root_record_id, position, record_id: the members of each circle in link order (from a detailed hierarchy)."""
    return tree.where(F.col("position").isNotNull()).select("relation", "root_record_id", "position", "record_id")
