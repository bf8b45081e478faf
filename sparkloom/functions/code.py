"""Facts from source code: symbols, calls, complexity, diffs. Text in, rows out, one text a unit of work."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
DEFINITION = re.compile(r"^(\s*)(?:export\s+)?(?:async\s+)?(def|class|function|const)\s+([A-Za-z_]\w*)")
ROUTE = re.compile(r"@\w+\.(get|post|put|delete|patch|route)\(\s*[\"']([^\"']+)[\"']")


def table_function(df: DataFrame, key: str, text: str, schema: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """``key`` and the columns of ``schema``: the rows ``parse`` makes of each text; null texts make none."""
    kind = df.select(F.col(key)).schema
    out = df.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in out]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in out]
    whole = type(kind)(list(kind.fields) + list(out.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for r in parse(t):
                    at.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], [key, *names])

    return df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).cast("string")).mapInArrow(run, whole)


def symbols(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, line, indent) of the definitions in a text of Python or a C-like language, by their first line."""
    for n, line in enumerate(text.split("\n"), 1):
        if m := DEFINITION.match(line):
            yield m[2], m[3], n, len(m[1])


def _parsed(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def relations(text: str) -> Iterator[tuple[str, str, int]]:
    """(caller, callee, line) of the calls in Python text; calls outside functions have the caller "<module>"."""
    tree = _parsed(text)
    todo = [(tree, "<module>")] if tree else []
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = f"{owner}.{child.name}" if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else owner
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    yield owner.removeprefix("<module>.") or owner, name, child.lineno
            todo.append((child, inner))


BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)


def complexity(text: str) -> Iterator[tuple[str, int, int, int, str]]:
    """(function, line, cyclomatic, cognitive, risk) of the functions in Python text.

    Each branch or handler adds 1, a boolean chain its operators; the cognitive figure adds the depth of nesting too.
    """
    tree = _parsed(text)
    for f in ast.walk(tree) if tree else ():
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        cyclomatic, cognitive = 1, 0
        todo = [(c, 0) for c in ast.iter_child_nodes(f)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            deeper = depth
            if isinstance(node, BRANCH):
                cyclomatic += 1
                cognitive += 1 + depth
                deeper = depth + 1
            elif isinstance(node, ast.BoolOp):
                cyclomatic += len(node.values) - 1
                cognitive += len(node.values) - 1
            todo += [(c, deeper) for c in ast.iter_child_nodes(node)]
        risk = "high" if cyclomatic >= 10 or cognitive >= 15 else "medium" if cyclomatic >= 6 or cognitive >= 8 else "low"
        yield f.name, f.lineno, cyclomatic, cognitive, risk


def diff_lines(text: str) -> Iterator[tuple[str, int, str, int, str]]:
    """(path, hunk, sign, line in its file, text) of a unified diff; what isn't one gives no rows."""
    path, hunk, old, new = "", 0, 0, 0
    for line in text.split("\n"):
        if line.startswith("+++ "):
            path, hunk = line[4:].removeprefix("b/"), 0
        elif m := HUNK.match(line):
            hunk, old, new = hunk + 1, int(m[1]), int(m[3])
        elif hunk and line[:1] == "+":
            yield path, hunk, "+", new, line[1:]
            new += 1
        elif hunk and line[:1] == "-" and not line.startswith("--- "):
            yield path, hunk, "-", old, line[1:]
            old += 1
        elif hunk and line[:1] == " ":
            old, new = old + 1, new + 1


def routes(text: str) -> Iterator[tuple[str, str]]:
    """(method, path) of the decorated routes in Python text."""
    for m in ROUTE.finditer(text):
        yield m[1].upper() if m[1] != "route" else "GET", m[2]


def outline_change(old: str, new: str) -> list[tuple[str, str, str]]:
    """(change, kind, name) between two Python texts: added, removed, changed (by the shape of the body) or renamed."""

    def shapes(text: str) -> dict[tuple[str, str], str]:
        tree = _parsed(text)
        return {(type(n).__name__, n.name): ast.dump(ast.Module(n.body, [])) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))} if tree else {}

    a, b = shapes(old), shapes(new)
    out = [("changed", *k) for k in a if k in b and a[k] != b[k]]
    gone, come = {k: v for k, v in a.items() if k not in b}, {k: v for k, v in b.items() if k not in a}
    for k, v in list(gone.items()):
        same = [c for c, w in come.items() if w == v and c[0] == k[0]]
        if len(same) == 1 and list(gone.values()).count(v) == 1:
            out.append(("renamed", k[0], f"{k[1]} -> {same[0][1]}"))
            del gone[k], come[same[0]]
    return sorted(out + [("removed", *k) for k in gone] + [("added", *k) for k in come])
