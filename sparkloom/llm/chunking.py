"""Splitting of oversized texts at natural boundaries.

Boundaries are the running sums of token lengths (a token is a word with the white space after it), held in one
sorted array per kind: section ends, paragraphs, lines, sentences, words. For each piece a binary search finds the
last boundary under the limit; the next piece steps back by the overlap. Without any boundary the cut is hard.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 4000, 200
#: Kinds of cut, strongest first.
KINDS = ("section", "paragraph", "line", "sentence", "word")

PARAGRAPH = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[”」』]*\s*")
TOKEN = re.compile(r"\s*\S+\s*")


def section_ends(text: str | None) -> list[int]:
    """Starts and ends of all sections, at any depth, in a section_json; unreadable JSON gives none."""
    value: object = text
    for _ in range(4):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str) and v[:1] in "[{" and len(v) > 1:
            try:
                v = json.loads(v)
            except (ValueError, RecursionError):
                continue
        if isinstance(v, list):
            todo += v
        elif isinstance(v, dict):
            out += [x for x in (v.get("start"), v.get("end")) if isinstance(x, int) and not isinstance(x, bool)]
            todo += [v.get("sections"), v.get("children")]
    return out


def boundaries(text: str, sections: list[int]) -> list[list[int]]:
    """One sorted array of places per kind of cut; a place is where the text after the cut begins."""
    n = len(text)
    total, words = 0, []
    for m in TOKEN.finditer(text):
        total += m.end() - m.start()
        words.append(total)
    return [
        sorted({p for p in sections if 0 < p < n and text[p - 1] == "\n"}),  # an offset that no line begins at isn't this text's
        [m.end() for m in PARAGRAPH.finditer(text)],
        [m.end() for m in LINE.finditer(text)],
        [m.end() for m in SENTENCE.finditer(text)],
        words,
    ]


def _hard(text: str, at: int, least: int) -> int:
    """A forced cut at ``at``, moved back so that no mark is torn from its letter and no line end in two."""
    import unicodedata

    for p in range(at, max(least, at - 16), -1):
        c = text[p]
        if not (unicodedata.combining(c) or c in "‍️" or text[p - 1] == "‍" or (c == "\n" and text[p - 1] == "\r")):
            return p
    return at


def split_text(text: str, sections: list[int] = (), limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece of a text longer than ``limit``.

    Pieces cover the text, none is longer than ``limit``, and each starts ``overlap`` characters before the end of
    the one before it. The strongest kind with a boundary in the last half of the room wins; where no kind has one
    there, the strongest with any boundary that makes progress.
    """
    n = len(text)
    kinds = boundaries(text, list(sections))
    out, start = [], 0
    while n - start > limit:
        top, least = start + limit, start + overlap + 1
        end, kind = 0, ""
        for floor in (max(least, start + limit // 2), least):
            for name, places in zip(KINDS, kinds):
                k = bisect_right(places, top) - 1
                if k >= 0 and places[k] >= floor:
                    end, kind = places[k], name
                    break
            if end:
                break
        if not end:
            end, kind = _hard(text, top, least), "hard"
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def split_oversized(
    texts: DataFrame, key: str, text: str, paging: DataFrame | None = None, sections: str = "section_json",
    limit: int = LIMIT, overlap: int = OVERLAP, order: str = "created_at",
) -> DataFrame:
    """``key``, piece_no (from 0), start_char, end_char, cut, piece of every text of more than ``limit`` characters.

    Characters are Unicode code points. Null, empty and shorter texts give no rows. Of repeated rows of a key the one
    latest by ``order`` counts, of equal ones the larger text. Rows without a key give no rows. Unreadable or absent
    sections leave the other boundaries, as do section offsets at which no line begins in the text; of several paging
    rows of a key a readable one counts. Of the texts only oversized ones are shuffled, for the join with their sections.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of the limit")
    t = F.col(f"`{text}`").cast("string")
    rows = texts.where((F.length(t) > limit) & F.col(f"`{key}`").isNotNull())
    at = F.col(f"`{order}`") if order in texts.columns else F.lit(0)
    rows = rows.groupBy(F.col(f"`{key}`").alias("k")).agg(F.max(F.struct(at.alias("o"), t.alias("t"))).alias("x")).select("k", F.col("x.t").alias("t"))
    if paging is not None:
        s = paging.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k2")).agg(F.max(F.struct(F.try_parse_json(F.col(f"`{sections}`").cast("string")).isNotNull().alias("r"), F.col(f"`{sections}`").cast("string").alias("j"))).alias("x"))
        s = s.select("k2", F.col("x.j").alias("s"))
        rows = rows.join(s, rows.k == s.k2, "left").select("k", "t", "s")
    else:
        rows = rows.select("k", "t", F.lit(None).cast("string").alias("s"))
    kind = T.StructType(
        [T.StructField("k", texts.schema[key].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("no", "a", "z")]
        + [T.StructField(c, T.StringType()) for c in ("cut", "piece")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, held = [], [], 0

            def full() -> pa.RecordBatch:
                no, a, z, cut, piece = zip(*out)
                cols = [pa.array(c, t) for c, t in ((no, pa.int64()), (a, pa.int64()), (z, pa.int64()), (cut, pa.string()), (piece, pa.string()))]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], ["k", "no", "a", "z", "cut", "piece"])

            for i, (body, given) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for no, (a, z, cut) in enumerate(split_text(body, section_ends(given), limit, overlap)):
                    at.append(i)
                    out.append((no, a, z, cut, body[a:z]))
                    held += z - a
                if held > 4_000_000:
                    yield full()
                    at, out, held = [], [], 0
            if out:
                yield full()

    return rows.mapInArrow(run, kind).select(
        F.col("k").alias(key), F.col("no").alias("piece_no"), F.col("a").alias("start_char"), F.col("z").alias("end_char"), "cut", "piece"
    )
