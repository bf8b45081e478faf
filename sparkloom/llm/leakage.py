"""Evaluation texts inside training texts, by a broadcast hash set of the evaluation n-grams.

The windows of n consecutive words of every training text are hashed (a vectorised polynomial over word numbers) and
looked up in the sorted hashes of the evaluation windows; each hit is verified word by word. The scan has no shuffle.
The evaluation texts are broadcast in blocks of BLOCK_CHARS characters and BLOCK_ITEMS items at most, one block after
the other, so there is one way for an evaluation set of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 12
#: Characters and items of one block of evaluation texts.
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 50_000
#: Fixed value: odd multiplier of the window hash.
MULTIPLIER = 0x9E3779B97F4A7C15

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the text in lower case."""
    return WORD.findall(text.lower()) if text else []


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case with their places in ``text``.

    Lower-casing may lengthen a text (one character becomes two); then places are found character by character.
    """
    low = text.lower()
    found = list(WORD.finditer(low))
    if len(low) == len(text):
        return [m.group() for m in found], [m.span() for m in found]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    if len(origin) != len(low):
        origin += [len(text) - 1] * (len(low) - len(origin))
    return [m.group() for m in found], [(origin[m.start()], origin[m.end() - 1] + 1) for m in found]


class EvalIndex:
    """The evaluation windows of a block: word numbers of all items in a row, and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple], size: int = WINDOW) -> None:
        self.size = size
        self.number: dict[str, int] = {}
        self.items: list = []
        runs, starts = [], []
        at = 0
        for item, text in items:
            words = words_of(text)
            if len(words) < size:
                continue
            runs.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), dtype=np.uint64, count=len(words)))
            starts.append(at)
            self.items.append(item)
            at += len(words)
        self.words = np.concatenate(runs) if runs else np.zeros(0, dtype=np.uint64)
        self.starts = np.array(starts, dtype=np.int64)
        places = np.concatenate([s + np.arange(len(r) - size + 1) for s, r in zip(starts, runs)]) if runs else np.zeros(0, dtype=np.int64)
        hashes = self.hash(np.stack([self.words[places + k] for k in range(size)])) if len(places) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order].astype(np.int64)

    def hash(self, columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                h = (h + c) * np.uint64(MULTIPLIER)
                h ^= h >> np.uint64(29)
        return h

    def hits(self, texts: list[list[str]]) -> list[list[tuple[int, set]]]:
        """For each list of words the verified windows in it: (first word, items that hold the window)."""
        size, get = self.size, self.number.get
        flat = np.fromiter((get(w, 0) for words in texts for w in words), dtype=np.uint64)
        out: list[list] = [[] for _ in texts]
        if len(flat) < size or not len(self.hashes):
            return out
        # a window with a word unknown to the evaluation texts can't match
        run = np.concatenate([[0], np.cumsum(flat == 0)])
        at = np.flatnonzero(run[size:] == run[:-size])
        ends = np.cumsum([len(x) for x in texts])
        owner = np.searchsorted(ends, at, side="right")
        inside = at + size <= ends[owner] if len(at) else np.zeros(0, dtype=bool)
        at, owner = at[inside], owner[inside]
        if not len(at):
            return out
        h = self.hash(np.stack([flat[at + k] for k in range(size)]))
        low, high = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
        for n in np.flatnonzero(high > low).tolist():
            i, k = int(at[n]), int(owner[n])
            places = self.places[low[n] : high[n]]
            same = (self.words[places[:, None] + np.arange(size)] == flat[i : i + size]).all(axis=1)
            if same.any():
                items = {self.items[j] for j in (np.searchsorted(self.starts, places[same], side="right") - 1).tolist()}
                out[k].append((i - (int(ends[k]) - len(texts[k])), items))
        return out


def blocks(items: DataFrame, item_key: str, item_text: str, size: int, chars: int = 0) -> list:
    """The broadcast indexes of the evaluation texts, each of bounded size; equal rows count once."""
    rows = items.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("k IS NOT NULL AND length(t) > 0").distinct()
    sc = items.sparkSession.sparkContext
    out, part, held = [], [], 0
    for r in rows.toLocalIterator():  # a block at a time is on the driver
        part.append((r.k, r.t))
        held += len(r.t)
        if held >= (chars or BLOCK_CHARS) or len(part) >= BLOCK_ITEMS:
            out.append(sc.broadcast(EvalIndex(part, size)))
            part, held = [], 0
    if part or not out:
        out.append(sc.broadcast(EvalIndex(part, size)))
    return out


def find_leaks(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, size: int = WINDOW, chars: int = 0
) -> DataFrame:
    """``key``, ``item_key``: one row for each document and item that share ``size`` consecutive words.

    Words are runs of letters and digits in lower case. Null, empty and shorter texts share nothing. A document that
    stands twice under one key comes out once. Items with a null key are left out. ``chars`` sets another block size.
    """
    dk, ik = docs.schema[key].dataType, items.schema[item_key].dataType
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = T.StructType([T.StructField("k", dk), T.StructField("i", T.ArrayType(ik))])

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = index.value.hits([words_of(t) for t in b.column(1).to_pylist()])
                found = [(n, sorted(set().union(*(i for _, i in h)))) for n, h in enumerate(hits) if h]
                take = b.column(0).take(pa.array([n for n, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([take, pa.array([x for _, x in found], T_ARROW(ik))], ["k", "i"])

        return rows.mapInArrow(run, kind)

    parts = [scan(index) for index in blocks(items, item_key, item_text, size, chars)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select(F.col("k").alias(key), F.explode("i").alias(item_key)).distinct()


def T_ARROW(item_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(to_arrow_type(item_type))


def cut_spans(text: str, index: EvalIndex) -> tuple[str, int]:
    """(text without the passages of the index, passages cut).

    Overlapping hits form one span, from its first word's first to its last word's last character. What is left is
    read again, as cutting may bring words together, until nothing is found.
    """
    cut = 0
    while True:
        (hits,) = index.hits([words_of(text)])
        if not hits:
            return text, cut
        _, places = word_spans(text)
        merged: list[list[int]] = []
        for j in sorted(j for j, _ in hits):
            a, z = places[j][0], places[j + index.size - 1][1]
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        keep, at = [], 0
        for a, z in merged:
            keep.append(text[at:a])
            at = z
        text = "".join(keep) + text[at:]
        cut += len(merged)


def remove_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, size: int = WINDOW, chars: int = 0) -> DataFrame:
    """``key``, clean_text, n_spans, n_chars_removed of every document: leaked passages cut out, block after block.

    ``find_leaks`` finds nothing in what one block leaves. A document without a hit keeps its text as it is; a null
    text stays null.
    """
    kind = T.StructType(
        [T.StructField("k", docs.schema[key].dataType), T.StructField("c", T.StringType()), T.StructField("s", T.LongType()), T.StructField("r", T.LongType())]
    )

    def clean(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, spans, removed = (b.column(n).to_pylist() for n in (1, 2, 3))
                for n, h in enumerate(index.value.hits([words_of(t) for t in texts])):
                    if h:
                        left, cut = cut_spans(texts[n], index.value)
                        spans[n] += cut
                        removed[n] += len(texts[n]) - len(left)
                        texts[n] = left
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.int64()), pa.array(removed, pa.int64())], ["k", "c", "s", "r"])

        return run

    zero = F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("c"), zero.alias("s"), zero.alias("r"))
    for index in blocks(items, item_key, item_text, size, chars):
        rows = rows.mapInArrow(clean(index), kind)
    return rows.select(F.col("k").alias(key), F.col("c").alias("clean_text"), F.col("s").alias("n_spans"), F.col("r").alias("n_chars_removed"))


def drop_leaking(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that share no passage with any item."""
    return docs.join(find_leaks(docs, key, text, items, item_key, item_text, size).select(key).distinct(), key, "left_anti")
