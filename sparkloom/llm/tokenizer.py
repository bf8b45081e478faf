"""Encoding of a corpus with a byte-level BPE vocabulary by corpus-level merge replay.

Method. Each task treats its rows as a corpus: the texts are cut into words by the vocabulary's pattern, the
distinct words are laid out as one long row of byte tokens, and an inverted index from token pair to positions is
built. The merges present are then replayed in rank order, each touching only the positions of its pair and their
two neighbours. A word's ids depend on the word alone, so doing this task by task gives the ids a replay over the
whole corpus would give, without a shuffle: at any size the plan is scan, encode, write. Ids of words seen before
in a worker are kept in a bounded memory (a speed-up only; results don't depend on it).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words kept encoded in a worker; above it the memory is emptied.
KEEP_WORDS = 300_000
#: A vocabulary file above this size isn't broadcast.
MAX_VOCABULARY_BYTES = 64 << 20

_STATE: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The rank file ``name`` of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """``base64 rank`` lines to a map from token bytes to id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word. All words are merged together, pair by pair in rank order.

    Every single byte must be in ``ranks``. Equal pairs within a word merge from left to right.
    """
    piece: list[bytes | None] = []
    follow: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    index: dict[tuple[bytes, bytes], list[int]] = {}
    for w in words:
        base, n = len(piece), len(w)
        starts.append(base)
        for i in range(n):
            piece.append(w[i : i + 1])
            follow.append(base + i + 1 if i + 1 < n else -1)
            before.append(base + i - 1 if i else -1)
        for i in range(n - 1):
            index.setdefault((w[i : i + 1], w[i + 1 : i + 2]), []).append(base + i)
        if not n:
            piece.append(None)
            follow.append(-1)
            before.append(-1)
    heap = [(r, pair) for pair in index if (r := ranks.get(pair[0] + pair[1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        positions = index.pop(pair, None)
        if positions is None:
            continue
        left, right = pair
        merged = left + right
        positions.sort()
        for i in positions:
            j = follow[i]
            if piece[i] != left or j < 0 or piece[j] != right:
                continue
            k = follow[j]
            piece[i], piece[j] = merged, None
            follow[i] = k
            if k >= 0:
                before[k] = i
                _note(index, heap, ranks, (merged, piece[k]), i)
            h = before[i]
            if h >= 0:
                _note(index, heap, ranks, (piece[h], merged), h)
    out = []
    for at, w in zip(starts, words):
        ids = []
        i = at if w else -1
        while i >= 0:
            ids.append(ranks[piece[i]])
            i = follow[i]
        out.append(ids)
    return out


def _note(index: dict, heap: list, ranks: dict, pair: tuple, position: int) -> None:
    known = index.get(pair)
    if known is not None:
        known.append(position)
    elif (r := ranks.get(pair[0] + pair[1])) is not None:
        index[pair] = [position]
        heapq.heappush(heap, (r, pair))


def _encoder(data: bytes, pattern: str):
    """The worker's ranks, compiled pattern and word memory; made once per worker and vocabulary."""
    import regex

    key = (hash(data), pattern)
    if _STATE.get("key") != key:
        _STATE.update(key=key, ranks=parse_ranks(data), find=regex.compile(pattern).findall, seen={})
    return _STATE["ranks"], _STATE["find"], _STATE["seen"]


def encode_texts(texts: list[str | None], data: bytes, pattern: str) -> list[list[int]]:
    """Ids of each text by the rank file ``data``; null and empty texts give []."""
    ranks, find, seen = _encoder(data, pattern)
    if len(seen) > KEEP_WORDS:
        seen.clear()
    cut = [find(t) if t else [] for t in texts]
    fresh = list({w for words in cut for w in words if w not in seen})
    for w, ids in zip(fresh, replay_merges([w.encode() for w in fresh], ranks)):
        seen[w] = ids
    out = []
    for words in cut:
        ids: list[int] = []
        for w in words:
            ids += seen[w]
        out.append(ids)
    return out


def _slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters together, to bound the working set of long texts."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_corpus(
    df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, out: str = "ids"
) -> DataFrame:
    """One row per row of ``df``: its ``key`` and ``ids`` (array of int) of its ``text``.

    Null and empty texts give the empty list. Repeated rows are encoded as often as they stand. Strings that look
    like special tokens are ordinary text. Other columns, whatever their names, aren't read. An empty table gives
    an empty result.
    """
    path = path or vocabulary_path()
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be broadcast")
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern()
    kind = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("v", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _slices(b.column(1).to_pylist()):
                ids = encode_texts(part, shared.value, pattern)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))], ["k", "v"])
                at += len(part)

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, kind).select(F.col("k").alias(key), F.col("v").alias(out))
