"""Texts that were cut off before their end.

1. Near copies: a text that ends early is aligned with every text that has the five words before its last one, and a
   word that begins with the last one behind them; no pair that counts is left out. The pair counts if the shorter is
   similar to as much of the longer one's head. The copy whose alignment ends early, inside a word or without a stop, is cut.
2. All other texts are scored by how they close. Marks of a cut and torn characters decide at once. A text that ends
   neither in a stop nor in one of the forms its kind usually closes with is cut when its last line could be the
   beginning of a usual one, or when nearly all texts of its kind close in one form (a stop, say). Where forms say nothing the closing word does: a word
   that the corpus never puts at the end of a line or sentence, or the mere beginning of other words.
The forms of a kind, the phrases texts close with and the terminality of words are counted over the whole corpus. What
is broadcast is bounded by the shares that define it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import minhash
from sparkloom.plans.durable import durable
from sparkloom.plans.skew import lookup, spread_join

SIZE, SIMILARITY = 5, 0.8
#: Characters of a word that the join of near copies looks at; the alignment looks at all.
SHOWN = 16
#: Keys in more places than this are first tried with their longest text; so many texts needed at once are marked by a broadcast.
CROWD, FEW = 50, 100_000
#: The filter before that join has 128 bits for each key, but no more than 2 to this power (32 MB): past that it lets more rows through to the join, which is exact.
FILTER_BITS = 28
#: A form belongs to a kind when it closes this share of its texts; a kind is regular when its forms close that share.
FORM_SHARE, REGULAR_SHARE = 0.02, 0.8
#: Kinds and closing phrases that hold less than one in so many texts aren't looked at; so there are fewer than this.
ONE_IN = 1000
#: A word is no closing word when fewer of its uses than this close a line or sentence, out of at least so many.
TERMINALITY, USES = 0.01, 50

#: Marks that say that a text was cut.
MARKS = re.compile(r"\s*(?:\[\s*(?:cut|truncated|snip|snipped|more|continued|\.{3}|…)\s*\]|[(<]\s*(?:cut|truncated|snip|more)\s*[)>])\s*$", re.I)
ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…)\s*$")
#: Phrases that close a text without a stop, or with an ellipsis.
CLOSERS = re.compile(r"(?:to be continued|and so on|and so forth|etc|usw|und so weiter|et cetera|y así sucesivamente|end of (?:note|file|text|document|message)|\bdone|\bfin|\bende)[\s.…✅✓✔*_-]*$", re.I)
STOP = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Compatible characters unified, invisible ones left out, without white space at the end."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Mn"))
    return text.rstrip()


def form_of(line: str) -> str:
    """The shape of a line: words as w, numbers as 9, all else as it stands."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "w", line))).strip()


def closing(text: str) -> tuple[str, str, str, str]:
    """(verdict, form, last word, phrase): verdict is cut, complete or open.

    A stop, a closing phrase or a symbol that isn't part of a word completes a text; a mark or a torn character says
    that it is cut. The form of a text that ends in a stop is "stop", of any other the shape of its last line.
    """
    body = plain(text)
    if body.endswith("�") or MARKS.search(body):
        return "cut", "mark", "", ""
    bare = ELLIPSIS.sub("", body)
    words = WORD.findall(bare[-200:].lower())
    last, phrase = (words[-1] if words else ""), " ".join(words[-2:])
    if CLOSERS.search(bare[-60:]):
        return "complete", "closer", last, phrase
    if bare != body:
        return "ellipsis", "mark", last, phrase
    if not body or STOP.search(body[-8:]):
        return "complete", "stop", last, phrase
    if unicodedata.category(body[-1]) in ("So", "Sk") and not body[-1].isalnum():
        return "complete", "symbol", last, phrase
    return "open", form_of(body[body.rfind("\n") + 1 :]), last, phrase


class _Hashes(dict):
    """The 64-bit hash of each word asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(run: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        run = (run ^ h) * np.uint64(0x9E3779B97F4A7C15)
    return run ^ (run >> np.uint64(32))


def _runs(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hashes of the runs of ``size`` words, in their order."""
    run = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size):
        run = _mixed(run, h[k : k + len(run)])
    return run


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def shingles(text: str) -> tuple[np.ndarray, int]:
    """(distinct hashes of the runs of SIZE words, number of words); a shorter text is one run."""
    words = minhash.words_of(text)
    return np.unique(_runs(_hashed(words), min(SIZE, len(words)))) if words else np.zeros(0, dtype=np.uint64), len(words)


def head_similarity(short: str, long: str) -> float:
    """The similarity of ``short`` with as many words of the head of ``long``."""
    n = len(minhash.words_of(short))
    ends = [m.end() for m in WORD.finditer(long.lower())][:n] if n else []
    return minhash.jaccard(shingles(short)[0], shingles(long.lower()[: ends[-1]] if ends else "")[0])


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` is ``long`` cut off: its end lies inside a word, line or sentence of the other, which goes on."""
    a, b = plain(short), plain(long)
    bare = ELLIPSIS.sub("", MARKS.sub("", a))
    x, places = WORD.findall(bare.lower()), [m.span() for m in WORD.finditer(b.lower())]
    y = [b.lower()[i:j] for i, j in places]
    if not x or len(x) > len(y) or STOP.search(bare[-8:]):
        return False
    head, last = x[-6:-1], x[-1]
    for at in range(len(y) - len(head) - 1, -1, -1):
        if y[at : at + len(head)] == head and abs(at - (len(x) - 1 - len(head))) <= 0.25 * len(x) + 5:
            there = y[at + len(head)]
            if there != last and there.startswith(last):
                return True
            if there != last or at + len(head) + 1 >= len(y):
                return False
            return re.match(r"[^\S\n]*\r?\n", b.lower()[places[at + len(head)][1] :]) is None
    return False


def asked(text: str) -> tuple[list[int], str, int, int]:
    """(keys, last, low, high): any text that ``text`` ends early in, and is similar to, has one of the keys at a place from
    low to high with a word behind it that begins with ``last``; see ``_given``. No keys: there is no such text.

    What ends early has its last words but one in the other. Up to SIZE words are one run and similar only to the same
    ones. Where marks or compatible characters make more words than that of fewer, one of all the runs must be shared.
    """
    bare = ELLIPSIS.sub("", MARKS.sub("", plain(text)))
    x = WORD.findall(bare.lower())
    if not x or STOP.search(bare[-8:]):
        return [], "", 0, 0
    if len(x) > SIZE:
        key = _mixed(_runs(_hashed(x[-SIZE - 1 : -1])), np.uint64(ord(x[-1][0])))
        at, about = len(x) - 1 - SIZE, int(0.25 * len(x) + 5)
        return key.view(np.int64).tolist(), x[-1][:SHOWN], at - about, at + about
    return shingles(text)[0].view(np.int64).tolist(), "", 0, 0


def _read(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = [closing(t) for t in texts]
            keys = [asked(t) if e[0] != "complete" else ([], "", 0, 0) for t, e in zip(texts, ends)]
            verdict, form, last, phrase = zip(*ends) if ends else ((),) * 4
            key, torn, low, high = zip(*keys) if keys else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), b.column(4), *(pa.array(c, pa.string()) for c in (verdict, form, last, phrase)), pa.array(key, pa.list_(pa.int64())), pa.array(torn, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                ["id", "kind", "source", "tid", "verdict", "form", "last", "phrase", "keys", "torn", "low", "high"],
            )

    return rows.mapInArrow(run, "id long, kind string, source string, tid binary, verdict string, form string, last string, phrase string, keys array<long>, torn string, low int, high int")


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words): the bit at each key's first ``bits`` bits is set."""
    bits = min(FILTER_BITS, max(16, (128 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    held = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 AS int))")).alias("x")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    words = np.zeros(2 ** (bits - 6), dtype=np.uint64)
    words[held.column("w").to_numpy()] = held.column("x").to_numpy().view(np.uint64)
    return bits, words


def _given(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, other, at, next, n: the keys of each text that may be among ``keys``, the word at ``at`` + SIZE, the text's words.

    A key is a run of SIZE words with the first character of the next one, a run alone (at 0), or fewer words that begin the text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = shared.value
        seen = _Hashes()

        def known(key: np.ndarray) -> np.ndarray:
            slot = key >> np.uint64(64 - bits)
            return np.flatnonzero((held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))

        for b in batches:
            texts = b.column(1).to_pylist()
            words = [WORD.findall(plain(t).lower()) for t in texts]
            raw = [w if t.isascii() else minhash.words_of(t) for t, w in zip(texts, words)]
            found: list[tuple[np.ndarray, ...]] = []
            for each, begins in ((words, False), (raw, True)):
                n = np.fromiter(map(len, each), np.int64, len(each))
                start = np.cumsum(n) - n
                flat = list(chain.from_iterable(each))
                h = np.fromiter(map(seen.__getitem__, flat), np.uint64, len(flat))
                doc = np.repeat(np.arange(len(each)), n)
                runs = _runs(h)
                if not begins:
                    whole = np.flatnonzero(doc[:-SIZE] == doc[SIZE:])
                    key = _mixed(runs[whole], np.fromiter((ord(w[0]) for w in flat), np.uint64, len(flat))[whole + SIZE])
                    k = known(key)
                    at = whole[k]
                    found.append((key[k], doc[at], at - start[doc[at]], np.array([flat[i + SIZE][:SHOWN] for i in at], object)))
                    continue
                whole = np.flatnonzero(doc[: len(runs)] == doc[SIZE - 1 :])
                k = whole[known(runs[whole])]
                parts = [(runs[k], doc[k])]
                some, state = np.flatnonzero(n), np.zeros(len(each), np.uint64)
                for size in range(1, SIZE):
                    some = some[n[some] >= size]
                    state[some] = _mixed(state[some], h[start[some] + size - 1])
                    k = some[known(state[some])]
                    parts.append((state[k], k))
                for key, at in parts:
                    found.append((key, at, np.zeros(len(key), np.int64), np.full(len(key), "", object)))
            key, at, place, behind = (np.concatenate(c) for c in zip(*found))
            lengths = np.fromiter(map(len, words), np.int64, len(words))[at]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(4).take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(behind, pa.string()), pa.array(lengths)], ["key", "other", "at", "next", "n"])
            if len(seen) > 300_000:
                seen.clear()

    return rows.mapInArrow(run, "key long, other binary, at int, next string, n long").distinct()


def _uses(rows: DataFrame) -> DataFrame:
    """word, n, n_final: how often each word of the corpus stands, and how often before a stop or line end."""
    token = re.compile(r"([^\W_]+)([.!?:;,]?(?:[\"')\]]*(?:\r?\n|$))?)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, final = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(all_)
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([all_[w] for w in words], pa.int64()), pa.array([final[w] for w in words], pa.int64())], ["word", "n", "n_final"])
            all_.clear()
            final.clear()
            return made

        for b in batches:
            for t in b.column(1).to_pylist():
                found = token.findall(plain(t).lower())
                all_.update(w for w, _ in found)
                final.update(w for w, after in found[:-1] if after and after[0] not in ",:;")
            if len(all_) > 200_000:
                yield out()
        yield out()

    return rows.mapInArrow(run, "word string, n long, n_final long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))


def _shown(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """tid of the pairs (tid, other) in which the first text ends early in the other, to which it is similar."""
    pairs = durable(pairs.select("tid", "other").distinct())
    if pairs.isEmpty():
        return pairs.select("tid")
    needed = durable(pairs.select("tid").unionByName(pairs.select(F.col("other").alias("tid"))).distinct())
    texts = rows.select("tid", "t")
    texts = texts.join(F.broadcast(needed), "tid", "left_semi") if needed.count() <= FEW else lookup(texts, needed, ["tid"], "left_semi")
    texts = durable(texts.dropDuplicates(["tid"]))
    both = lookup(lookup(pairs, texts, ["tid"], "inner"), texts.select(F.col("tid").alias("other"), F.col("t").alias("u")), ["other"], "inner").select("tid", "t", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [ends_early(t, u) and head_similarity(t, u) >= SIMILARITY for t, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0)], ["tid"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "tid binary").distinct()


def _aligned(rows: DataFrame, read: DataFrame) -> DataFrame:
    """tid of the texts that a near copy shows to be cut. Equal texts are one.

    Every text is aligned with all that have one of its keys. Where these are many the longest one comes first, so that
    only what it doesn't show to be cut has to meet the others.
    """
    ends = read.where(F.size("keys") > 0).dropDuplicates(["tid"]).select("tid", "torn", "low", "high", F.explode("keys").alias("key"))
    given = durable(_given(rows, ends.select("key").distinct()))
    crowds = given.groupBy("key").agg(F.max(F.struct("n", "other")).alias("x"), F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD)
    ends = durable(lookup(ends, crowds.select("key", F.col("x.other").alias("first")), ["key"]))
    shown = durable(_shown(ends.where("tid <> first").select("tid", F.col("first").alias("other")), rows))
    rest = ends.join(shown, "tid", "left_anti")
    met = spread_join(given, rest, ["key"]).where("tid <> other AND NOT other <=> first AND at BETWEEN low AND high AND startswith(next, torn)")
    return shown.unionByName(_shown(met, rows))


def truncated(docs: DataFrame, key: str, text: str, kind: str, source: str) -> DataFrame:
    """``key``, ``source``, cut (boolean), reason of every text that isn't null or empty.

    reason is copy, mark, form, or word for cut texts and null for others. Rows that stand twice stand twice; a null
    kind or source is one of its own. Nothing is cut in an empty table.
    """
    t = F.col(f"`{text}`").cast("string")
    rows = docs.where(F.length(t) > 0).select(F.col(f"`{key}`").cast("long").alias("id"), t.alias("t"), F.coalesce(F.col(f"`{kind}`").cast("string"), F.lit("")).alias("kind"), F.col(f"`{source}`").cast("string").alias("source"), F.unhex(F.md5(t)).alias("tid"))
    read = durable(_read(rows))
    total = read.count()
    least = max(2, total // ONE_IN)

    forms = read.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.sum("n").over(W.partitionBy("kind")))
    forms = forms.where((F.col("of") >= least) & (F.col("n") >= FORM_SHARE * F.col("of"))).withColumn("held", F.sum("n").over(W.partitionBy("kind")) / F.col("of"))
    usual = [r.asDict() for r in forms.where(F.col("held") >= REGULAR_SHARE).select("kind", "form", (F.col("n") / F.col("of")).alias("share")).collect()]  # < ONE_IN / FORM_SHARE rows
    by_kind: dict[str, dict[str, float]] = {}
    for r in usual:
        by_kind.setdefault(r["kind"], {})[r["form"]] = r["share"]

    phrases = read.where("verdict IN ('open', 'ellipsis')").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = {r.phrase for r in phrases.collect()}  # < ONE_IN rows
    closers = _closers(rows, often)

    regular = F.lit(False) if not by_kind else F.col("kind").isin(list(by_kind))
    strict = [k for k, f in by_kind.items() if max(f.values()) >= REGULAR_SHARE]
    words = durable(_uses(rows))
    last = read.where("verdict = 'open'").select(F.col("last").alias("word")).distinct()
    heads = words.where("n >= 3").select(F.explode(F.expr("transform(sequence(1, least(length(word) - 1, 40)), i -> substring(word, 1, i))")).alias("word")).where("word <> ''").distinct().withColumn("head", F.lit(True))
    known = last.join(words, "word", "left").join(heads, "word", "left").select(F.col("word").alias("last"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_final", F.lit(0)).alias("n_final"), F.coalesce("head", F.lit(False)).alias("head"))
    scored = lookup(read.drop("keys", "torn", "low", "high"), known, ["last"])
    scored = lookup(scored, _aligned(rows, read).withColumn("copy", F.lit(True)), ["tid"])
    word = ~F.col("last").rlike(r"\d")  # numbers close anything
    never = word & (F.col("n") >= USES) & (F.col("n_final") < TERMINALITY * F.col("n"))
    torn = word & (F.col("n") <= 1) & F.col("head")
    closed = F.col("phrase").isin(list(closers)) if closers else F.lit(False)
    one_form = F.col("kind").isin(strict) if strict else F.lit(False)
    form_cut = regular & ~_among(by_kind) & (one_form | _begins(by_kind))
    reason = (
        F.when(F.col("copy"), "copy")
        .when(F.col("verdict") == "cut", "mark")
        .when((F.col("verdict") == "ellipsis") & ~closed, "mark")
        .when((F.col("verdict") == "open") & ~closed & form_cut, "form")
        .when((F.col("verdict") == "open") & ~closed & (never | torn), "word")
    )
    return scored.select(F.col("id").alias(key), F.col("source").alias(source), reason.isNotNull().alias("cut"), reason.alias("reason"))


def _among(by_kind: dict[str, dict[str, float]]) -> Column:
    """Whether the form is one its kind usually closes with."""
    at = F.lit(False)
    for k, fs in by_kind.items():
        at = at | ((F.col("kind") == k) & F.col("form").isin(list(fs)))
    return at


def _begins(by_kind: dict[str, dict[str, float]]) -> Column:
    """Whether the form, less what may be torn at its end, is the beginning of a usual form of its kind."""
    at = F.lit(False)
    head = F.regexp_replace("form", r"[w9]$", "")
    for k, fs in by_kind.items():
        for f in fs:
            if f not in ("stop", "closer", "symbol", "mark"):
                at = at | ((F.col("kind") == k) & (F.length("form") < len(f)) & F.lit(f).startswith(head))
    return at


def _closers(rows: DataFrame, often: set[str]) -> set[str]:
    """Of phrases that often stand last those that stand there in most of their uses."""
    if not often:
        return set()
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, final = Counter(), Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                words = WORD.findall(ELLIPSIS.sub("", plain(t)).lower())
                runs = [" ".join(p) for p in zip(words, words[1:])] or words
                n.update(r for r in runs if r in shared.value)
                if runs and runs[-1] in shared.value:
                    final[runs[-1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([final[k] for k in n], pa.int64())], ["phrase", "n", "last"])

    counts = rows.mapInArrow(run, "phrase string, n long, last long").groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    return {r.phrase for r in counts.where("last > 0.5 * n").collect()}
