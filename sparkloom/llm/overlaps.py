"""Same or near-same records across the splits of a data set.

Method: the state text of a record becomes the set of its 3-character shingles; minwise signatures in bands make
candidates of an evaluation and a training text that share a bucket of one snapshot (pairs within a split are never
formed); the exact Jaccard similarity of the two sets decides. Equal texts are one text throughout, so copies cost a
row and not a pair. With 36 bands of 6 a pair of similarity 0.8 is missed with probability 2e-5.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import minhash
from sparkloom.plans.durable import durable
from sparkloom.plans.skew import lookup, spread_join

BANDS, ROWS, SIMILARITY = 36, 6, 0.8


def decoded(text: object) -> object:
    """The JSON value of a field, encoded once or more often; None for what isn't JSON."""
    while isinstance(text, str):
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return text


def _shown(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def state_text(record: str | None) -> str | None:
    """The state of a record in its plain form, or None where there is none.

    For each member in order of its name, name and value joined by blanks; NFKC, lower case, runs of letters and
    digits joined by single blanks. Lone surrogates count as other characters do that are neither letter nor digit.
    """
    value = decoded(record)
    state = value.get("state") if isinstance(value, dict) else None
    if isinstance(state, str):
        state = decoded(state)
    if not isinstance(state, dict):
        return None
    text = " ".join(f"{k} {_shown(state[k])}" for k in sorted(state))
    return " ".join(minhash.words_of(unicodedata.normalize("NFKC", text)))


def _text_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(state_text, b.column(2).to_pylist()), pa.string())], ["id", "scope", "t"])

    return rows.mapInArrow(run, "id string, scope string, t string")


def _bands_of(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [minhash.bands(minhash.char_shingles(t), BANDS, ROWS) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["tid", "bands"])

    return texts.select("tid", "t").mapInArrow(run, "tid binary, bands array<long>")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """tid_e, tid_t, similarity of the pairs (tid_e, tid_t, e, t) whose texts' shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, object] = {}

            def of(text: str):
                if text not in sets:
                    sets[text] = minhash.char_shingles(text)
                return sets[text]

            scores = [minhash.jaccard(of(x), of(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            good = pa.array([s >= least for s in scores], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["tid_e", "tid_t", "similarity"]).filter(good)

    return pairs.select("tid_e", "tid_t", "e", "t").mapInArrow(run, "tid_e binary, tid_t binary, similarity double")


def members(candidates: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, rows): texts tid, t; rows snapshot_id, candidate_id, split_name, train, hash, scope, tid of each assignment.

    Of several rows of a candidate the one latest by updated_at counts, of equally late ones the larger. Rows without
    snapshot or candidate are left out, so are splits other than train, calibration and test. Candidates that are no
    longer stored, or whose state can't be read, have no text (tid null); a blank hash is none.
    """
    c = candidates.where(F.col("candidate_id").isNotNull()).groupBy(F.col("candidate_id").alias("id"))
    c = c.agg(F.max(F.struct("updated_at", "candidate_json", "repository_scope")).alias("x")).select("id", F.col("x.repository_scope").alias("scope"), F.col("x.candidate_json").alias("j"))
    read = durable(_text_of(c).withColumn("tid", F.unhex(F.md5("t"))))
    texts = read.where(F.length("t") >= 3).select("tid", "t").dropDuplicates(["tid"])
    known = read.select(F.col("id").alias("candidate_id"), "scope", F.when(F.length("t") >= 3, F.col("tid")).alias("tid"))
    a = assignments.where(F.col("snapshot_id").isNotNull() & F.col("candidate_id").isNotNull() & F.col("split_name").isin("train", "calibration", "test"))
    a = a.select("snapshot_id", "candidate_id", "split_name", (F.col("split_name") == "train").alias("train"), F.nullif(F.trim("content_hash"), F.lit("")).alias("hash")).distinct()
    return texts, durable(lookup(a, known, ["candidate_id"]))


def overlaps(candidates: DataFrame, assignments: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """snapshot_id, eval_id, train_id, split_name, scope: every pair of an evaluation and a training candidate of one
    snapshot that have the same hash or near-same states; scope is the evaluation candidate's.

    A candidate is no pair with itself. Empty tables give an empty result; other columns aren't read.
    """
    texts, rows = members(candidates, assignments)
    # snapshots are carried as 64-bit digests; the names themselves are compared when the members are joined
    rows = rows.withColumn("sid", F.xxhash64("snapshot_id"))
    sides = rows.where(F.col("tid").isNotNull()).select("sid", "tid", "train").distinct()
    keyed = lookup(sides, _bands_of(texts), ["tid"], "inner")
    keyed = keyed.select("sid", "tid", "train", F.posexplode("bands").alias("band", "h"))
    keyed = durable(keyed.select(F.xxhash64("sid", "band", "h").alias("bucket"), "sid", "tid", "train"))
    e = keyed.where("NOT train").select("bucket", "sid", F.col("tid").alias("tid_e"))
    t = keyed.where("train").select("bucket", F.col("sid").alias("sid_t"), F.col("tid").alias("tid_t"))
    met = spread_join(t, e, ["bucket"]).where("sid = sid_t").select("sid", "tid_e", "tid_t").distinct()
    met = durable(met)
    pairs = met.where("tid_e <> tid_t").select("tid_e", "tid_t").distinct()
    pairs = lookup(pairs, texts.select(F.col("tid").alias("tid_e"), F.col("t").alias("e")), ["tid_e"], "inner")
    pairs = lookup(pairs, texts.select(F.col("tid").alias("tid_t"), "t"), ["tid_t"], "inner")
    near = durable(met.join(_verified(pairs, least).drop("similarity"), ["tid_e", "tid_t"]).unionByName(met.where("tid_e = tid_t")))
    held = rows.where("NOT train").select("sid", "snapshot_id", F.col("candidate_id").alias("eval_id"), "split_name", "scope", F.col("tid").alias("tid_e"), "hash")
    given = rows.where("train").select("sid", F.col("snapshot_id").alias("snapshot_t"), F.col("candidate_id").alias("train_id"), F.col("tid").alias("tid_t"), "hash")
    by_state = spread_join(spread_join(near, held.drop("hash"), ["sid", "tid_e"]), given.drop("hash"), ["sid", "tid_t"])
    by_hash = spread_join(given.drop("tid_t").where("hash IS NOT NULL"), held.drop("tid_e"), ["sid", "hash"])
    out = ["snapshot_id", "eval_id", "train_id", "split_name", "scope"]
    return by_state.where("snapshot_id = snapshot_t").select(*out).unionByName(by_hash.where("snapshot_id = snapshot_t").select(*out)).where("eval_id <> train_id").distinct()
