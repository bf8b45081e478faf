import json

import pytest

from sparkloom.llm import minhash, overlaps

CANDIDATES = "candidate_id string, repository_scope string, candidate_json string, updated_at timestamp, t string"
ASSIGNED = "snapshot_id string, candidate_id string, split_name string, content_hash string, scope string"
TEXT = "the verified archive of the snapshot trims the oversized ledger after retries and leaves the cursor open for " * 3


def record(text, **more):
    return json.dumps({"state": {"b": text, "a": 7} | more})


def run(spark, candidates, assigned):
    c = spark.createDataFrame([(i, "/ws/x", j, None, "") for i, j in candidates], CANDIDATES)
    a = spark.createDataFrame([(*r, "") for r in assigned], ASSIGNED)
    return sorted((r.snapshot_id, r.eval_id, r.train_id) for r in overlaps.overlaps(c, a).collect())


def test_state_text():
    assert overlaps.state_text('{"state": {"b": "Ｘ-ray É_1", "a": 3, "c": null}}') == "a 3 b x ray é 1 c"
    assert overlaps.state_text(json.dumps(record("Hi"))) == overlaps.state_text(record("Hi")) == "a 7 b hi"
    assert [overlaps.state_text(x) for x in (None, "", "[1]", "{", '{"state": 3}', '{"state": null}')] == [None] * 6


def test_cases(spark):
    near = TEXT.replace("archive", "archives", 1)
    candidates = [("t1", record(TEXT)), ("t1", record(TEXT)), ("t2", record("something else entirely, about boats")), ("e1", record(near)), ("e2", record(TEXT)), ("e3", "{"), ("e4", record("x")), ("t4", record("x")), ("n", None)]
    assigned = [("s", "t1", "train", ""), ("s", "t1", "train", ""), ("s", "t2", "train", "h"), ("s", "e1", "test", ""), ("s", "e2", "calibration", " "), ("s", "e3", "test", "h"), ("u", "e2", "test", None),
                ("s", "gone", "test", "h"), (None, "t1", "train", ""), ("s", None, "test", "h"), ("s", "n", "test", ""), ("s", "e4", "test", ""), ("s", "t4", "train", "")]
    got = run(spark, candidates, assigned)
    assert ("s", "e1", "t1") in got and ("s", "e2", "t1") in got
    assert [g for g in got if g[1] in ("e3", "gone")] == [("s", "e3", "t2"), ("s", "gone", "t2")]
    assert not any(g[0] == "u" or g[1] == "n" for g in got)
    assert ("s", "e4", "t4") in got  # equal states of three characters or more


def test_empty(spark):
    assert run(spark, [], []) == []


def test_equal_to_brute_force(spark):
    words = TEXT.split()
    texts = {f"c{i:02d}": " ".join(w + "s" * ((i * k) % 11 == 3) for k, w in enumerate(words)) + f" {i}" for i in range(40)}
    split = {c: ("train", "train", "test", "calibration")[i % 4] for i, c in enumerate(texts)}
    sets = {c: minhash.char_shingles(overlaps.state_text(record(t))) for c, t in texts.items()}
    want = sorted(("s", e, t) for e in texts for t in texts if split[t] == "train" and split[e] != "train" and minhash.jaccard(sets[e], sets[t]) >= 0.8)
    assert run(spark, [(c, record(t)) for c, t in texts.items()], [("s", c, split[c], "") for c in texts]) == want and want


@pytest.mark.parametrize("a, b, s", [("", "", 0), ("abcd", "abcd", 1), ("abcd", "bcde", 1 / 3), ("ab", "ab", 0)])
def test_jaccard(a, b, s):
    assert minhash.jaccard(minhash.char_shingles(a), minhash.char_shingles(b)) == pytest.approx(s)
