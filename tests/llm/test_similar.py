import json

import numpy as np

from sparkloom.llm import similar as S

SCHEMA = "record_id string, embedding string, embedding_space_id string, dimension long, created_at timestamp, id string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(r, e, s, d, None, "x", "y") for r, e, s, d in rows], SCHEMA)


def usable(spark, rows):
    return S.vectors(frame(spark, rows), "record_id", "embedding", "embedding_space_id", "dimension", "created_at")


def brute(vectors, k, floor):
    ids = sorted(vectors)
    out = set()
    for a in ids:
        near = sorted((-round(float(vectors[a] @ vectors[b]), 6), b) for b in ids if b != a)[:k]
        out |= {(a, b) for s, b in near if -s >= floor}
    return out


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24))
    made = {f"r{i:04d}": centres[i % 40] + 0.3 * rng.standard_normal(24) for i in range(800)}
    rows = [(i, json.dumps([round(float(x), 5) for x in v]), "a", 24) for i, v in made.items()]
    got = {(r.id, r.neighbour) for r in S.most_similar(usable(spark, rows), 5, 0.8).collect()}
    unit = {i: np.round(v, 5) / np.linalg.norm(np.round(v, 5)) for i, v in made.items()}
    want = brute(unit, 5, 0.8)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_without_floor_recall(spark):
    rng = np.random.default_rng(2)
    made = {f"r{i:04d}": rng.standard_normal(16) for i in range(400)}
    rows = [(i, json.dumps(list(map(float, v))), "a", 16) for i, v in made.items()]
    got = {(r.id, r.neighbour) for r in S.most_similar(usable(spark, rows), 5).collect()}
    want = brute({i: v / np.linalg.norm(v) for i, v in made.items()}, 5, -1)
    assert len(got & want) >= 0.9 * len(want)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    bits, scalars = S.encode(x, centre)
    guess, bound = S.estimate(x[:50], centre, bits, scalars)
    assert (np.abs(guess - x[:50] @ x.T) <= bound + 1e-5).mean() > 0.97
    assert bits.shape == (500, 8)


def test_equal_vectors_ties_spaces_and_bad_input(spark):
    same = json.dumps([1.0, 2.0, 3.0])
    rows = [(f"c{i}", same, "a", 3) for i in range(9)] + [("c1", same, "a", 3)]  # copies, one delivered twice
    rows += [("o", same, "b", 3), ("n", same, None, 0), ("e", same, "", 0), ("scaled", json.dumps([2.0, 4.0, 6.0]), "a", 0)]
    bad = [None, "", "[", "[]", "[0, 0]", "[1, null]", "[1, NaN]", '["1"]', "{}", "[true, 1]", "[1e999, 1]"]
    rows += [(f"bad{i}", e, "a", 0) for i, e in enumerate(bad)] + [("short", "[1.0, 2.0]", "a", 3), (None, same, "a", 3)]
    got = {}
    for r in S.most_similar(usable(spark, rows), 5, 0.8).collect():
        got.setdefault((r.space, r.id), []).append(r.neighbour)
    assert sorted(got["a", "c7"]) == ["c0", "c1", "c2", "c3", "c4"] and sorted(got["a", "c0"]) == ["c1", "c2", "c3", "c4", "c5"]
    assert sorted(got["a", "scaled"]) == ["c0", "c1", "c2", "c3", "c4"]
    assert got["", "n"] == ["e"] and ("b", "o") not in got and not any("bad" in i or i == "short" for _, i in got)


def test_empty(spark):
    assert S.most_similar(usable(spark, []), 5).count() == 0


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(S, "BLOCK_VECTORS", 16)
    rng = np.random.default_rng(4)
    made = {f"r{i:03d}": np.ones(8) + 0.2 * rng.standard_normal(8) for i in range(90)}
    rows = [(i, json.dumps(list(map(float, v))), "a", 8) for i, v in made.items()]
    got = {(r.id, r.neighbour) for r in S.most_similar(usable(spark, rows), 5, 0.8).collect()}
    assert len(got & brute({i: v / np.linalg.norm(v) for i, v in made.items()}, 5, 0.8)) >= 0.98 * 450
