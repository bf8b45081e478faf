import json

import pytest

from sparkloom import queries_records as Q
from sparkloom.operators import nested

MEMBERS = Q.MEMBERS


def held(v):
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            pass
    return v


def brute(text):
    """(object_path, parent_path) by a plain walk."""
    v = text
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return set()
    out = set()

    def walk(x, path, parent):
        x = held(x)
        if isinstance(x, dict):
            for k, y in x.items():
                y = held(y)
                if k in MEMBERS and isinstance(y, (dict, list)):
                    for i, e in enumerate([y] if isinstance(y, dict) else y):
                        here = f"{path}.{k}[{i}]"
                        if isinstance(held(e), dict):
                            out.add((here, parent))
                            walk(e, here, here)
                        else:
                            walk(e, here, parent)
                else:
                    walk(y, f"{path}.{k}", parent)
        elif isinstance(x, list):
            for i, e in enumerate(x):
                walk(e, f"{path}[{i}]", parent)

    walk(v, "$", "$")
    return out


SPAN = {"start": 1, "end": 2}
FIELDS = [
    {"a": {"events": [{"checks": [{"spans": [SPAN, None, SPAN]}, 3]}, None, {"x": 1}]}}, {"events": {"checks": json.dumps([{"spans": json.dumps({"s": 1})}])}}, {"events": []}, {"events": "text"}, {"events": [[{"spans": [SPAN]}]]},
    {"z": [[{"marks": [{}]}], {"tiles": {"marks": [SPAN]}}]}, {"children": [{"children": [{"children": [{"n": 1}]}]}]}, [{"spans": [SPAN]}], [], {}, 3, None, {"spans": [{"events": {"spans": {}}}]},
]


def texts():
    out = [json.dumps(f) for f in FIELDS]
    return out + [json.dumps(t) for t in out] + [json.dumps(json.dumps(out[0]))] + [None, "", "{", "nonsense", '{"spans": [{"a": 1}]', '{"spans":[{"a":1}],"spans":[{"a":2},{"a":3}]}', '{"spans": [{"a": NaN}]}']


def frame(spark):
    rows = [(f"r{i}", t, "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, texts()[0], "x", "y")], "id string, j string, row_key string, v string")


def test_equal_to_a_plain_walk(spark):
    got = {}
    found = nested.nested_objects(frame(spark), "id", "j", MEMBERS, attributes=False).collect()
    for r in found:
        got.setdefault(r.row_key, set()).add((r.object_path, r.parent_path))
    want = {f"r{i}": brute(t) for i, t in enumerate(texts()) if t and "NaN" not in t and brute(t)}
    assert got == want
    ids = {(r.row_key, r.object_path): r.object_id for r in found}
    assert len(set(ids.values())) == len(ids)
    assert all(r.parent_id == ids[r.row_key, r.parent_path] for r in found if r.parent_path != "$")


def test_attributes_keep_names_apart_and_numbers_whole(spark):
    value = {"a.b": 1, "a": {"b": 2, "c": [1, 2]}, "n": 9007199254740993123, "t": "x", "z": None, "f": 0.5, "spans": [{"k": True}, {"k": "mixed"}], "more": [{"not": "listed"}]}
    df = spark.createDataFrame([("r", json.dumps(value))], "id string, j string")
    rows = {r.object_path: r.attributes for r in nested.nested_objects(df, "id", "j", ["spans"], root_row=True).collect()}
    assert rows["$"] == {"['a.b']": "1", "a.b": "2", "a.c": "[1,2]", "n": "9007199254740993123", "t": '"x"', "z": None, "f": "0.5"} | {k: v for k, v in rows["$"].items() if k.startswith("more")}
    tables = nested.child_tables(nested.nested_objects(df, "id", "j", ["spans"], root_row=True))
    root = tables["$"].first().asDict()
    assert int(root["a_n"]) == 9007199254740993123 and root["a_a.b"] == 2 and root["a_['a.b']"] == 1 and root["a_t"] == "x" and root["a_f"] == 0.5
    assert sorted((r.ordinal, r.a_k) for r in tables["$.spans"].collect()) == [(0, "true"), (1, "mixed")]


def test_without_listed_members_every_array_is_a_table(spark):
    df = spark.createDataFrame([("r", json.dumps({"a": [{"b": [{"c": 1}]}]}))], "id string, j string")
    assert sorted(r.object_path for r in nested.nested_objects(df, "id", "j").collect()) == ["$.a[0]", "$.a[0].b[0]"]


def test_empty(spark):
    assert nested.nested_objects(frame(spark).limit(0), "id", "j", MEMBERS).count() == 0
    with pytest.raises(ValueError):
        nested.child_tables(nested.nested_objects(frame(spark), "id", "j", MEMBERS), max_columns=1)


def test_registered_tables(spark, tmp_path):
    candidate = {"category": "c", "evidence_ids": ["e1"], "state": {"n": 3}, "model_reviews": [{"score": 0.5, "checks": [{"name": "k", "spans": [{"start": 1}]}]}]}
    artifact = {"kind": "page", "size_bytes": 7, "capture": {"viewport": {"w": 9}, "tiles": [{"x": 1}]}, "sources": [{"spans": [{"start": 4}]}]}
    for (t, (k, f)), value in zip(Q.FIELDS.items(), (candidate, artifact, {"names": ["a"], "truncated": False})):
        row = ("id", json.dumps(value))
        spark.createDataFrame([row, row], f"{k} string, {f} string").write.parquet(f"{tmp_path}/{t}.parquet")
    base = str(tmp_path)
    schema = {(r.source_table, r.table_path, r.attribute) for r in Q.QUERIES["p4_schema"](spark, base).collect()}
    assert {("laya_candidates", "$", "state.n"), ("artifacts", "$", "capture.viewport.w"), ("artifact_paging_metadata", "$", "truncated")} <= schema
    read = lambda name: [r.asDict() for r in Q.QUERIES[name](spark, base).collect()]
    (root,) = read("p4_table_laya_candidates")
    assert (root["object_path"], root["a_category"], root["a_evidence_ids"], root["a_state.n"]) == ("$", "c", '["e1"]', 3)
    spans = sorted((r["source_table"], r["parent_path"], r["a_start"]) for r in read("p4_table_spans"))
    assert spans == [("artifacts", "$.sources[0]", 4), ("laya_candidates", "$.model_reviews[0].checks[0]", 1)]
    assert read("p4_table_events") == []
