import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chunking as K


def whole(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, z, _), (b, _, _) in zip(pieces, pieces[1:]):
        assert z - a <= limit and b == z - overlap and b > a
    assert pieces[-1][1] - pieces[-1][0] <= limit
    assert "".join(text[a:z] if n == 0 else text[a + overlap : z] for n, (a, z, _) in enumerate(pieces)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n.!é️😀"), min_size=41, max_size=600), st.lists(st.integers(-5, 700), max_size=6))
def test_pieces_cover_the_text(text, sections):
    whole(text, K.split_text(text, sections, 40, 8), 40, 8)


def test_strongest_boundary_wins_and_offsets_are_verified():
    text = "word " * 500 + "\n\n# Head\n" + "word " * 500
    at = text.index("# Head")
    assert K.split_text(text, [at], 4000, 200)[0][1:] == (at, "section")
    assert K.split_text(text, [2004], 4000, 200)[0][2] == "paragraph"  # 2004 is inside a word
    assert K.split_text("x" * 9000, [], 4000, 200)[0][1:] == (4000, "hard")


def test_rows(spark):
    long = "line of words here.\n" * 400
    texts = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, long, 1), ("e", "é" * 4001, 1), ("f", "é" * 4000, 1)], "artifact_id string, text string, piece int")
    good = json.dumps({"sections": [{"start": 0, "end": 3800}]})
    paging = spark.createDataFrame([("a", "zz not json"), ("a", good), ("zz", None)], "artifact_id string, section_json string")
    got = K.split_oversized(texts, "artifact_id", "text", paging).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.piece_no):
        by.setdefault(r.artifact_id, []).append(r)
    assert set(by) == {"a", "e"}
    whole(long, [(r.start_char, r.end_char, r.cut) for r in by["a"]], 4000, 200)
    assert all(r.piece == long[r.start_char : r.end_char] for r in by["a"]) and by["a"][0].cut == "section" and by["a"][0].end_char == 3800
    assert K.split_oversized(texts.limit(0), "artifact_id", "text", paging).count() == 0
