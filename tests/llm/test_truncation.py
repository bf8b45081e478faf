import random

import pytest

from sparkloom.llm import truncation as T

NOUNS = "archive ledger snapshot cursor broker lease digest shard worker metric page route".split()


def sentence(r):
    return f"The {r.choice(NOUNS)} of the {r.choice(NOUNS)} was {r.choice(['trimmed', 'merged', 'stored'])} after {r.randint(2, 99)} retries."


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(300):
        rows.append((i, " ".join(sentence(r) for _ in range(5)), "note"))
    for i in range(300, 500):
        rows.append((i, "\n".join(f"2026-01-{r.randint(10, 28)} level=info part={r.choice(NOUNS)} ms={r.randint(1, 999)}" for _ in range(5)), "log"))
    for i in range(500, 560):
        rows.append((i, "\n".join(f"- {r.choice(['trim', 'merge', 'store'])} the {r.choice(NOUNS)}" for _ in range(4)), "list"))
    rows += [(i, "All is well here. -- end of note", "note") for i in range(600, 606)]
    return rows


CUT = {
    1000: ("The archive of the ledger was merged after 3 retries. The worker of the sna", "note"), 1001: ("The archive was merged after 3 retries. The page of the", "note"), 1002: ("The archive was merged. The pag...", "note"), 1003: ("The archive was merged. [cut]", "note"),
    1004: ("2026-01-10 level=info part=page ms=3\n2026-01-11 level=in", "log"), 1005: ("- trim the page\n- merge the", "list"), 1006: ("- trim the page\n- merge the snaps", "list"), 1007: ("The archive was mer�", "note"),
}
WHOLE = {2000: ("", "note"), 2001: ("Fine.", "note"), 2002: ("And so on...", "note"), 2003: ("It was merged. To be continued…", "note"), 2004: ("All stored. Done ✅", "note"), 2005: ("2026-01-10 level=info part=page ms=3", "log"), 2006: ("- store the lease", "list"), 2007: (None, "note"), 2008: ('He said: "Merged."', "note")}


def test_cut_and_whole(spark):
    rows = corpus() + [(k, *v) for k, v in (CUT | WHOLE).items()]
    copy = " ".join(sentence(random.Random(9)) for _ in range(1)) + " " + " ".join(sentence(random.Random(k)) for k in range(12))
    rows += [(3000, copy, "list"), (3001, copy[: len(copy) - 22], "list")]
    df = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], "doc_id long, text string, doc_kind string, source string, cut int")
    got = {r.doc_id: (r.cut, r.reason) for r in T.truncated(df, "doc_id", "text", "doc_kind", "source").collect()}
    assert {i for i in CUT if not got[i][0]} == set()
    assert {i for i in WHOLE if i in got and got[i][0]} == set()
    assert 2000 not in got and 2007 not in got  # empty and null texts aren't judged
    assert sum(got[i][0] for i, *_ in corpus()) == 0
    assert got[3001] == (True, "copy") and not got[3000][0]
    assert T.truncated(df.limit(0), "doc_id", "text", "doc_kind", "source").count() == 0


@pytest.mark.parametrize("a, b, cut", [("one two thr", "one two three four.", True), ("one two", "one two three four.", True), ("one two.", "one two three.", False), ("one two three", "one two three", False), ("", "x", False), ("one two ...", "one two three", True), ("one two", "one two\nthree four", False), ("one two", "one two. three", True)])
def test_ends_early(a, b, cut):
    assert T.ends_early(a, b) == cut


def copies(spark, rows):
    df = spark.createDataFrame([(i, t, "note", "s") for i, t in rows], "doc_id long, text string, doc_kind string, source string")
    return {r.doc_id for r in T.truncated(df, "doc_id", "text", "doc_kind", "source").collect() if r.reason == "copy"}


def test_cut_beside_longer_copies_that_go_on_otherwise(spark):
    r = random.Random(3)
    base = " ".join(sentence(r) for _ in range(12))
    at = base.rindex(" after")
    tail = " ".join(sentence(r) for _ in range(8))
    rows = [(0, base[: at - 3]), (1, base), (2, base[: len(base) // 4].rstrip()[:-2])]  # 1 alone goes on behind 0; of 2, a quarter is left
    rows += [(k, base[:at].rsplit(" ", 1)[0] + f" moved{k} after {k} retries. {tail}") for k in range(10, 14)]
    assert copies(spark, rows) == {0, 2}


@pytest.mark.parametrize("crowd", [0, 50])
def test_copies_are_those_of_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(T, "CROWD", crowd)
    r = random.Random(8)
    texts = {"One", "One two", "One two three", "one two\nthree", "Caf\u00e9 au lait", "Cafe\u0301 au lait et", "Cut he [cut]", "Cut here [cut] and on", "a\u200bb c\u200bd", "a\u200bb c\u200bd e f"}
    for _ in range(12):
        words = [r.choice(NOUNS) for _ in range(r.choice([3, 5, 6, 8, 40]))]
        for _ in range(30):
            some = [w if r.random() > 0.03 else r.choice(NOUNS) for w in words] + [r.choice(NOUNS) for _ in range(r.choice([0, 0, 4, 60]))]
            t = " ".join(some)
            texts.add(t[: r.randint(2, len(t))] + r.choice(["", "", ".", " [cut]", "...", "\nend"]))
    rows = list(enumerate(sorted(texts)))
    open_ = [(i, t) for i, t in rows if T.closing(t)[0] != "complete"]
    want = {i for i, t in open_ if any(t != u and T.ends_early(t, u) and T.head_similarity(t, u) >= T.SIMILARITY for _, u in rows)}
    assert len(want) > 20
    assert copies(spark, rows) == want
