from sparkloom.llm import leakage as L

WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS[:20])


def frames(spark):
    items = spark.createDataFrame([(1, PASSAGE, "a"), (1, PASSAGE, "a"), (2, " ".join(WORDS[30:50]), "b"), (3, None, "c"), (None, PASSAGE, "d"), (4, "", "e"), (5, "too short", "f")], "item_id long, text string, doc_id string")
    docs = [(1, f"before {PASSAGE.upper()} after"), (2, "  ".join(WORDS[4:17])), (3, " ".join(WORDS[4:15])), (4, None), (5, ""), (6, ", ".join(WORDS[28:45])), (7, "nothing of the kind " * 5000), (1, f"before {PASSAGE.upper()} after")]
    # cutting the passage of item 2 brings the halves of item 1's together
    docs.append((8, " ".join(WORDS[:6]) + " " + " ".join(WORDS[30:50]) + " " + " ".join(WORDS[6:20])))
    return spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_spans int"), items


def brute(docs, items):
    grams = {}
    for r in items:
        if r.item_id is not None:
            w = L.words_of(r.text)
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(r.item_id)
    out = set()
    for d in docs:
        w = L.words_of(d.text)
        for k in range(len(w) - 11):
            out |= {(d.doc_id, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def test_find_equal_to_brute_force_in_any_block_size(spark):
    docs, items = frames(spark)
    want = brute(docs.collect(), items.collect())
    for chars in (0, 1):
        got = [(r.doc_id, r.item_id) for r in L.find_leaks(docs, "doc_id", "text", items, "item_id", "text", chars=chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (2, 1) in want and (3, 1) not in want


def test_nothing_is_left_after_removal(spark):
    docs, items = frames(spark)
    for chars in (0, 1):
        clean = L.remove_leaks(docs, "doc_id", "text", items, "item_id", "text", chars=chars).collect()
        assert len(clean) == docs.count()
        by = {r.doc_id: r for r in clean}
        assert by[1].clean_text == "before  after" and by[4].clean_text is None and by[7].n_spans == 0
        left = spark.createDataFrame([(r.doc_id, r.clean_text) for r in clean], "doc_id long, text string")
        for i in (1, 2):
            assert L.find_leaks(left, "doc_id", "text", items.where(f"item_id = {i}"), "item_id", "text").count() == 0 or chars
        assert all(r.n_chars_removed == len(t or "") - len(r.clean_text or "") for r, t in zip(clean, [d.text for d in docs.collect()]))


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert L.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.drop_leaking(docs, "doc_id", "text", items, "item_id", "text").select("doc_id").distinct().count() == 8 - len({d for d, _ in brute(docs.collect(), items.collect())})
