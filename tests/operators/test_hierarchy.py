import pytest

from sparkloom.operators import hierarchy as H

LINKS = "relation string, id string, parent string"
#: A tree, a circle c > b > a > d > c with a tree below it, a circle of one with a record below it.
ROWS = [("r", "t0", None), ("r", "t1", "t0"), ("r", "t2", "t1"), ("r", "t3", "t1"), ("r", "t4", "t3")]
ROWS += [("r", "c", "b"), ("r", "b", "a"), ("r", "a", "d"), ("r", "d", "c"), ("r", "u", "c"), ("r", "v", "u"), ("r", "w", "v"), ("r", "x", "v"), ("r", "y", "a")]
ROWS += [("r", "s", "s"), ("r", "z", "s")]
ROWS += [("q", *r[1:]) for r in ROWS[5:9]] + [("q", f"h{i:02}", "b") for i in range(20)]


def _rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_circles_of_large_components(spark, most):
    tree = H.hierarchy(spark.createDataFrame(ROWS, LINKS), detail=True, max_component=most)
    want = [(r, "a", n, i) for r in "qr" for n, i in enumerate("adcb")] + [("r", "s", 0, "s")]
    assert _rows(H.circles(tree)) == sorted(want)


def test_large_components_come_out_as_small_ones(spark):
    links = spark.createDataFrame(ROWS, LINKS)
    show = lambda m: sorted(map(repr, H.hierarchy(links, detail=True, max_component=m).collect()))
    assert show(1) == show(1000)


def test_circular_rows_carry_no_trail(spark, monkeypatch):
    double, asked = H._double, []

    def watched(nodes, trail=False):
        out = double(nodes, trail)
        asked.append((trail, out[1].count()))
        return out

    monkeypatch.setattr(H, "_double", watched)
    H.hierarchy(spark.createDataFrame(ROWS, LINKS), detail=True, max_component=1).count()
    assert [n for trail, n in asked if trail] == [0]


@pytest.mark.parametrize("most", [1, 1000])
def test_descendants_below_circles(spark, most):
    tree = H.hierarchy(spark.createDataFrame(ROWS[:16], LINKS), detail=True, max_component=most)
    got = {(r.record_id, r.descendant_id, r.distance) for r in H.descendants(tree).collect()}
    straight = {("t0", "t1", 1), ("t0", "t2", 2), ("t1", "t2", 1), ("t0", "t3", 2), ("t1", "t3", 1), ("t0", "t4", 3), ("t1", "t4", 2), ("t3", "t4", 1)}
    # no pair of two members, none of a member and what hangs below another
    led = {("c", "u", 1), ("c", "v", 2), ("u", "v", 1), ("c", "w", 3), ("u", "w", 2), ("v", "w", 1), ("c", "x", 3), ("u", "x", 2), ("v", "x", 1), ("a", "y", 1), ("s", "z", 1)}
    assert got == straight | led
