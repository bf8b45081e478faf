import pytest

from sparkloom.llm import percentiles as P


def test_infinite_values_count(spark):
    inf = float("inf")
    rows = [("a", 1.0)] * 18 + [("a", inf)] * 2 + [("b", -inf)] + [("b", 5.0)] * 2 + [("c", float("nan")), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.low, r.high) for r in P.estimates(P.sketch(df, ["g"], "v"), ["g"], {"low": 0.01, "high": 0.95}).collect()}
    assert (got["a"][0], got["a"][2], got["b"][0], got["b"][1], got["c"][0]) == (20, inf, 3, -inf, 1)
    assert [r.g for r in P.groups_above(df.where("v > 0"), ["g"], "v", 0.95, 100.0).collect()] == ["a"]


def test_ranks_of_fine_shares(spark):
    total = spark.range(100_000, 100_001)
    ranks = total.select(P.rank_of(total.id, 0.99999), P.rank_of(total.id, 0.95), P.rank_of(total.id, 0.0), P.rank_of(total.id, 1.0)).first()
    assert tuple(ranks) == (99_999, 95_000, 1, 100_000)
    with pytest.raises(ValueError):
        P.rank_of(total.id, 1 / 3)


def test_days_combine_and_the_error_holds(spark):
    rows = [("d%d" % (i % 3), None if i % 50 == 0 else "g", -2.0 if i % 7 == 0 else 1.01**i) for i in range(1000)]
    df = spark.createDataFrame(rows, "day string, g string, v double")
    one = {tuple(r) for r in P.sketch(df, ["g"], "v").select("g", "sign", "bucket", "n").collect()}
    days = P.merge(P.sketch(df, ["day", "g"], "v"), ["g"])
    assert {tuple(r) for r in days.select("g", "sign", "bucket", "n").collect()} == one
    for name in ("g", None):
        values = sorted(v for _, g, v in rows if g == name)
        got = {r.g: r for r in P.estimates(days, ["g"], {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}[name]
        for share, est in ((0.1, got.a), (0.5, got.b), (0.99, got.c)):
            exact = values[max(1, -(-int(len(values) * share * 100) // 100)) - 1]
            assert abs(est - exact) <= 0.011 * abs(exact) or abs(est - values[min(len(values) - 1, int(len(values) * share))]) <= 0.011 * abs(exact)
    assert P.sketch(df.limit(0), ["g"], "v").count() == 0
