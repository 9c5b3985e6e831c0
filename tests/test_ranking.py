import random

from quire.operators.joins import salted_lookup
from quire.operators.ranking import exact_ranks, running_maxima, running_totals


def test_running_totals_equal_brute_force_over_skewed_groups(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"g{i % 5}", rnd.randrange(40), rnd.randrange(10)) for i in range(600)]
    got = running_totals(spark.createDataFrame(rows, "g string, o int, a int"), ["g"], ["o"], "a", "t", "b", partitions=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["t"] == sum(a for g, o, a in rows if g == r["g"] and o <= r["o"])
        assert r["b"] == sum(a for g, o, a in rows if g == r["g"] and o < r["o"])


def test_running_totals_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, None), ("a", None, 5)], "g string, o int, a int")
    assert sorted((r["g"] or "", r["t"]) for r in running_totals(df, ["g"], ["o"], "a", "t").collect()) == [("", 2), ("", 2), ("a", 5)]
    assert running_totals(df.limit(0), ["g"], ["o"], "a", "t").count() == 0


def test_exact_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("a", 5, 4), ("b", None, 1)], "g string, v int, w int")
    got = {(r["g"], r["v"]): (r["n_below"], r["n_at_or_below"], r["n_group"]) for r in exact_ranks(df, ["g"], "v", "w").collect()}
    assert got == {("a", 1): (0, 3, 7), ("a", 5): (3, 7, 7), ("b", None): (0, 1, 1)}


def test_running_maxima_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.7 else "cold", i, rnd.choice([None, *range(50)])) for i in range(300)]
    got = running_maxima(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], {"m": "v"}).collect()
    for r in got:
        assert r["m"] == max((v for g, o, v in rows if g == r["g"] and o < r["o"] and v is not None), default=None)


def test_salted_lookup_is_a_left_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i else None) for i in range(60)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    assert sorted((r["i"], r["v"] or 0) for r in salted_lookup(left, right, ["k"], "i").collect()) == sorted((r["i"], r["v"] or 0) for r in left.join(right, "k", "left").collect())
