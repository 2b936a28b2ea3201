import math
import random

import pytest

from sievespan.operators.distance import min_distance, min_distance_squared

SCHEMA = "k string, x double, y double, z double"


def nearest(a, b):
    best = {}
    for k, *p in a:
        for q, *r in b:
            if k == q:
                d = sum((u - v) ** 2 for u, v in zip(p, r))
                best[k] = min(d, best.get(k, math.inf))
    return best


def clusters(rng, keys, n, spread):
    out = []
    for k in keys:
        centre = [rng.uniform(-50, 50) for _ in range(3)]
        out += [(k, *[c + rng.gauss(0, spread) for c in centre]) for _ in range(n)]
    return out


@pytest.mark.parametrize("leaf", [1, 20, 1 << 16])
@pytest.mark.parametrize("spread", [0.01, 20])
def test_against_all_pairs(spark, leaf, spread):
    rng = random.Random(leaf + int(spread))
    a = clusters(rng, "pqr", 25, spread) + clusters(rng, "q", 25, 1) + clusters(rng, "s", 3, 1)
    b = clusters(rng, "pqr", 30, spread) + clusters(rng, "t", 3, 1)
    got = min_distance_squared(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA),
                               ["k"], ["x", "y", "z"], leaf_pairs=leaf)
    got = {r[0]: r[1] for r in got.collect()}
    want = nearest(a, b)
    assert got.keys() == want.keys() == set("pqr")
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_many_copies_of_one_point_and_one_hot_key(spark):
    a = [("hot", 0.0, 0.0, 0.0)] * 500 + [("hot", float(i), 40.0, 0.0) for i in range(200)] + [("one", 1.0, 1.0, 1.0)]
    b = [("hot", 3.0, 4.0, 0.0)] * 500 + [("hot", float(i), -40.0, 0.0) for i in range(200)] + [("one", 1.0, 1.0, 1.0)]
    got = min_distance_squared(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA),
                               ["k"], ["x", "y", "z"], leaf_pairs=64)
    assert {r[0]: r[1] for r in got.collect()} == {"hot": 25.0, "one": 0.0}


def test_empty_sides(spark):
    a = spark.createDataFrame([("p", 0.0, 0.0, 0.0), ("q", 1.0, 0.0, 0.0)], SCHEMA)
    b = spark.createDataFrame([("p", 3.0, 4.0, 0.0)], SCHEMA)
    roster = spark.createDataFrame([("p",), ("q",), ("r",)], "k string")
    got = min_distance(roster, a, b, ["k"], ["x", "y", "z"])
    assert {r[0]: r[1] for r in got.collect()} == {"p": 5.0, "q": 999.0, "r": 999.0}
    none = min_distance(roster, a.limit(0), b.limit(0), ["k"], ["x", "y", "z"])
    assert {r[1] for r in none.collect()} == {999.0}


def test_a_far_key_and_points_that_are_no_numbers(spark):
    rng = random.Random(5)
    a, b = ([("k", rng.random(), rng.random(), 0.0) for _ in range(300)] for _ in "ab")
    odd = [("far", 1e16, 0.0, 0.0), ("k", float("inf"), 0.0, 0.0), ("k", float("nan"), 0.0, 0.0), ("k", None, 0.0, 0.0)]
    got = min_distance_squared(spark.createDataFrame(a + odd, SCHEMA), spark.createDataFrame(b + odd, SCHEMA),
                               ["k"], ["x", "y", "z"], leaf_pairs=64)
    got = {r[0]: r[1] for r in got.collect()}
    assert got["far"] == 0 and got["k"] == pytest.approx(nearest(a, b)["k"], rel=1e-12) and len(got) == 2
