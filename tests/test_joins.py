"""Joins by time, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import joins


def rows(seed, n, hot=0.5):
    r = random.Random(seed)
    return [("hot" if r.random() < hot else r.choice(["a", "b", None]), r.choice([*range(40), None]), i) for i in range(n)]


@pytest.mark.parametrize(("seed", "width"), [(1, 5), (2, 1), (3, 100)])
def test_as_of(spark, seed, width):
    """Ties in time, nulls, ranges without right rows, a key with half of all rows."""
    left, right = rows(seed, 120), [x for x in rows(seed + 10, 40) if x[1] is None or x[1] % 7]
    a = spark.createDataFrame(left, "k string, t long, id long").withColumn("other", F.lit("x"))
    b = spark.createDataFrame([(k, t, i, i * 2) for k, t, i in right], "k string, t long, n long, v long")
    got = joins.as_of(a, b, "k", "t", F.floor(F.col("t") / width), ["n"], ["n", "v"])
    assert got.columns == ["k", "t", "id", "other", "n", "v"]
    want = []
    for k, t, i in left:
        best = max(((u, n) for j, u, n in right if k is not None and j == k and u is not None and t is not None and u <= t), default=None)
        want.append((k, t, i, "x", best and best[1], best and best[1] * 2))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert joins.as_of(a.limit(0), b, "k", "t", F.col("t"), ["n"], ["v"]).count() == 0
    assert joins.as_of(a, b.limit(0), "k", "t", F.col("t"), ["n"], ["v"]).where("v is not null").count() == 0


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_overlaps(spark, width):
    r = random.Random(width)
    make = lambda n: [("hot" if r.random() < 0.5 else r.choice(["a", None]), (s := r.choice([None, *range(-20, 30)])), None if s is None else s + r.choice([-1, 0, 1, 3, 15]), i) for i in range(n)]
    a, b = make(60), make(50)
    frame = lambda x: spark.createDataFrame(x, "k string, s long, e long, id long")
    got = joins.overlaps(frame(a), frame(b), "k", "s", "e", ("id", "id"), width)
    ok = lambda x: x[0] is not None and x[1] is not None and x[1] < x[2]
    want = [(x[0], x[3], y[3]) for x in a for y in b if ok(x) and ok(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
