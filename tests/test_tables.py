"""Ranks, cubes and table functions, against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tickloom.operators import tables


def frame(spark, seed, n=400):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, *range(30)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v long, id long").repartition(5)


def test_ranked(spark):
    rows, df = frame(spark, 1)
    got = tables.ranked(df, F.asc_nulls_last("v"), F.asc("id")).collect()
    want = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2]))
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x["rank"])] == want
    assert [x["rank"] for x in sorted(got, key=lambda x: x["rank"])] == list(range(1, len(rows) + 1))
    assert tables.ranked(df.limit(0), F.asc("id")).count() == 0
    plan = tables.ranked(df, F.asc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_top(spark):
    rows, df = frame(spark, 2)
    got = tables.top(df, ["k"], 3, F.desc_nulls_last("v"), F.asc("id"))
    want = []
    for k in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want += [(*x, i + 1) for i, x in enumerate(own[:3])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def cubes(rows):
    out = {}
    for k, v, i in rows:
        for level in range(4):
            group = (None if level & 2 else k, None if level & 1 else i % 3, level)
            n, seen = out.setdefault(group, (0, set()))
            out[group] = (n + i, seen | ({v} - {None}))
    return out


def test_cube(spark):
    rows, df = frame(spark, 3)
    got = tables.cube(df.withColumn("m", F.col("id") % 3), ["k", "m"], "v", {"total": F.col("id")}).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*g, n, len(s))) for g, (n, s) in cubes(rows).items())


def test_cube_deals_by_value(spark, monkeypatch):
    """The facts make as many parts as their rows ask for, and nothing is expanded before it is dealt."""
    monkeypatch.setattr(tables, "CUBE_ROWS", 20)
    rows, df = frame(spark, 6)
    out = tables.cube(df.withColumn("m", F.col("id") % 3), ["k", "m"], "v", {"total": F.col("id")})
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*g, n, len(s))) for g, (n, s) in cubes(rows).items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and ", 20), REPARTITION_BY_NUM" in plan


def test_cube_sketched(spark):
    """Within five standard errors at every level, from one scan."""
    df = spark.range(200_000).withColumns({"k": F.col("id") % 3, "m": F.col("id") % 7, "v": F.col("id") * 7919 % 60_000})
    out = tables.cube_sketched(df, ["k", "m"], "v", {"total": F.lit(1)})
    exact = tables.cube(df, ["k", "m"], "v", {"total": F.lit(1)})
    want = {(x.k, x.m, x.level): (x.total, x.n_distinct) for x in exact.collect()}
    for x in out.collect():
        total, n = want.pop((x.k, x.m, x.level))
        assert x.total == total and abs(x.n_distinct - n) <= max(2, 5 * 1.04 / 2**7 * n)
    assert not want


def test_runs(spark):
    rows, df = frame(spark, 4, 200)
    got = tables.runs(df.select("k", "id", (F.col("v") % 3).alias("v")), "k", "id", "id", "v").collect()
    want = []
    for k in {x[0] for x in rows}:
        own = [None if x[1] is None else x[1] % 3 for x in rows if x[0] == k]
        want += [(k, n, v, len(list(g))) for n, (v, g) in enumerate(groupby(own))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(Exception, match="no column nothing"):
        tables.runs(df, "k", "id", "id", "nothing")


def test_json_field(spark):
    df = spark.createDataFrame([(t,) for t in ['{"k": 3}', '{"k": "x"}', '{"j": 1}', "no json", None, '{"k": {"a": [1, 2]}}']], "t string")
    assert [x[0] for x in df.select(tables.json_field("t", "$.k", "bigint")).collect()] == [3, None, None, None, None, None]
    assert [x[0] for x in df.select(tables.json_field("t", "$.k.a[1]", "int")).collect()] == [None] * 5 + [2]
