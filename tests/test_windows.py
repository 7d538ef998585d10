"""Moving quantiles, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import windows


def test_ordered():
    r, held, own = random.Random(3), windows.Ordered(), []
    for _ in range(20_000):
        if own and r.random() < 0.45:
            x = own.pop(r.randrange(len(own)))
            held.drop(x)
        else:
            x = r.choice([r.random(), float(r.randrange(5))])
            own.append(x)
            held.add(x)
        if r.random() < 0.02 and own:
            k = r.randrange(len(own))
            assert held.at(k) == sorted(own)[k]
    assert held.n == len(own) and max(map(len, held.blocks)) <= windows.BLOCK


def brute(rows, reach, q):
    out = []
    for k, t, v, i in rows:
        seen = sorted(w for j, u, w, _ in rows if k is not None and t is not None and j == k and u is not None and t - reach <= u <= t and w is not None)
        out.append((k, t, v, i, seen[max(math.ceil(len(seen) * q) - 1, 0)] if seen else None, len(seen)))
    return out


@pytest.mark.parametrize(("reach", "q", "cell", "range_rows"), [(7, 0.5, None, 10), (0, 0.5, 3, 1), (40, 0.9, 5, 25), (7, 0.0, 50, 10), (3, 1.0, 1, 100_000)])
def test_moving_quantile(spark, reach, q, cell, range_rows):
    """Hot key cut into ranges, ties in time, nulls, clashing names, negative times, batches that
    end within a moment."""
    r = random.Random(reach)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", None]), r.choice([None, *range(-30, 60)]), r.choice([None, 1.5, *map(float, range(8))]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v double, `__key.x` long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = windows.moving_quantile(df, "k", "t", "v", reach, q, cell, range_rows)
        assert got.columns == [*df.columns, "quantile", "n_values"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, reach, q)))
        assert windows.moving_quantile(df.limit(0), "k", "t", "v", reach).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranges(spark):
    """No range of a hot key has over its rows and one cell; a light key is not cut or copied."""
    df = spark.range(10_000).select(F.when(F.col("id") % 100 == 0, "light").otherwise("hot").alias("__key"), F.floor(F.col("id") / 10).alias("__cell"))
    got = windows._ranges(df, 20, 1, 500)
    own = df.join(got, ["__key", "__cell"]).groupBy("__key", "__own").count().collect()
    assert max(x["count"] for x in own) <= 510 and len([x for x in own if x["__key"] == "hot"]) >= 19
    assert got.where("__key = 'light' AND __upto > 1").count() == 0
    halo = got.where("__key = 'hot' AND __upto > __own").count()
    assert halo <= 20 * len(own)
