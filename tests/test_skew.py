"""Joins with heavy keys, against the plain join and exact counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.operators import skew


def frame(spark, seed, n, name, hot=0.4):
    r = random.Random(seed)
    rows = [("hot" if r.random() < hot else r.choice([f"k{r.randrange(30)}", None]), r.randrange(3), i % 50) for i in range(n)]
    return spark.createDataFrame(rows, f"k string, j long, {name} long").repartition(3)


@pytest.mark.parametrize("how", skew.KINDS)
@pytest.mark.parametrize("share", [None, 0.01, 0.9])
def test_equals_plain_join(spark, how, share):
    """Keys heavy on both sides, repeated rows, null keys, no heavy key at all."""
    a, b = frame(spark, 1, 300, "x"), frame(spark, 2, 80, "y")
    a = a.withColumn("m", F.create_map(F.lit(1), F.col("x")))
    got, want = skew.joined(a, b, ["k", "j"], how, share), a.join(b, ["k", "j"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert skew.joined(x, y, ["k", "j"], how, share).count() == x.join(y, ["k", "j"], how).count()


def test_refuses(spark):
    a = frame(spark, 1, 5, "x")
    with pytest.raises(ValueError, match="none of"):
        skew.joined(a, a, ["k"], "full")
    with pytest.raises(ValueError, match="differ in type"):
        skew.joined(a, a.withColumn("j", F.col("j").cast("int")), ["j"])


@pytest.mark.parametrize("share", [0.2, 0.02, 0.005])
def test_sketch_bounds(spark, share):
    """Keys by a power law over many tasks: none missing, none too light, counts in bounds."""
    r = random.Random(7)
    keys = [int(r.paretovariate(0.8)) for _ in range(40_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(12)
    marks = {x["m"]: x["k"] for x in df.select("k", F.xxhash64("k").alias("m")).distinct().collect()}
    true, got = Counter(keys), {marks[m]: s for m, s in skew.heavy(df, ["k"], share).items()}
    assert {k for k, n in true.items() if n >= share * len(keys)} <= set(got)
    for k, s in got.items():
        assert true[k] / len(keys) <= s + 1e-9 <= true[k] / len(keys) + share / 2 + 2e-9
    assert len(got) <= 2 / share
    assert skew.heavy(df.limit(0), ["k"], share) == {}


@pytest.mark.parametrize("how", skew.KINDS)
def test_even_tasks(spark, how):
    """A key with a third of all rows, and nulls with a third: no task has over twice the median's."""
    n = 90_000
    key = F.when(F.col("id") % 3 == 0, 0).when((F.col("id") % 3 == 1) & F.lit(how in ("left", "left_anti")), None).otherwise(F.col("id") % 20_000)
    a = spark.range(n).select(key.alias("k"), "id")
    b = spark.range(20_000).select(F.col("id").alias("k")).where("k % 4 = 0" if how != "left_anti" else "k < 0 OR k = 1")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = skew.joined(a, b, ["k"], how)
        tasks = sorted(x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect())
        assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]
        plain = sorted(x["count"] for x in a.join(b, ["k"], how).groupBy(F.spark_partition_id()).count().collect())
        assert plain[-1] > 2 * plain[len(plain) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
