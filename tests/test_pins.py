"""Modes of pins and the reads that depend on them, against a plain simulation."""

import random

from pyspark.sql import functions as F

from tickloom.operators import pins

KIND = "device string, pin int, at long, kind string, asked string, written long, signal long"


def simulated(rows):
    modes, opened, held, out = {}, {}, {}, []
    for device, pin, at, kind, asked, written, signal in sorted(rows, key=lambda r: r[2]):
        key, mode, new, level = (device, pin), None, None, None
        if kind == "mode":
            mode = modes[key] = asked if asked in ("in", "pullup") else "out"
        elif kind == "write":
            mode, held[key] = "out", written or 0
        elif kind == "read":
            mode = modes.get(key, "in")
            free = 1 if mode == "pullup" else 0
            level = held.get(key, 0) if mode == "out" else free if signal is None else int(signal != 0)
        if mode:
            new, opened[key] = opened.get(key) != mode, mode
        out.append((at, mode, new, level))
    return out


def made(seed, n=1500):
    r = random.Random(seed)
    kinds = ["mode", "write", "read", "read", "other", None]
    asked = ["in", "out", "pullup", "PULLUP", None]
    return [
        ("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), r.choice([1, 2, None]), i, r.choice(kinds), r.choice(asked), r.choice([0, 1, None]), r.choice([0, 1, 7, None]))
        for i in range(n)
    ]


def applied(df):
    span = F.floor(F.col("at") / 100)
    return pins.accesses(df, "device", "pin", ["at"], span, *[F.col(c) for c in ("kind", "asked", "written", "signal")])


def test_accesses(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = applied(spark.createDataFrame(rows, KIND).repartition(7)).select("at", "mode", "opened", "level").collect()
        assert sorted(map(tuple, got)) == simulated(rows)


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], KIND).withColumn("range", F.lit(1))
    got = applied(df)
    assert got.count() == 0
    assert got.columns == [*df.columns, "mode", "opened", "level"]


def test_open_modes(spark):
    rows = made(3)
    got = pins.open_modes(applied(spark.createDataFrame(rows, KIND)), "device", "pin", ["at"]).collect()
    want = {}
    for row, (_, mode, new, _) in zip(rows, simulated(rows), strict=True):
        if mode:
            _, n = want.get(row[:2], (None, 0))
            want[row[:2]] = (mode, n + new)
    assert {(x["device"], x["pin"]): (x["mode"], x["times_opened"]) for x in got} == want


def test_busy_pin_is_spread(spark):
    """Rows of one pin are sorted by range, in no task as a whole."""
    rows = applied(spark.createDataFrame([("d", 1, i, "read", None, None, 1) for i in range(100)], KIND))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    sorts = [x for x in plan.splitlines() if "windowspecdefinition" in x and "__range" not in x and "__span" not in x]
    assert not sorts
