"""Variables, loops, markers in chunks and waiters, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import markers, state
from tickloom.streaming import waiters


def events(spark, seed, n=300, hot=0.5):
    """``device`` (a half of all rows is one's, some are null), ``tick``, ``to``, ``by``, ``f``."""
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        device = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        rows.append((device, t, rng.randint(-9, 9) if rng.random() < 0.1 else None, rng.choice([None, 0, 1, -2, 5]), rng.choice([None, -1, 0, 1, 1, 2]), "x"))
    return rows, spark.createDataFrame(rows, "device string, tick long, to long, by long, f long, value_ string").repartition(5)


@pytest.mark.parametrize(("seed", "width"), [(1, 7), (2, 1), (3, 1000)])
def test_assign(spark, seed, width):
    rows, df = events(spark, seed)
    got = {r["tick"]: r["v"] for r in state.assign(df, "device", ["tick"], F.floor(F.col("tick") / width), F.col("to"), F.col("by"), "v", start=3).collect()}
    values, want = {}, {}
    for device, t, to, by, _, _ in rows:
        values[device] = (values.get(device, 3) if to is None else to) + (by or 0)
        want[t] = values[device]
    assert got == want


@pytest.mark.parametrize(("seed", "width"), [(1, 7), (2, 1), (3, 60)])
def test_affine(spark, seed, width):
    rows, df = events(spark, seed, 200)
    got = {r["tick"]: r["v"] for r in state.affine(df, "device", ["tick"], F.floor(F.col("tick") / width), F.col("f"), F.col("by"), "v", start=-4).collect()}
    values, want = {}, {}
    for device, t, _, by, f, _ in rows:
        values[device] = values.get(device, -4) * (1 if f is None else f) + (by or 0)
        want[t] = values[device]
    assert got == want


def test_affine_is_exact_beyond_64_bits_between(spark):
    """The composed map of a range is too large for 64 bits; the values are not."""
    df = spark.createDataFrame([(1, t, 2, 0) for t in range(100)] + [(2, t, 2, 1) for t in range(62)], "k long, t long, f long, a long")
    got = state.affine(df, "k", ["t"], F.floor(F.col("t") / 80), F.col("f"), F.col("a"), "v").where("t >= 61").groupBy("k").agg(F.max("v")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 2**62 - 1)]
    with pytest.raises(Exception, match="too large|out of bounds|OverflowError"):
        state.affine(df, "k", ["t"], F.floor(F.col("t") / 80), F.col("f"), F.col("a"), "v", start=1).collect()


def test_assign_and_affine_of_nothing(spark):
    _, df = events(spark, 1, 0)
    assert state.assign(df, "device", ["tick"], F.col("tick"), F.col("to"), F.col("by")).count() == 0
    assert state.affine(df, "device", ["tick"], F.col("tick"), F.col("f"), F.col("by")).count() == 0


def test_assign_spreads_a_hot_device(spark):
    """Rows are dealt by device and range before they are sorted, and never gathered."""
    _, df = events(spark, 1)
    out = state.assign(df, "device", ["tick"], F.floor(F.col("tick") / 7), F.col("to"), F.col("by"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert "hashpartitioning(device" in plan and "__span" in plan.split("hashpartitioning(device", 1)[1].split(")")[0]


def test_while_loop(spark):
    """Rows that end at once, late, after 10,000 rounds, and by a null."""
    df = spark.createDataFrame([(0,), (1,), (63,), (64,), (65,), (10_000,), (None,)], "n long")
    got = state.while_loop(df, {"left": F.col("n"), "sum": F.lit(0).cast("long")}, lambda s: s["left"] > 0, lambda s: {"left": s["left"] - 1, "sum": s["sum"] + s["left"]}, most=20_000)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((n, 0 if n is not None else None, n * (n + 1) // 2 if n else 0, n or 0)) for n in (0, 1, 63, 64, 65, 10_000, None))


def test_while_loop_that_never_ends(spark):
    df = spark.createDataFrame([(1,)], "n long")
    with pytest.raises(RuntimeError, match="has not ended"):
        state.while_loop(df, {"x": F.col("n")}, lambda s: s["x"] > 0, lambda s: {"x": s["x"]}, most=100)


# Markers


def brute_frames(text, marker):
    out, at = [], 0
    while (found := text.find(marker, at)) >= 0:
        out.append((at, found))
        at = found + len(marker)
    return out


@pytest.mark.parametrize(("marker", "size", "block"), [(b"\n", 3, 2), (b"aab", 1, 3), (b"aa", 2, 1), (b"abab", 5, 1024), ("é".encode(), 1, 4), (b"aabaab", 4, 2)])
def test_frames(spark, marker, size, block):
    rng, texts = random.Random(len(marker)), {}
    for k in range(25):
        texts[k] = b"".join(rng.choice([b"a", b"b", b"aab", b"\n", "é".encode(), marker]) for _ in range(rng.choice([0, 1, 5, 40])))
    texts[None] = marker * 50
    rows = [(k, i // size, None if k == 3 else t[i : i + size]) for k, t in texts.items() for i in range(0, len(t), size)]
    got = markers.frames(spark.createDataFrame(rows, "k long, no long, c binary").repartition(3), "k", "no", "c", marker, block).collect()
    want = [(k, i, a, b) for k, t in texts.items() if k != 3 for i, (a, b) in enumerate(brute_frames(t, marker))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_frames_of_nothing(spark):
    df = spark.createDataFrame([], "k long, no long, c binary")
    assert markers.frames(df, "k", "no", "c", "x").count() == 0
    with pytest.raises(ValueError, match="at least one byte"):
        markers.frames(df, "k", "no", "c", "")


# Waiters


def brute_answers(rows):
    """By port, one row after the other in time, with all timers in between."""
    out, ports = [], {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1])):
        ports.setdefault(r[0], []).append(r)
    for port, own in ports.items():
        buffer, waits, asked = "", [], 0

        def expire(now):
            nonlocal buffer
            for w in sorted((w for w in waits if w[3] < now), key=lambda w: (w[3], w[0])):
                waits.remove(w)
                got = {"chars": buffer[: w[4]], "drain": buffer}.get(w[1])
                out.append((port, w[0], "ok" if w[1] == "drain" else "timeout", got))
                if w[1] != "marker":
                    buffer = ""

        for _, _, at, kind, text, n, timeout in own:
            expire(at)
            if kind == "chunk":
                buffer += text or ""
            elif kind == "drain":
                buffer = ""
            if kind in ("marker", "chars", "drain"):
                waits.append((asked, kind, text, at + timeout, n))
                asked += 1
            for w in list(waits):
                if w[1] == "marker" and w[2] in buffer:
                    got, _, buffer = buffer.partition(w[2])
                elif w[1] == "chars" and len(buffer) >= w[4]:
                    got, buffer = buffer[: w[4]], buffer[w[4] :]
                else:
                    continue
                waits.remove(w)
                out.append((port, w[0], "ok", got))
        expire(10**12)
    return sorted(map(repr, out))


def port_rows(seed):
    rng, rows = random.Random(seed), []
    for port in ("p", "q", "r", None):
        for i, at in enumerate(sorted(rng.sample(range(1000), 40))):
            kind = rng.choice(["chunk"] * 5 + ["marker", "marker", "chars", "drain"])
            text = {"chunk": "".join(rng.choices("abc\n", k=rng.randint(0, 8))), "marker": rng.choice(["\n", "ab", "zz"])}.get(kind)
            rows.append((port, i, at, kind, text, rng.randint(1, 12) if kind == "chars" else None, rng.choice([0, 5, 60, 400]) if kind not in ("chunk",) else None))
    return [*rows, ("end", 0, 100_000, "clock", None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "port string, seq long, ms long, kind string, text string, n long, timeout_ms long").select("port", "seq", F.timestamp_millis("ms").alias("at"), "kind", "text", "n", "timeout_ms")


def run(spark, path):
    with waiters.state_store(spark):
        said = waiters.answered(spark.readStream.schema(waiters.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        said.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(repr(tuple(r)) for r in spark.read.parquet(f"{path}/out").select("port", "waiter", "status", "text").collect())


def test_waiters_over_batches_and_a_restart(spark, tmp_path):
    """Micro-batches of 50 ms; the query stops twice and goes on from its checkpoint."""
    rows, path = port_rows(4), f"file://{tmp_path}"
    steps = [(0, 300), (300, 650), (650, 10**9)]
    for low, high in steps:
        cuts = [(a, a + 175) for a in range(low, min(high, 1000), 175)] + [(1000, high)] * (high > 1000)
        for a, b in cuts:
            own = [r for r in rows if a <= r[2] < min(b, high)]
            if own:
                frame(spark, own).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = run(spark, path)
        if high == 300:
            assert got != brute_answers(rows)
    assert got == brute_answers(rows)


def test_waiters_in_one_batch(spark, tmp_path):
    rows, path = port_rows(9), f"file://{tmp_path}"
    frame(spark, rows).coalesce(1).write.parquet(f"{path}/in")
    assert run(spark, path) == brute_answers(rows)
