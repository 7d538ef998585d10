"""Windows over a stream, batch by batch, against a plain simulation."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.streaming import windows

START = datetime(2024, 3, 1)
SCHEMA = "k string, at timestamp_ntz, v long, id long"


def batches(seed):
    r, out, i = random.Random(seed), [], 0
    for b in range(5):
        rows = []
        for _ in range(r.choice([0, 1, 40])) if b else range(30):
            at = None if r.random() < 0.05 else START + timedelta(minutes=b * 20 + r.randrange(-60, 21))
            rows.append((r.choice(["a", "b", None]), at, r.choice([None, 1, 5]), i))
            i += 1
        out.append(rows)
    return out


def simulated(parts, width=10, delay=15):
    """Late ids by batch, and closed and open windows."""
    seen, late, live, closed = None, set(), {}, {}
    for b, rows in enumerate(parts):
        mark = seen and seen - timedelta(minutes=delay)
        for k, at, v, i in rows:
            start = at and at - timedelta(minutes=at.minute % width)
            if at is None or (mark and start + timedelta(minutes=width) <= mark):
                late.add((b, i, start))
                continue
            n, s = live.get((k, start), (0, None))
            live[k, start] = (n + 1, s if v is None else (s or 0) + v)
        seen = max([x[1] for x in rows if x[1]] + ([seen] if seen else []), default=None)
        for w in [w for w in live if seen and w[1] + timedelta(minutes=width) <= seen - timedelta(minutes=delay)]:
            closed[w] = (*live.pop(w), b)
    return late, closed, live


def sink(folder):
    return windows.window_sink(folder, ["k"], "at", "10 minutes", "15 minutes", {"v": F.col("v")})


@pytest.mark.parametrize("seed", [1, 2])
def test_restarted_stream(spark, tmp_path, seed):
    """Late rows one by one, empty batches, null keys and times; a new sink and stream for every batch."""
    parts, path = batches(seed), f"file://{tmp_path}"
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(sink(path)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    check(spark, path, parts)


def test_repeated_batch(spark, tmp_path):
    """A batch that is run again, as after a lost driver, changes nothing."""
    parts, path = batches(3), f"file://{tmp_path}"
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, SCHEMA)
        sink(path)(df.limit(3), n)  # what a broken try left behind
        sink(path)(df, n)
        sink(path)(df, n)
    check(spark, path, parts)


def check(spark, path, parts):
    late, closed, live = simulated(parts)
    assert late and closed and live
    assert {(x.batch, x.id, x.start) for x in windows.late_rows(spark, path).collect()} == late
    got = windows.closed_windows(spark, path).collect()
    assert {(x.k, x.start): (x.n, x.v, x.batch) for x in got} == closed and len(got) == len(closed)
    assert {(x.k, x.start): (x.n, x.v) for x in windows.open_windows(spark, path).collect()} == live
    # Every row is in a window or late, once.
    assert sum(x.n for x in got) + sum(n for n, _ in live.values()) + len(late) == sum(map(len, parts))
    plain = Counter((k, at - timedelta(minutes=at.minute % 10)) for b, p in enumerate(parts) for k, at, _, i in p if i not in {x[1] for x in late})
    assert plain == {w: x[0] for w, x in (closed | live).items()}


def test_followed(spark, tmp_path):
    """Over three starts of the stream, all pairs are found that a batch join finds."""
    r, path = random.Random(5), f"file://{tmp_path}"
    rows = [(r.choice(["a", "b", None]), START + timedelta(minutes=r.randrange(300)), r.randrange(2), i) for i in range(150)]
    cut = sorted(rows, key=lambda x: x[1])
    schema = "k string, at timestamp, v long, id long"
    for part in (cut[:50], cut[50:100], cut[100:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
        side = lambda v: spark.readStream.schema(schema).parquet(f"{path}/in").where(F.col("v") == v)
        pairs = windows.followed(side(0), side(1), "k", "at", "20 minutes", "5 minutes", ("id", "id"))
        pairs.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    want = [(a[0], a[3], b[3]) for a in rows for b in rows if a[0] and a[0] == b[0] and not a[2] and b[2] and timedelta(0) <= b[1] - a[1] <= timedelta(minutes=20)]
    got = [tuple(x) for x in spark.read.parquet(f"{path}/out").collect()]
    assert want and sorted(got) == sorted(want)
