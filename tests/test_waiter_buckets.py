"""Ports that share a bucket: answers against plain Python, and few calls to the state."""

import random

import pandas as pd
from test_state import brute_answers, frame

from tickloom.streaming import waiters


class Handle:
    """A list, a set of timers and the number of calls, as Spark has them for a key."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def rows_of(rng, ports):
    rows = []
    for port in ports:
        for i, at in enumerate(sorted(rng.sample(range(1, 1000), 30))):
            kind = rng.choice(["chunk"] * 6 + ["marker", "chars", "drain"])
            text = {"chunk": "".join(rng.choices("abc\n", k=rng.randint(0, 40))), "marker": rng.choice(["\n", "ab", "zz"])}.get(kind)
            rows.append((port, i, at, kind, text, rng.randint(1, 12) if kind == "chars" else None, rng.choice([0, 5, 60, 400]) if kind != "chunk" else None))
    return [*rows, ("end", 0, 100_000, "clock", None, None, None)]


def simulated(rows, cuts):
    """Answers, and the calls of each turn, over micro-batches that end at ``cuts``."""
    handle, processor, mark, out, calls = Handle(), waiters.Waiters(), 0, [], []
    processor.init(handle)

    def turn(frames):
        for f in frames:
            out.extend(repr(tuple(r)) for r in f.astype(object).where(f.notna(), None).itertuples(index=False))
        calls.append(handle.calls)
        handle.calls = 0

    def fire():
        for at in sorted(t for t in handle.timers if t <= mark):
            turn(processor.handleExpiredTimer((0,), Now(mark), None))
            handle.timers.remove(at)
        assert all(t > mark for t in handle.timers)

    for low, high in zip([0, *cuts], cuts, strict=False):
        own = [r for r in rows if low <= r[2] < high]
        f = pd.DataFrame([(p, ms, seq, k, t or "", n or 0, limit or 0) for p, seq, ms, k, t, n, limit in own], columns=["port", "at_ms", "seq", "kind", "text", "n", "timeout_ms"])
        turn(processor.handleInputRows((0,), iter([f[: len(f) // 2], f[len(f) // 2 :]]), Now(mark)))
        fire()
        mark = max([mark, *(r[2] for r in own)])
    fire()
    return sorted(out), calls, len(handle.rows)


def test_a_bucket_of_many_ports():
    for seed in range(6):
        rows = rows_of(random.Random(seed), [f"p{k}" for k in range(25)])
        got, calls, _ = simulated(rows, [*range(40, 1001, 40), 10**6])
        assert got == brute_answers(rows)
        assert max(calls) <= 4


def test_calls_do_not_grow_with_ports():
    for ports in (2, 400):
        got, calls, kept = simulated(rows_of(random.Random(ports), [f"p{k}" for k in range(ports)]), [500, 1001, 10**6])
        assert max(calls) <= 4 and len(got) > ports
        assert kept <= 3 * ports  # what is past is written anew


def test_one_bucket_on_a_stream(spark, tmp_path):
    rows, path = rows_of(random.Random(3), [f"p{k}" for k in range(12)]), f"file://{tmp_path}"
    for low, high in ((0, 400), (400, 1000), (1000, 10**6)):
        frame(spark, [r for r in rows if low <= r[2] < high]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with waiters.state_store(spark):
        said = waiters.answered(spark.readStream.schema(waiters.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), buckets=1)
        said.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{path}/out").select("port", "waiter", "status", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_answers(rows)


def test_state_is_compact_and_settings_return(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.compression"
    before = spark.conf.get(name, None)
    with waiters.state_store(spark):
        assert spark.conf.get(name) == "zstd"
    assert spark.conf.get(name, None) == before
