"""Ordered scans, serial text and streams."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import ticks
from tickloom.sources import serial
from tickloom.streaming import serial as stream


def test_scan_is_a_window(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice([1, 1, 1, 2]), i, r.randrange(-5, 9)) for i in range(500)], "k long, t long, v long")
    got = ticks.scan(df, "k", ["t"], F.floor(F.col("t") / 30), sums={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w)}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = ticks.clock(df, "k", ["t"], F.floor(F.col("t") / 30), F.col("v")).collect()
    assert all(x.t_ms == sum(y.v for y in got if y.k == x.k and y.t < x.t) for x in got)


def test_repeat_and_actions(spark):
    df = spark.createDataFrame([(0,), (-3,), (2,)], "n long")
    assert sorted(tuple(r) for r in ticks.repeat(df, F.col("n")).collect()) == [(2, 0), (2, 1)]
    rows = ticks.actions(df, ticks.action("dw", 2, F.col("n")), ticks.action("print", F.lit(None), text=F.lit("x"), when=F.col("n") > 0))
    assert sorted((r.n, r.seq, r.kind) for r in rows.collect()) == [(-3, 0, "dw"), (0, 0, "dw"), (2, 0, "dw"), (2, 1, "print")]


def test_chunks(spark):
    text = "é🙂a" * 300
    rows = spark.createDataFrame([(text,), ("",)], "t string")
    got = sorted(serial.chunked(rows, "t").collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.chunk) for r in got) == text.encode() and {len(r.chunk) for r in got[:-1]} == {256}
    assert [r.at_ms for r in got] == [10 * k for k in range(len(got))]


def test_markers(spark):
    df = spark.createDataFrame([("boot\r\nOKhi\x04err\x04>",), ("no end",)], "t string")
    t = F.col("t")
    frames = serial.exec_frames(t)
    rows = df.select(serial.before_marker(t, "OK").alias("b"), frames["out"].alias("out"), frames["err"].alias("err"), serial.waiters(t, ["zz", "OK", "\x04"]).alias("w"), serial.first_chars(t, 3).alias("c")).collect()
    assert tuple(rows[0]) == ("boot\r\n", "hi", "err", [None, "boot\r\n", "hi"], "boo")
    assert tuple(rows[1]) == (None, None, None, [None, None, None], "no ")


def test_tokens(spark):
    code = "def f():  # if 1\n    return \"a # 2\" + str(3.5) if True else \"x\\\"y\"\n"
    long = "\"" + "q\\\" " * 300_000 + "\" 7 #" + "c" * 1_000_000
    rows = spark.createDataFrame([(0, code), (1, long), (2, "print(Pin, printed, 'if 5')")], "k int, t string").orderBy("k").select(serial.token_counts(F.col("t")).alias("n")).collect()
    assert [tuple(r.n) for r in rows] == [(2, 1, 6, 1), (1, 1, 0, 1), (0, 0, 3, 1)]


def test_projects(spark, tmp_path):
    df = spark.createDataFrame([("mine", 2, "a", "<xml>"), ("other", 2, "b", "x")], serial.PROJECT)
    serial.write_projects(df, f"{tmp_path}/p")
    assert [r.name for r in serial.read_projects(spark, f"{tmp_path}/p", "mine").collect()] == ["a"]
    assert serial.read_or_default(spark, f"{tmp_path}/none", "mine", df).count() == 2
    assert serial.read_or_default(spark, f"{tmp_path}/p", "nobody", df).count() == 2
    with pytest.raises(Exception, match="UNSUPPORTED_DATA_SOURCE|scheme|No FileSystem"):
        serial.read_or_default(spark, "nosuchscheme://x/y", "mine", df)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('{\n "app": "mine",\n "version": 1,\n "name": "b",\n "workspace": "w"\n}')
    assert [r.name for r in serial.read_projects(spark, f"{tmp_path}/one", "mine", one_a_file=True).collect()] == ["b"]
    serial.write_code(df, "name", f"{tmp_path}/code")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/code").collect()) == ["a", "b"]


def test_frames_of_bytes(spark, tmp_path):
    """Characters that chunks share stay whole."""
    text = "été🙂;日本;" * 20 + "rest"
    data = text.encode()
    for batch, part in enumerate((range(0, 60), range(60, len(data)))):
        spark.createDataFrame([("a", k, bytes(data[k : k + 1])) for k in part], "port string, seq long, chunk binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    chunks = spark.readStream.schema("port string, seq long, chunk binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.framed(chunks, ";").writeStream.format("memory").queryName("bytes").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r.frame for r in spark.table("bytes").orderBy("frame_no").collect()] == text.split(";")[:-1]


def test_stream_equals_batch(spark, tmp_path):
    text = {p: "".join(f"{p}{k};" for k in range(20)) + "rest" for p in "ab"}
    src = str(tmp_path / "in")
    for batch in range(3):
        rows = [(p, batch * 100 + i, t[i * 7 : i * 7 + 7]) for p, t in text.items() for i in range(batch * 4, batch * 4 + 4 if batch < 2 else 99) if t[i * 7 : i * 7 + 7]]
        spark.createDataFrame(rows, "port string, seq long, chunk string").coalesce(1).write.mode("append").parquet(src)
    chunks = spark.readStream.schema("port string, seq long, chunk string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = stream.framed(chunks, ";").writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.port, r.frame_no): r.frame for r in spark.table("frames").collect()}
    assert got == {(p, k): f"{p}{k}" for p in text for k in range(20)}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00.0"), (1, "2024-01-01 00:00:00.1"), (1, "2024-01-01 00:00:00.4")], "k long, s string").select("k", F.to_timestamp("s").alias("t"))
    assert sorted(r.changes for r in stream.debounced(events, "k", "t").collect()) == [1, 2]
    assert sorted(r.chunks for r in stream.drained(events, "k", "t").collect()) == [1, 1, 1]
    assert stream.totals(events.withColumn("v", F.lit(2)), "k", "v").first().total == 6


def test_program_on_a_stream(spark, tmp_path):
    from tickloom.plans.examples import EXAMPLES
    from tickloom.plans.program import run_program
    from tickloom.queries import COUNTER
    from tickloom.streaming.programs import actions, program_sink

    schema = "device long, tick long, reads map<int,long>, waits map<int,long>"
    r = random.Random(9)
    rows = [(d, t, {4: r.randrange(2), 14: r.choice([580, 9000])}, {14: 1}) for d in range(3) for t in range(24)]
    for part in range(3):
        own = [x for x in rows if x[1] // 8 == part and not (x[0] == 2 and part == 1)]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, program in (("counter", COUNTER), ("alarm", EXAMPLES["alarm"])):
        stream_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream_.writeStream.foreachBatch(program_sink(program, f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
        q.processAllAvailable()
        q.stop()
        want = run_program(spark.read.parquet(f"{tmp_path}/in"), program)
        assert sorted(map(repr, actions(spark, f"{tmp_path}/{name}").collect())) == sorted(map(repr, want.collect()))
