"""Variables that are set or changed under conditions, and loops without a bound.

What a row does to a variable is a function of its value before. Such functions are
composed, which is associative: inside ranges of each key's order, and over the ranges.
A key with a third of all rows is spread over as many tasks as it has ranges, and no
task holds more of a range than a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import kept

#: Rounds of a loop in one pass over the rows that still run, at most.
MOST_ROUNDS = 1 << 14


def assign(df: DataFrame, key: str, order: Sequence[str], span: Column, to: Column, by: Column, name: str = "value", start: int = 0) -> DataFrame:
    """``df`` with the value of a variable after each row: a row sets it to ``to`` where
    that is not null, and then adds ``by`` (null: 0). Before the first row it is ``start``.

    A row either sets the value or adds to it, and so does any run of rows, so all are
    window sums in built-in expressions. ``order`` must be total; ``span`` must grow with
    it. A null key is a key; sums beyond 64 bits raise. An empty table stays empty.
    """
    df = df.withColumns({"__span": span, "__to": to.cast("bigint"), "__by": F.coalesce(by.cast("bigint"), F.lit(0))})
    df = _since_set(df, W.partitionBy(key, "__span").orderBy(*order))
    ends = df.groupBy(F.col(key).alias("__key"), F.col("__span").alias("__range")).agg(F.max_by(F.struct("__set", "__here"), F.struct(*order)).alias("end"))
    ends = ends.select("__key", "__range", F.when(F.col("end.__set"), F.col("end.__here")).alias("__to"), F.when(~F.col("end.__set"), F.col("end.__here")).otherwise(0).alias("__by"))
    over = W.partitionBy("__key").orderBy("__range")
    after = F.when(F.col("__set"), F.col("__here")).otherwise(F.col("__here") + start)
    ends = _since_set(ends, over).select("__key", "__range", F.lag(after, 1, start).over(over).alias("__ahead"))
    df = df.join(ends, F.col(key).eqNullSafe(F.col("__key")) & F.col("__span").eqNullSafe(F.col("__range")))
    df = df.withColumn(name, F.when(F.col("__set"), F.col("__here")).otherwise(F.col("__here") + F.col("__ahead")))
    return df.drop("__span", "__to", "__by", "__set", "__here", "__key", "__range", "__ahead")


def _since_set(df: DataFrame, over: WindowSpec) -> DataFrame:
    """``__here``: the value, counted from 0 before the window; ``__set``: whether it
    does not depend on what was before."""
    upto = over.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("__sum", F.sum("__by").over(upto))
    # What the last set value would have been, had all additions begun at it.
    base = F.last(F.col("__to") - (F.col("__sum") - F.col("__by")), ignorenulls=True).over(upto)
    return df.withColumn("__base", base).withColumns({"__set": F.col("__base").isNotNull(), "__here": F.col("__sum") + F.coalesce("__base", F.lit(0))}).drop("__sum", "__base")


def affine(df: DataFrame, key: str, order: Sequence[str], span: Column, factor: Column, addend: Column, name: str = "value", start: int = 0) -> DataFrame:
    """``df`` with the value of a variable after each row ``value = value * factor +
    addend`` (null: 1, and 0). Exact: composed maps are integers of any length, and a
    value beyond 64 bits raises. ``order`` must be total; ``span`` must grow with it."""
    df = df.withColumns({"__span": span, "__f": F.coalesce(factor.cast("bigint"), F.lit(1)), "__a": F.coalesce(addend.cast("bigint"), F.lit(0))})
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    narrow = df.select(F.col(key).alias("key"), F.col("__span").alias("range"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "__f", "__a")
    sort = ["key", "range", *[f"o{i}" for i in range(len(order))]]
    maps = narrow.repartition("key", "range").sortWithinPartitions(*sort).select("key", "range", "__f", "__a").mapInArrow(_composed, f"key {kind[key]}, range {kind['__span']}, f string, a string")
    begins = maps.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_begins(start), f"__key {kind[key]}, __range {kind['__span']}, __ahead string")
    rows = df.join(begins, F.col(key).eqNullSafe(F.col("__key")) & F.col("__span").eqNullSafe(F.col("__range")))
    rows = rows.repartition(key, "__span").sortWithinPartitions(key, "__span", *order).drop("__key", "__range")
    out = rows.select(*[c for c in df.columns if not c.startswith("__")], "__f", "__a", "__ahead", key, "__span")
    schema = ", ".join(f"`{c}` {kind[c]}" for c in df.columns if not c.startswith("__"))
    named = out.toDF(*out.columns[:-2], "__key", "__range")
    return named.mapInArrow(_applied(name), f"{schema}, `{name}` bigint")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One map for each run of rows with the same key and range."""
    now, f, a = None, 1, 0
    for batch in batches:
        keys, ranges, done_f, done_a = [], [], [], []
        for *group, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and group != now:
                for column, v in zip((keys, ranges, done_f, done_a), (*now, str(f), str(a)), strict=True):
                    column.append(v)
                f, a = 1, 0
            now, f, a = group, f * x, a * x + y
        types = batch.schema.types[:2]
        yield pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(ranges, types[1]), pa.array(done_f, pa.string()), pa.array(done_a, pa.string())], names=["key", "range", "f", "a"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], types[0]), pa.array([now[1]], types[1]), pa.array([str(f)]), pa.array([str(a)])], names=["key", "range", "f", "a"])


def _begins(start: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The value before each range of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, first = None, start, True
        for batch in batches:
            out = []
            for key, f, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if first or key != now:
                    now, value, first = key, start, False
                out.append(str(value))
                value = value * int(f) + int(a)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["__key", "__range", "__ahead"])

    return run


def _applied(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The value after each row; the last five columns are the row's map, the value before
    its range, and its key and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, 0
        for batch in batches:
            out = []
            for f, a, ahead, *group in zip(*(c.to_pylist() for c in batch.columns[-5:]), strict=True):
                if group != now:
                    now, value = group, int(ahead)
                value = value * f + a
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(out, pa.int64())], names=[*batch.schema.names[:-5], name])

    return run


def while_loop(
    df: DataFrame, state: dict[str, Column], condition: Callable[[Column], Column], step: Callable[[Column], dict[str, Column]], rounds: str = "rounds", at_once: int = 64, most: int | None = None
) -> DataFrame:
    """``while condition: state = step`` for each row by itself: ``df`` with the final
    ``state`` and the number of ``rounds``. A null condition is false.

    All rows run at a time. Those that are done are put aside after each pass, and only
    the others are read in the next, which does twice as many rounds. There is no limit,
    so rows that never end never do; with ``most``, an error is raised once a row has
    run that many rounds.
    """
    first = F.struct(*[c.alias(n) for n, c in state.items()], F.lit(0).cast("bigint").alias(rounds))
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in df.select(first.alias("s")).schema["s"].dataType])  # all may become null
    front = df.withColumn("__s", first.cast(kind))
    on = lambda s: F.coalesce(condition(s), F.lit(False))
    turn = lambda s: F.struct(*[c.alias(n) for n, c in step(s).items()], (s[rounds] + 1).alias(rounds)).cast(kind)
    done: list[DataFrame] = []
    while True:
        run = F.aggregate(F.sequence(F.lit(1), F.lit(at_once)), F.col("__s"), lambda s, _: F.when(on(s), turn(s)).otherwise(s))
        passed = kept(front.withColumn("__s", run).withColumn("__on", on(F.col("__s"))), "while")
        done.append(passed.where("not __on"))
        front = passed.where("__on").drop("__on")
        if front.isEmpty():
            break
        if most is not None and not front.where(F.col("__s")[rounds] >= most).isEmpty():
            raise RuntimeError(f"a loop has not ended after {most} rounds")
        at_once = min(MOST_ROUNDS, 2 * at_once)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*df.columns, *[F.col("__s")[n].alias(n) for n in (*state, rounds)])
