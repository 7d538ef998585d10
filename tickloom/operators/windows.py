"""Moving order statistics over time: windows that no running sum can give."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import broadcast_if_small, kept

#: Rows after which a key's time is cut into a further range.
RANGE_ROWS = 200_000
BLOCK = 512


class Ordered:
    """Values in order, in blocks of bounded length: takes, drops and finds by rank."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.ends: list[float] = []  # the largest value of each block
        self.n = 0

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks, self.ends = [[x]], [x]
            return
        i = min(bisect_left(self.ends, x), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, x)
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.ends[i : i + 1] = [block[half - 1], block[-1]]
        else:
            self.ends[i] = block[-1]

    def drop(self, x: float) -> None:
        self.n -= 1
        i = bisect_left(self.ends, x)
        block = self.blocks[i]
        block.pop(bisect_left(block, x))
        if block:
            self.ends[i] = block[-1]
        else:
            del self.blocks[i], self.ends[i]

    def at(self, rank: int) -> float:
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)


class Frame:
    """The frame of the last row seen: what a range of one key needs at a time."""

    def __init__(self, reach: int, q: float):
        self.reach, self.q = reach, q
        self.begin(None)

    def begin(self, group: object) -> None:
        self.group, self.values, self.times = group, Ordered(), deque()

    def step(self, at: int, values: list[float | None]) -> tuple[float | None, int]:
        """All rows of one moment come in; the quantile and the number of values then."""
        for v in values:
            if v is not None:
                self.values.add(v)
                self.times.append((at, v))
        while self.times and self.times[0][0] < at - self.reach:
            self.values.drop(self.times.popleft()[1])
        n = self.values.n
        return (self.values.at(max(math.ceil(n * self.q) - 1, 0)) if n else None), n


def _ranges(rows: DataFrame, reach: int, cell: int, range_rows: int) -> DataFrame:
    """``__key, __cell, __own, __upto``: the range of each stretch of time of ``cell``, and the last range
    whose frames reach back to it. A key has a range for each ``range_rows`` rows, so most
    have one, and cells are not cut."""
    counts = rows.groupBy("__key", "__cell").agg(F.count(F.lit(1)).alias("n"))
    by_cell = W.partitionBy("__key").orderBy("__cell")
    before = F.coalesce(F.sum("n").over(by_cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__raw", F.floor(before / range_rows))
    numbered = cut.withColumn("__own", F.dense_rank().over(W.partitionBy("__key").orderBy("__raw")))
    ahead = by_cell.rangeBetween(0, math.ceil(reach / cell))
    return numbered.withColumn("__upto", F.max("__own").over(ahead)).select("__key", "__cell", "__own", "__upto")


def moving_quantile(df: DataFrame, key: str, at: str, value: str, reach: int, q: float = 0.5, cell: int | None = None, range_rows: int = RANGE_ROWS, name: str = "quantile", number: str = "n_values") -> DataFrame:
    """``df`` with the ``q``-quantile of ``value`` (double) over the rows of the same ``key`` whose time
    ``at`` (long, in any unit) is not after the row's and at most ``reach`` before, and the
    ``number`` of values there. Rows of the same time see each other. The quantile is the value of
    rank ``ceil(q * n)``, at least 1, so the lower one of two middle values.

    Each key's time is cut into ranges of about ``range_rows`` rows, along stretches of ``cell``
    (a sixteenth of ``reach``); a range also gets the rows before it that its frames reach back
    to. Ranges are sorted by Spark and walked in blocks of rows, so a task holds the frame of one
    row, of which a dense key has no smaller one, and not its range or key. Null values are no
    values; NaN counts as infinity. Rows without key or time stay and have a null quantile
    and 0 values. Repeated rows count each.
    """
    cell = cell or max(1, reach // 16)
    out_type = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(number, T.LongType())])
    there = F.col(f"`{key}`").isNotNull() & F.col(f"`{at}`").isNotNull()
    helper: dict[str, Column] = {"__key": F.col(f"`{key}`"), "__at": F.col(f"`{at}`").cast("bigint"), "__cell": F.floor(F.col(f"`{at}`") / cell), "__value": F.col(f"`{value}`").cast("double")}
    rows = df.where(there).withColumns(helper)
    ranges = kept(_ranges(rows.select("__key", "__cell"), reach, cell, range_rows), "ranges")
    dealt = rows.join(broadcast_if_small(ranges), ["__key", "__cell"])
    dealt = dealt.withColumn("__range", F.explode(F.sequence("__own", "__upto"))).withColumn("__mine", F.col("__range") == F.col("__own"))
    # Rows that only lend their value to a later range travel without the rest.
    packed = F.when(F.col("__mine"), F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row")
    group = F.struct("__key", "__range").alias("__group")
    dealt = dealt.select(group, "__at", "__value", packed).repartition("__group").sortWithinPartitions("__group", "__at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, held = Frame(reach, q), []

        def moments(table: pa.Table) -> pa.RecordBatch:
            times, values = table["__at"].to_pylist(), table["__value"].to_pylist()
            groups = [tuple(g.values()) for g in table["__group"].to_pylist()]
            found, counts, i = [], [], 0
            while i < len(times):
                j = i
                while j < len(times) and times[j] == times[i] and groups[j] == groups[i]:
                    j += 1
                if groups[i] != frame.group:
                    frame.begin(groups[i])
                v, n = frame.step(times[i], [math.inf if x is not None and x != x else x for x in values[i:j]])
                found += [v] * (j - i)
                counts += [n] * (j - i)
                i = j
            whole = table["__row"].combine_chunks()
            whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
            mine = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
            kept_rows = whole.take(pa.array(mine))
            columns = [*kept_rows.flatten(), pa.array(found, pa.float64()).take(pa.array(mine)), pa.array(counts, pa.int64()).take(pa.array(mine))]
            return pa.RecordBatch.from_arrays(columns, names=out_type.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # The rows of the last moment wait for more of them.
            last = batch.slice(batch.num_rows - 1).to_pylist()[0]
            mark = (last["__group"], last["__at"])
            first = held[0].slice(0, 1).to_pylist()[0]
            if (first["__group"], first["__at"]) == mark:
                continue
            table, end = pa.Table.from_batches(held), sum(b.num_rows for b in held) - 1
            ats, groups = table["__at"], table["__group"]
            while ats[end - 1].as_py() == mark[1] and groups[end - 1].as_py() == mark[0]:
                end -= 1
            yield moments(table.slice(0, end))
            held = table.slice(end).to_batches()
        if held:
            yield moments(pa.Table.from_batches(held))

    done = dealt.mapInArrow(walk, out_type)
    alone = df.where(~there).select("*", F.lit(None).cast("double").alias(name), F.lit(0).cast("long").alias(number))
    return done.unionByName(alone)
