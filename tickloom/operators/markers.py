"""Markers in text that comes as rows of chunks; no text is put together.

A marker's automaton is in one of as many states as it has bytes: how many of them have
just been seen. A chunk maps each state to the state after it, and such maps compose.
Blocks of consecutive chunks are mapped side by side, the maps of a text's blocks are
applied one after the other, and each block is then read once more from its true state.
What is known of the blocks, a row for each 1024 chunks, is broadcast if it is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, is_small, kept

#: Chunks of a text that one task reads in order.
BLOCK = 1024


class Automaton:
    def __init__(self, marker: bytes):
        if not marker:
            raise ValueError("a marker has at least one byte")
        self.marker = marker

    def read(self, state: int, chunk: bytes) -> tuple[int, list[int]]:
        """The state after ``chunk``, and where markers end in it; a marker starts
        behind the one before."""
        text, at, ends = self.marker[:state] + chunk, 0, []
        while (found := text.find(self.marker, at)) >= 0:
            at = found + len(self.marker)
            ends.append(at - state)
        for n in range(min(len(self.marker) - 1, len(text) - at), 0, -1):
            if text.endswith(self.marker[:n]):
                return n, ends
        return 0, ends


def frames(chunks: DataFrame, key: str, number: str, chunk: str, marker: str | bytes, block: int = BLOCK) -> DataFrame:
    """``key, frame_no, begin_at, end_at`` (bytes) of the text before each marker; what
    follows the last one is no frame.

    Chunks of a ``key`` (null is one) are read by ``number``, which must be its own for
    each; null chunks are empty. Markers may run over any number of chunks. No chunks
    have no frames.
    """
    auto = Automaton(marker.encode() if isinstance(marker, str) else marker)
    size = len(auto.marker)
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("key"), F.floor(F.col(number) / block).cast("bigint").alias("block"), F.col(number).cast("bigint").alias("number"), F.coalesce(F.col(chunk).cast("binary"), F.lit(b"")).alias("chunk"))
    dealt = rows.repartition("key", "block")
    rows = dealt.sortWithinPartitions("key", "block", "number")

    def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, tuple]]:
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "block", *names)), strict=True):
                yield row[:2], row[2:]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block its length, and for each state at its start the state at its
        end, the number of markers, and where the last of them ends (-1: none)."""
        now, out, key_type = None, [], None
        kinds = [("block", pa.int64()), ("length", pa.int64()), ("states", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64()))]

        def close() -> None:
            out.append({"key": now[0], "block": now[1], "length": at, "states": states, "counts": counts, "lasts": lasts})

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", key_type), *kinds]))
            out.clear()
            return done

        def noted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for b in source:
                key_type = b.schema.field("key").type
                yield b

        at, states, counts, lasts = 0, [], [], []
        for group, (text,) in groups(noted(batches), ["chunk"]):
            if group != now:
                if now is not None:
                    close()
                    if len(out) >= BLOCK:
                        yield flush()
                now, at, states, counts, lasts = group, 0, list(range(size)), [0] * size, [-1] * size
            read = {s: auto.read(s, text) for s in set(states)}
            for i, s in enumerate(states):
                states[i], ends = read[s]
                if ends:
                    counts[i] += len(ends)
                    lasts[i] = at + ends[-1]
            at += len(text)
        if now is not None:
            close()
        if out:
            yield flush()

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is known before each block: the state, the bytes, the number of markers
        and where the last of them ends."""
        now, first = None, True
        for batch in batches:
            out = []
            for key_of, length, states, counts, lasts in zip(*(batch.column(n).to_pylist() for n in ("key", "length", "states", "counts", "lasts")), strict=True):
                if first or key_of != now:
                    now, first, state, at, count, last = key_of, False, 0, 0, 0, 0
                out.append((state, at, count, last))
                if lasts[state] >= 0:
                    last = at + lasts[state]
                count, at, state = count + counts[state], at + length, states[state]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), *columns], names=["key_", "block_", "state", "at", "count", "last"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for key_of, block_of, text, *known in zip(*(batch.column(n).to_pylist() for n in ("key", "block", "chunk", "state", "at", "count", "last")), strict=True):
                if (key_of, block_of) != now:
                    now, (state, at, count, last) = (key_of, block_of), known
                state, ends = auto.read(state, text)
                for e in ends:
                    out.append((key_of, count, last, at + e - size))
                    count, last = count + 1, at + e
                at += len(text)
            types = [batch.schema.field("key").type, pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "frame_no", "begin_at", "end_at"])

    mapped = rows.select("key", "block", "chunk").mapInArrow(maps, f"key {kind}, block bigint, length bigint, states array<int>, counts array<bigint>, lasts array<bigint>")
    known = mapped.repartition("key").sortWithinPartitions("key", "block").mapInArrow(begins, f"key_ {kind}, block_ bigint, state int, at bigint, count bigint, last bigint")
    known = kept(known, "markers")
    joined = dealt.join(broadcast_if_small(known), F.col("key").eqNullSafe(F.col("key_")) & (F.col("block") == F.col("block_")))
    if not is_small(known):  # else the rows stay where they are
        joined = joined.repartition("key", "block")
    joined = joined.sortWithinPartitions("key", "block", "number")
    return joined.select("key", "block", "chunk", "state", "at", "count", "last").mapInArrow(borders, f"`{key}` {kind}, frame_no bigint, begin_at bigint, end_at bigint")
