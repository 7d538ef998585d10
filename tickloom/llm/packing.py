"""Packing documents into sequences of a fixed length by minimum bin slack.

Every document is its ids and an end id. Whole windows of a long document are
sequences of their own; what remains of each is shorter than a window. Only the
*lengths* of these remainders matter, and there are fewer than ``size`` different
ones, so the whole corpus is planned from their histogram, whatever its size.

A window starts with the longest remaining length. A subset-sum over bitsets (bit
``s``: the sum ``s`` can be reached) finds the multiset of remaining lengths that fills
the rest closest to capacity, and is traced back to the number of copies of each. The
choice is used again while its lengths last, so each step ends a length or nearly so.
A window that no multiset fills takes the start of one longer remainder, whose rest
stays in the game. What is left in the end is less than a window; it fills sequences
whose lengths are powers of two, which need no padding.

The plan says which ranks of each length go where. Documents get their ranks by
prefix sums of counts over the partitions that encoded them, and find their places in
the plan by themselves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import MODEL, loaded
from .common import broadcast_if_small, give_back, read, stored

SIZE = 2048
END_ID = 1
#: Tokens that a task holds at a time beside one document.
BLOCK_TOKENS = 1_000_000
#: Sequences of whole windows are numbered by the task that encoded them, above this.
OWN = 1 << 40


def fullest(counts: dict[int, int], size: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths, with the longest in it, whose sum is closest to
    ``size`` from below, and what is missing. ``counts``: remaining lengths."""
    first = max(counts)
    room = size - first
    mask, bits, before = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        copies = min(counts[length] - (length == first), room // length)
        if copies <= 0:
            continue
        before.append((length, copies, bits))
        step = 1
        while copies:  # any number of copies as sums of powers of two
            step = min(step, copies)
            bits |= bits << (step * length) & mask
            copies -= step
            step *= 2
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    gap, uses = room - at, {first: 1}
    for length, copies, earlier in reversed(before):
        n = next(n for n in range(copies + 1) if at >= n * length and earlier >> (at - n * length) & 1)
        if n:
            uses[length] = uses.get(length, 0) + n
            at -= n * length
    return uses, gap


@dataclass
class Plan:
    """Rows ``(length, low, high, start, take, sequence, uses, offset, before)``: of the
    remainders of ``length``, those with ranks from ``low`` to ``high`` give ``take``
    tokens from ``start`` on. They are numbered from ``before`` on, ``uses`` of them a
    sequence, side by side from ``offset`` on."""

    rows: list[tuple[int, ...]] = field(default_factory=list)
    sequences: int = 0

    def place(self, taken: list[tuple[int, int, int, int, int]], take: int, uses: int, offset: int) -> None:
        self.rows += [(length, low, high, start, take, self.sequences, uses, offset, before) for length, low, high, start, before in taken]


def plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Places for ``counts[n]`` remainders of ``n`` tokens each. The work and the
    number of rows grow with the number of lengths and the logarithm of the counts."""
    out = Plan()
    held = {n: deque([(n, 0, c, 0)]) for n, c in counts.items() if c}
    count = {n: c for n, c in counts.items() if c}
    left = sum(n * c for n, c in count.items())

    def take(length: int, n: int) -> list[tuple[int, int, int, int, int]]:
        got, before, segments = [], 0, held[length]
        while before < n:
            origin, low, high, start = segments.popleft()
            part = min(high - low, n - before)
            got.append((origin, low, low + part, start, before))
            if low + part < high:
                segments.appendleft((origin, low + part, high, start))
            before += part
        count[length] -= n
        if not count[length]:
            del count[length], held[length]
        return got

    while left >= size:
        uses, gap = fullest(count, size)
        cut = max(n for n, c in count.items() if c > uses.get(n, 0)) if gap else None
        need = uses | ({cut: uses.get(cut, 0) + 1} if cut else {})
        times, offset = min(count[n] // u for n, u in need.items()), 0
        for length, u in uses.items():
            out.place(take(length, times * u), length, u, offset)
            offset += length * u
        if cut:
            taken = take(cut, times)
            out.place(taken, gap, 1, offset)
            rest = held.setdefault(cut - gap, deque())
            rest.extend((origin, low, high, start + gap) for origin, low, high, start, _ in taken)
            count[cut - gap] = count.get(cut - gap, 0) + times
        out.sequences += times
        left -= times * size
    room = offset = 0
    for length in sorted(count, reverse=True):
        for origin, low, high, start, _ in take(length, count[length]):
            for rank in range(low, high):
                done = 0
                while done < length:
                    if not room:
                        room, offset = 1 << (left.bit_length() - 1), 0
                        out.sequences += 1
                    part = min(room, length - done)
                    out.rows.append((origin, rank, rank + 1, start + done, part, out.sequences - 1, 1, offset, 0))
                    done, offset, room, left = done + part, offset + part, room - part, left - part
    return out


class Places:
    """Finds the pieces of the remainder with a length and a rank."""

    def __init__(self, rows: np.ndarray):
        by: dict[int, list[tuple[int, ...]]] = {}
        for r in rows.tolist():
            by.setdefault(r[0], []).append(tuple(r[1:]))
        self.by: dict[int, tuple[list[int], list[list[tuple[int, ...]]]]] = {}
        for length, own in by.items():
            edges = sorted({e for low, high, *_ in own for e in (low, high)})
            at = {e: i for i, e in enumerate(edges)}
            cover: list[list[tuple[int, ...]]] = [[] for _ in edges]
            for r in own:
                for i in range(at[r[0]], at[r[1]]):
                    cover[i].append(r)
            self.by[length] = edges, cover

    def of(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, take, sequence, offset)``"""
        edges, cover = self.by[length]
        for low, _, start, take, sequence, uses, offset, before in cover[bisect_right(edges, rank) - 1]:
            j = before + rank - low
            yield start, take, sequence + j // uses, offset + j % uses * take


TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("own", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def tokens(docs: DataFrame, size: int = SIZE, model: str = MODEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids and the end id (``ids``: as little-endian ``uint16`` if the
    vocabulary allows it, else ``uint32``), their number ``n``, what remains after
    whole windows (``rest``), and, within the task that encodes it (``part``), its
    ``rank`` among rows with this ``rest`` and the number of whole windows before its
    ``own``."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(shared.value), TaskContext.get().partitionId()
        width = _width(bpe.size)
        seen, own, rows, held = [0] * size, 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.append(bpe.ids(batch.column(1)[i].as_py() or "", special=True), end_id)
                n, rest = len(ids), len(ids) % size
                rows.append({"doc_id": batch.column(0)[i].as_py(), "n": n, "part": part, "rest": rest, "rank": seen[rest], "own": own, "ids": ids.astype(width).tobytes()})
                seen[rest], own, held = seen[rest] + 1, own + n // size, held + n
                if held >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist(rows, schema=TOKENS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=TOKENS)
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "doc_id long, n long, part long, rest int, rank long, own long, ids binary")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pack(docs: DataFrame, size: int = SIZE, model: str = MODEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, ids`` (binary, little-endian
    ``uint32``), ``doc_tokens, sequence_id, offset``. A sequence has ``size`` ids, but
    for a few last ones whose lengths are powers of two: nothing is padded.

    A null or empty text is its end id. Repeated rows, ids and null ids are packed row
    by row; other columns are not read. An empty table has no pieces. ``size`` must
    not be below 2.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        width = _width(loaded(f.read()).size)
    held = stored(tokens(docs, size, model, end_id, id_col, text_col), "packed-tokens", compression="zstd")
    counts = stored(held.where("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("rows")), "packed-counts")
    # At most size - 1 rows, whatever the corpus.
    chosen = plan({r["rest"]: r["rows"] for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}, size)
    shared = spark.sparkContext.broadcast(np.array(chosen.rows, np.int64).reshape(-1, 9))
    ahead = F.sum("rows").over(W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("part", "rest", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    ranked = held.join(broadcast_if_small(counts), ["part", "rest"], "left").select("doc_id", "n", "part", "rest", (F.col("rank") + F.col("ahead")).alias("rank"), "own", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        rows: list[tuple] = []
        held_ids = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                doc, n, part, rest, rank, own, ids = (c[i].as_py() for c in columns)
                ids = np.frombuffer(ids, width).astype("<u4")
                whole = n // size
                at = [(k * size, size, (part + 1) * OWN + own + k, 0) for k in range(whole)]
                if rest:
                    at += [(whole * size + start, take, sequence, offset) for start, take, sequence, offset in places.of(rest, rank)]
                for start, take, sequence, offset in at:
                    rows.append((doc, start, take, ids[start : start + take].tobytes(), n, sequence, offset))
                    held_ids += take
                    if held_ids >= BLOCK_TOKENS:
                        yield _batch(rows)
                        rows, held_ids = [], 0
        if rows:
            yield _batch(rows)
        give_back()

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
QUERIES = {"op13_packing": op13_packing}
