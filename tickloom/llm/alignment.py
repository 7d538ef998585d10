"""Aligning two tokenizers: which tokens of one stand for which of the other.

A document's tokens of both kinds cover the same bytes. Where tokens of both end at
the same byte, a group ends; the two tokens that end there are linked. All is done on
Arrow columns of whole blocks of documents: the lists of ids are flattened with the
index of their document, ends are cumulative sums of token lengths started again in
each document, and an Acero hash join on (document, end) finds the common ends.

How often two ids are linked in the corpus is counted in each task by
``Table.group_by``; Spark adds the counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, sentence_pieces
from .common import give_back, read, stored, text_of
from .sentence_pieces import SPACE

#: Bytes of text that a task aligns at a time (a longer document is a block by itself).
BLOCK_BYTES = 1_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 1_000_000
#: Pairs of the corpus whose counts a task looks up at a time: 32 MB.
PAIR_BLOCK = 2_000_000

#: Tokens of finished documents that a task reads at a time.
BLOCK_TOKENS = 500_000
#: Marks the last token of a group.
LAST = np.uint32(1 << 31)

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, a_ids binary, b_ids binary"
ALIGNED_ARROW = pa.schema([*((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups")), ("a_ids", pa.binary()), ("b_ids", pa.binary())])

SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string"
SCORED_ARROW = pa.schema([*((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum")), ("groups_sha256", pa.string())])


class PieceTokens:
    """The second tokenizer. No piece runs from a word into the next one's space, so
    a block's distinct words are encoded once each."""

    def __init__(self, model: bytes):
        self.core = sentence_pieces._loaded(model)
        p = self.core.whole
        said = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.tokens = pa.array([bytes([int(t[3:-1], 16)]) if p.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(said)], pa.binary())

    def block(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block one after the other, and their number by
        text. ``data``: the texts, each with a space before it; ``starts``: where."""
        space = np.frombuffer(data, np.uint8) == 32
        cut = space.copy() if self.core.meets else np.zeros(len(space), bool)
        cut[1:] &= ~space[:-1]
        cut[starts] = True
        at = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        lists = self.core.raw.encode(words.dictionary.to_numpy(zero_copy_only=False).tolist(), num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum())
        word = words.indices.to_numpy()
        counts = sizes[word]
        ends = np.cumsum(counts)
        from_own_start = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        return ids[np.repeat((np.cumsum(sizes) - sizes)[word], counts) + from_own_start], np.add.reduceat(counts, np.searchsorted(at, starts))


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> PieceTokens:
    return PieceTokens(model)


def _ends(ids: np.ndarray, counts: np.ndarray, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token ends, from the start of its document; where the documents'
    bytes begin and end; and these bytes."""
    said = tokens.take(pa.array(ids))
    all_ends = np.frombuffer(said.buffers()[1], np.int32, len(ids) + 1)
    edges = all_ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    return all_ends[1:] - np.repeat(edges[:-1], counts), edges, np.frombuffer(said.buffers()[2], np.uint8, edges[-1])


def align_block(texts: list[str], a: byte_bpe.ByteBpe, b: PieceTokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For texts that are not empty: the ids of both tokenizers, one text after the
    other, the last of each group with ``LAST``; and by text the number of ids of both
    and of groups. A text that the tokens of one do not spell has none."""
    said = [f" {t}".encode() for t in texts]
    sizes = np.array([len(s) for s in said], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = b"".join(said)
    lists = [a.ids(f" {t}") for t in texts]
    sides = [(np.concatenate(lists), np.array([len(x) for x in lists], np.int64), a.tokens), (*b.block(data, starts), b.tokens)]
    fits, ends = np.ones(len(texts), bool), []
    for ids, counts, tokens in sides:
        own, edges, got = _ends(ids, counts, tokens)
        ends.append(own)
        if not np.array_equal(got, np.frombuffer(data, np.uint8)):
            fits &= np.array([got[edges[i] : edges[i + 1]].tobytes() == s for i, s in enumerate(said)], bool)
    ids_of, counts_of, parents, tables = [], [], [], []
    for name, (ids, counts, _), own in zip("ab", sides, ends, strict=True):
        parent, kept = np.repeat(np.arange(len(texts)), counts), slice(None)
        if not fits.all():
            kept = fits[parent]
        ids_of.append(ids[kept])
        counts_of.append(np.where(fits, counts, 0))
        parents.append(parent[kept])
        # No two documents share a byte: its start and the end make one key of both.
        tables.append(pa.table({"key": (np.repeat(starts, counts) + own)[kept].astype(np.int32), name: np.arange(len(ids_of[-1]), dtype=np.int32)}))
    both = tables[0].join(tables[1], keys="key", join_type="inner", use_threads=False)
    groups = np.bincount(parents[0][both.column("a").to_numpy()], minlength=len(texts))
    out = []
    for name, ids in zip("ab", ids_of, strict=True):
        out.append(ids.astype(np.uint32))
        out[-1][both.column(name).to_numpy()] |= LAST
    return out, [*counts_of, groups]


def _blobs(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ids of each row as bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


def align(docs: DataFrame, model_a: str = byte_bpe.MODEL, model_b: str = sentence_pieces.MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, with ``row`` as its own number: the ids of both
    tokenizers of a space and the text, as little-endian ``uint32``; the highest bit
    marks the last token of a group on either side. Strings of special tokens are plain text. Texts that are
    null or empty, or that the tokens of one side do not spell byte by byte, have no
    tokens. Repeated rows and ids are aligned each; other columns are not read; an
    empty table gives no rows."""
    spark = docs.sparkSession
    with open(model_a, "rb") as f, open(model_b, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe.loaded(shared.value[0]), _pieces(shared.value[1])
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy()
            block = np.cumsum(sizes) // BLOCK_BYTES
            for k in np.unique(block):
                own = np.flatnonzero(block == k)
                part = batch.slice(own[0], len(own))
                texts = part.column(2).to_pylist()
                there = np.array([bool(t) for t in texts])
                numbers, counts = align_block([t for t in texts if t], a, b) if there.any() else ([np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.int64)] * 3)
                n_a, n_b, n_groups = (np.bincount(np.flatnonzero(there), c, len(texts)).astype(np.int64) for c in counts)
                blobs = [_blobs(x, n) for x, n in zip(numbers, (n_a, n_b), strict=True)]
                counted = [pa.array(n) for n in (n_a, n_b, n_groups)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counted, *blobs], schema=ALIGNED_ARROW)
        give_back()

    said = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`").cast("string")).alias("said"))
    return said.mapInArrow(run, ALIGNED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``BLOCK_TOKENS`` tokens, with the marked ids of both sides."""
    for batch in batches:
        n = np.cumsum(pc.binary_length(batch.column("a_ids")).to_numpy().astype(np.int64)) // (4 * BLOCK_TOKENS)
        edges = [0, *(np.flatnonzero(np.diff(n)) + 1), len(n)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start < end:
                part = batch.slice(start, end - start)
                yield part, _flat(part.column("a_ids")), _flat(part.column("b_ids"))


def _flat(column: pa.Array) -> np.ndarray:
    """The ids of a column of blobs, one row after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32)
    return np.frombuffer(column.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0])


def _pairs(a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """The linked ids (the last of both sides of each group), as one number."""
    first, second = (x[x >= LAST] ^ LAST for x in (a_ids, b_ids))
    return second.astype(np.int64) << 32 | first


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids (the second side's id, 32 bits, the
    first one's), and whether no pair with the second id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for _, a_ids, b_ids in _blocks(batches):
            pairs = _pairs(a_ids, b_ids)
            new = pa.table({"pair": pairs, "n": np.ones(len(pairs), np.int64)})
            held = pa.concat_tables([held, new])
            if held.num_rows > 4 * HELD_PAIRS:
                held = _summed(held)
                if held.num_rows > HELD_PAIRS:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from _summed(held).to_batches()
        give_back()

    partial = aligned.select("a_ids", "b_ids").mapInArrow(run, "pair long, n long")
    counts = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.shiftright("pair", 32)
    most = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", second).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(table: pa.Table) -> pa.Table:
    return table.group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose pair is the most frequent of
    its second id), ``count_sum`` (of the counts of all links' pairs) and
    ``groups_sha256`` (of the groups as text, ``a1,a2|b1;a3|b2,b3``; empty without
    tokens) in place of the lists.

    Counts are looked up in blocks of ``PAIR_BLOCK`` pairs, each of which is sent to
    all tasks; there are as many passes over ``aligned`` as blocks."""
    spark = aligned.sparkSession
    blocks = max(1, -(-counts.count() // PAIR_BLOCK))
    parts = []
    for k in range(blocks):
        own = counts if blocks == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        table = own.toArrow().sort_by("pair")
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = k == 0) -> Iterator[pa.RecordBatch]:
            keys, counted, best = shared.value
            for batch, a_ids, b_ids in _blocks(batches):
                pairs = _pairs(a_ids, b_ids)
                doc = np.repeat(np.arange(batch.num_rows), batch.column("n_groups").to_numpy())
                at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                at, doc = at[hit], doc[hit]
                sums = np.zeros(batch.num_rows, np.int64)
                np.add.at(sums, doc, counted[at])
                n_best = np.bincount(doc[best[at]], minlength=batch.num_rows)
                digests = pa.array(_digests(batch, a_ids, b_ids) if first else [None] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups")), pa.array(n_best, pa.int64()), pa.array(sums), digests], schema=SCORED_ARROW)
            give_back()

        parts.append(aligned.mapInArrow(run, SCORED))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if blocks > 1:
        out = out.groupBy("row", "doc_id", "n_a", "n_b", "n_groups").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return out.withColumn("n_links", F.col("n_groups"))  # no token is empty, so two end at each common end


@lru_cache(maxsize=1)
def _decimals(bits: int) -> pa.Array:
    """All ids with what may stand behind them."""
    return pa.array([f"{i}{e}" for e in (",", "|", ";", "") for i in range(1 << bits)], pa.string())


def _digests(batch: pa.RecordBatch, a_ids: np.ndarray, b_ids: np.ndarray) -> list[str]:
    a_n, b_n = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
    a_end, b_end = a_ids >= LAST, b_ids >= LAST
    a_ids, b_ids = (np.where(e, x ^ LAST, x).astype(np.int64) for x, e in ((a_ids, a_end), (b_ids, b_end)))
    bits = max(16, int(max(a_ids.max(initial=0), b_ids.max(initial=0))).bit_length())
    b_more = b_end * 2
    b_more[np.cumsum(b_n)[b_n > 0] - 1] = 3
    # A token of the second side stands behind all of the first up to its group's end.
    a_sizes, b_sizes = (np.diff(np.flatnonzero(e), prepend=-1) for e in (a_end, b_end))
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = a_end.astype(np.int64) << bits | a_ids
    order[np.arange(len(b_ids)) + np.repeat(np.cumsum(a_sizes), b_sizes)] = b_more << bits | b_ids
    ends, out = np.cumsum(a_n + b_n), []
    for end, n in zip(ends, a_n + b_n, strict=True):
        if not n:
            out.append("")
            continue
        said = _decimals(bits).take(pa.array(order[end - n : end]))
        out.append(hashlib.sha256(memoryview(said.buffers()[2])[: np.frombuffer(said.buffers()[1], np.int32)[n]]).hexdigest())
    return out


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents."""
    aligned = stored(align(read(spark, sf_dir, "documents")), "aligned", compression="zstd")
    return scored(aligned, stored(pair_counts(aligned), "pairs")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SQL: dict[str, str] = {}
QUERIES = {"op12_alignment": op12_alignment}
