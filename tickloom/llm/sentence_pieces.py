"""SentencePiece encoding and decoding, with giant documents split into chunks.

The model's BPE segmentation of a text is the one path of pieces in which every two
neighbours are, by themselves, encoded as these two pieces. That makes it a
max-plus problem: pieces weigh their scores, and forbidden neighbours minus
infinity. A chunk's boundary state is the piece that covers or reaches the chunk's
border. A chunk yields the matrix of best weights from each state at its start to
each state at its end; matrices combine associatively, which gives the state at
every border, and each chunk is then traced back by itself.

No piece runs from a word into the next one's space, so all paths meet at the
starts of words. Between a chunk's first and last such point the library encodes;
matrices only need the pieces before and after. A chunk without such a point (one
word of thousands of characters) is walked as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, read, stored, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer documents, in characters, are giant: they are split into such chunks.
CHUNK = 32_768
#: Rows that are encoded or decoded at a time; their Python objects take many times
#: the room of the text.
BLOCK_ROWS = 128
SPACE = "▁"
#: A boundary state: where the piece ends, counted from the border, and the piece.
State = tuple[int, str]
START: State = (0, "")


class Pieces:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity":
            raise ValueError("a BPE model with identity normalisation is needed")
        self.whole = spm.SentencePieceProcessor(model_proto=model)
        proto.normalizer_spec.add_dummy_prefix = False
        self.raw = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.longest = max(map(len, self.score))
        self.meets = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self._ids: dict[str, list[int]] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def ids(self, text: str) -> list[int]:
        found = self._ids.get(text)
        if found is None:
            found = self._ids[text] = self.raw.encode(text)
        return found

    def piece(self, text: str) -> bool:
        """Whether the text alone is encoded as one piece; a character that the
        vocabulary lacks stands by itself."""
        return (text in self.score and len(self.ids(text)) == 1) or (len(text) == 1 and text not in self.score)

    def fit(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self._fits.get(key)
        if found is None:
            found = self._fits[key] = not a or self.raw.encode(a + b) == self.ids(a) + self.ids(b)
        return found

    def at(self, text: str, i: int) -> Iterator[str]:
        for n in range(1, min(self.longest, len(text) - i) + 1):
            if self.piece(p := text[i : i + n]):
                yield p

    def states(self, text: str, border: int) -> list[State]:
        """The boundary states at ``border``, from the text around it."""
        out = []
        for start in range(max(0, border - self.longest), border):
            out += [(start + len(p) - border, p) for p in self.at(text, start) if start + len(p) >= border]
        return sorted(out)

    def cuts(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and the last start of a word at ``start`` or later, before
        ``end``."""
        if not self.meets:
            return None
        first = next((i for i in range(max(1, start), end) if text[i] == SPACE and text[i - 1] != SPACE), None)
        if first is None:
            return None
        last = next(i for i in range(end - 1, first - 1, -1) if text[i] == SPACE and text[i - 1] != SPACE)
        return first, last

    def walk(self, text: str, begins: list[tuple[int, str]], end: int) -> dict[int, dict[str, np.ndarray]]:
        """Best weights, by place and last piece, of the paths from each of
        ``begins`` to the first place at ``end`` or later."""
        found: dict[int, dict[str, np.ndarray]] = {}
        for k, (at, piece) in enumerate(begins):
            v = found.setdefault(at, {}).setdefault(piece, np.full(len(begins), -np.inf))
            v[k] = 0.0
        for i in range(min(found, default=end), end):
            if here := found.pop(i, None):
                for p in self.at(text, i):
                    into = [v for before, v in here.items() if self.fit(before, p)]
                    if into:
                        best = np.max(into, axis=0) + self.score.get(p, 0.0)
                        there = found.setdefault(i + len(p), {})
                        there[p] = np.maximum(there[p], best) if p in there else best
        return found

    def trace(self, text: str, begin: tuple[int, str], ends: set[tuple[int, str]] | int) -> list[str]:
        """The pieces of the best path from ``begin`` to one of ``ends`` (place and
        last piece), or to a place with any last piece."""
        place = ends if isinstance(ends, int) else max(e for e, _ in ends)
        best: dict[int, dict[str, tuple[float, int, str]]] = {begin[0]: {begin[1]: (0.0, -1, "")}}
        stop = place if isinstance(ends, int) else max(begin[0], min(e - len(p) for e, p in ends) + 1)
        for i in range(begin[0], stop):
            for p in self.at(text, i) if i in best else ():
                into = [(w + self.score.get(p, 0.0), i, before) for before, (w, _, _) in best[i].items() if self.fit(before, p)]
                if into and (top := max(into)) > best.setdefault(i + len(p), {}).get(p, (-np.inf, -1, "")):
                    best[i + len(p)][p] = top
        goal = max((w, place, p) for p, (w, _, _) in best[place].items()) if isinstance(ends, int) else max((best[e][p][0], e, p) for e, p in ends)
        out, at, piece = [], goal[1], goal[2]
        while best[at][piece][1] >= 0:
            out.append(piece)
            _, at, piece = best[at][piece]
        return out[::-1]


@dataclass(frozen=True)
class Chunk:
    """``text``: the chunk, with up to ``longest`` characters before and after it;
    it starts at ``start`` and ends at ``end``. ``first``, ``last``: of its
    document."""

    text: str
    start: int
    end: int
    first: bool
    last: bool

    def begins(self, m: Pieces) -> list[State]:
        return [START] if self.first else m.states(self.text, self.start)

    def ends(self, m: Pieces) -> list[State]:
        return [START] if self.last else m.states(self.text, self.end)


def transfer(m: Pieces, c: Chunk) -> np.ndarray:
    """Best weights from each state at the start to each state at the end. The
    part between the chunk's outer word starts weighs the same for all."""
    begins, ends = c.begins(m), c.ends(m)
    at = [(c.start + k, p) for k, p in begins]
    cut = m.cuts(c.text, max(e for e, _ in at), c.end) if at else None
    if cut is None:
        return _matrix(m.walk(c.text, at, c.end), c, ends, len(at))
    before = m.walk(c.text, at, cut[0]).get(cut[0], {})
    head = np.max(list(before.values()), axis=0) if before else np.full(len(at), -np.inf)
    tail = _matrix(m.walk(c.text, [(cut[1], "")], c.end), c, ends, 1)
    return head[:, None] + tail


def _matrix(found: dict[int, dict[str, np.ndarray]], c: Chunk, ends: list[State], n: int) -> np.ndarray:
    none = np.full(n, -np.inf)
    if c.last:
        return np.max([none, *found.get(c.end, {}).values()], axis=0)[:, None]
    cols = [found.get(c.end + k, {}).get(p, none) for k, p in ends]
    return np.stack(cols, axis=1) if cols else np.zeros((n, 0))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; it is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each chunk the state at its start and at its end on the best path, from
    the products of all matrices before and of all after each border."""
    ahead = [matrices[0]]
    for x in matrices[1:]:
        ahead.append(combine(ahead[-1], x))
    behind = [matrices[-1]]
    for x in matrices[-2::-1]:
        behind.append(combine(x, behind[-1]))
    behind.reverse()
    at = [0]
    for k in range(1, len(matrices)):
        at.append(int(np.argmax(ahead[k - 1][0] + behind[k][:, 0])))
    return list(zip(at, [*at[1:], 0], strict=True))


def chunk_ids(m: Pieces, c: Chunk, begin: int, end: int) -> list[int]:
    """The ids of the pieces that start in the chunk, between two states."""
    k, piece = c.begins(m)[begin]
    here = (c.start + k, piece)
    goal = c.end if c.last else {(c.end + (e := c.ends(m)[end])[0], e[1])}
    cut = m.cuts(c.text, max(c.start + k for k, _ in c.begins(m)), c.end)
    if cut is None:
        return [i for p in m.trace(c.text, here, goal) for i in m.ids(p)]
    head = [i for p in m.trace(c.text, here, cut[0]) for i in m.ids(p)]
    tail = [i for p in m.trace(c.text, (cut[1], ""), goal) for i in m.ids(p)]
    return head + m.raw.encode(c.text[cut[0] : cut[1]]) + tail


def split(text: str, size: int, around: int) -> list[Chunk]:
    """The chunks of a text with its leading space mark."""
    said = SPACE + text.replace(" ", SPACE)
    out = []
    for a in range(0, len(said), size):
        b, low = min(a + size, len(said)), max(0, a - around)
        out.append(Chunk(said[low : b + around], a - low, b - low, a == 0, b == len(said)))
    return out


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the text replaced by its ids, as the library's own ``encode``
    gives them. A null or empty text has no ids. Other columns stay; one that is
    named like ``ids_col`` is replaced. Repeated rows are encoded each. An empty
    table gives no rows."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    around = Pieces(shared.value).longest
    carried = [c for c in docs.columns if c not in (text_col, ids_col)]
    (said_col,) = fresh(docs, "said")
    said = docs.select(*[F.col(f"`{c}`") for c in carried], text_of(text_col).alias(said_col))
    schema = docs.select(*[F.col(f"`{c}`") for c in carried]).withColumn(ids_col, F.array().cast("array<int>")).schema

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                ids = pa.array(m.whole.encode(part.column(said_col).to_pylist(), num_threads=1), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), ids], names=[*carried, ids_col])
        give_back()

    short = said.where(F.length(said_col) < chunk).mapInArrow(small, schema)

    row = (F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("string")).alias("row")
    marked = F.concat(F.lit(SPACE), F.replace(said_col, F.lit(" "), F.lit(SPACE)))
    low = F.greatest(F.lit(0), F.col("n") * chunk - around)
    long = stored(said.where(F.length(said_col) >= chunk).select(row, marked.alias("said"), F.monotonically_increasing_id().alias("doc")), "giant-texts")
    parts = (
        long.withColumn("size", F.length("said"))
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk).cast("int"))))
        .select(
            "doc",
            "n",
            F.substring("said", low + 1, F.col("n") * chunk - low + chunk + around).alias("part"),
            (F.col("n") * chunk - low).cast("int").alias("start"),
            F.least(F.col("n") * chunk - low + chunk, F.col("size") - low).cast("int").alias("end"),
            (F.col("n") == 0).alias("first"),
            ((F.col("n") + 1) * chunk >= F.col("size")).alias("last"),
        )
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk]]:
        """One by one, so that a task holds the objects of one chunk only."""
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                yield r, Chunk(r["part"], r["start"], r["end"], r["first"], r["last"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        out = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("rows", pa.int32()), ("weights", pa.list_(pa.float64()))])
        for r, c in chunks(batches):
            yield pa.RecordBatch.from_pylist([{"doc": r["doc"], "n": r["n"], "rows": len(t := transfer(m, c)), "weights": t.ravel().tolist()}], schema=out)

    def borders(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["n"])
        at = scan([np.array(r["weights"]).reshape(r["rows"], -1) for r in rows])
        return pa.table({"doc": pa.array([r["doc"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int32()), "begin": pa.array([a for a, _ in at], pa.int32()), "finish": pa.array([b for _, b in at], pa.int32())})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        out = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for r, c in chunks(batches):
            yield pa.RecordBatch.from_pylist([{"doc": r["doc"], "n": r["n"], "ids": chunk_ids(m, c, r["begin"], r["finish"])}], schema=out)

    parts = stored(parts.repartition("doc", "n"), "giant-chunks")
    states = parts.mapInArrow(matrices, "doc long, n int, rows int, weights array<double>").groupBy("doc").applyInArrow(borders, "doc long, n int, begin int, finish int")
    states = stored(states, "giant-borders")
    traced = parts.join(states, ["doc", "n"]).select("doc", "n", "part", "start", "end", "first", "last", "begin", "finish").mapInArrow(backtrace, "doc long, n int, ids array<int>")
    whole = traced.groupBy("doc").agg(F.flatten(F.sort_array(F.collect_list(F.struct("n", "ids"))).getField("ids")).alias("ids"))
    giant = whole.join(long.select("doc", "row"), "doc").select(*[F.col("row")[c].alias(c) for c in carried], F.col("ids").alias(ids_col))
    return short.unionByName(giant)


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the ids replaced by their text; null or no ids are an empty
    text."""
    spark = rows.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    carried = [c for c in rows.columns if c not in (ids_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                texts = m.whole.decode([x or [] for x in part.column(ids_col).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(texts, pa.string())], names=[*carried, text_col])
        give_back()

    return rows.select(*carried, ids_col).mapInArrow(run, rows.select(*carried).withColumn(text_col, F.lit("").cast("string")).schema)


def token_digest(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``n_tokens`` and ``ids_sha256`` (of the ids in decimal, joined by commas)."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return rows.withColumns({"n_tokens": F.size(ids_col).cast("long"), "ids_sha256": F.sha2(F.encode(joined, "UTF-8"), 256)})


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.encode(text_of("text"), "UTF-8"), 256).alias("before"))
    coded = token_digest(encode(docs))
    back = decode(coded)
    after = F.sha2(F.encode("text", "UTF-8"), 256)
    return back.select("doc_id", "n_tokens", "ids_sha256", after.alias("decoded_sha256"), (F.col("before") == after).alias("round_trip"))


SQL: dict[str, str] = {}
QUERIES = {"op2_sentence_pieces": op2_sentence_pieces}
