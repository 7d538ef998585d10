"""Near-duplicate classes by BagMinHash over multisets of word shingles.

1. Exact copies collapse to the row with the smallest id.
2. Every remaining text's multiset of five-word shingles gets a BagMinHash
   signature. The weights (multiplicities) are discretised at the integers, and the
   integers fall into the dyadic intervals (0,1], (1,2], (2,4], ... Each shingle and
   interval owns a Poisson process whose points carry a time, a register and a
   level; a text sees the points below its weight. A register's value is the point
   with the smallest time, so two texts agree in a register with the probability of
   their weighted Jaccard similarity.
3. Signatures are cut into bands; texts that share a band, a bucket, are candidates.
4. Candidates are compared exactly. First every text is compared with three pivots of
   each of its buckets. Buckets whose texts already are in one component need
   nothing more. Texts outside a bucket's largest component are compared with all texts
   of other components: as pairs in small buckets, and in large ones by blocks inside
   tasks, which return a spanning set of links and not pairs. Blocks are bounded by
   number of texts and by bytes. No link between texts of a bucket is lost, and no
   group is gathered in one task.
5. Connected components of the links, by alternating large-star and small-star
   steps on distributed tables, are the classes. Nodes with very many links are joined
   apart from the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, drop, fresh, give_back, read, row_bytes, stored
from .exact_dedup import bit_filter, find_copies, keep_first, verdicts
from .words import GOLDEN, as_strings, blocks, mixed, padded, window_hashes, word_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 8
#: Buckets up to this size are compared as pairs, larger ones in blocks.
PAIRED = 16
#: Texts and bytes of a block's side.
BLOCK = 512
BLOCK_BYTES = 2_000_000
#: A node with over one of so many ends of links is joined apart.
HUB_SHARE = 1024
#: Bytes of text that are hashed together.
TEXT_BYTES = 1_000_000
_U = np.uint64


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(texts: pa.Array | Sequence[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every shingle, by text. A text with fewer
    words than ``width``, but at least one, is one shingle."""
    doc, _, h = window_hashes(*padded(*word_hashes(texts), width), width)
    return doc, h


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with multiplicity."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash signatures, one row per text; rows of texts without shingles are
    meaningless. ``weight``: positive integers."""
    times = np.full(n_docs * registers, np.inf)
    marks = np.zeros(n_docs * registers, np.uint64)
    # One stream per shingle and interval: (0,1] is interval 0, (2**(k-1), 2**k] is k.
    streams = []
    k, low = 0, 0
    left = np.arange(len(h))
    while len(left):
        size = 1 if k == 0 else low
        streams.append((left, np.full(len(left), k), np.full(len(left), low, np.float64), np.full(len(left), size, np.float64)))
        low += size
        k += 1
        left = left[weight[left] > low]
    if not streams or not len(h):
        return marks.reshape(n_docs, registers)
    el, level, low_of, rate = (np.concatenate(x) for x in zip(*streams, strict=True))
    seed = mixed(h[el] + (level.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
    owner, top = doc[el], weight[el].astype(np.float64)
    clock = np.zeros(len(el))
    made, take = 0, 2
    while len(el):
        nth = np.arange(made + 1, made + take + 1, dtype=np.uint64)
        point = mixed(seed[:, None] + nth * GOLDEN)
        when = clock[:, None] + np.cumsum(-np.log(unit(point)), axis=1) / rate[:, None]
        extra = mixed(point ^ _U(0xA5A5A5A5A5A5A5A5))
        where = owner[:, None] * registers + (extra % _U(registers)).astype(np.int64)
        seen = low_of[:, None] + unit(mixed(extra + GOLDEN)) * rate[:, None] <= top[:, None]
        flat, t, ident = where[seen], when[seen], point[seen]
        np.minimum.at(times, flat, t)
        first = t == times[flat]
        marks[flat[first]] = ident[first]
        clock = when[:, -1]
        made, take = made + take, min(made + take, 64)
        on = clock < times.reshape(n_docs, registers).max(axis=1)[owner]
        el, seed, owner, top, clock, rate, low_of = (x[on] for x in (el, seed, owner, top, clock, rate, low_of))
    return marks.reshape(n_docs, registers)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mixed(out * GOLDEN + sig.reshape(len(sig), bands, rows)[:, :, r])
    return out.view(np.int64)


def copy_sets(texts: pa.Array | Sequence[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's shingles, where the second, third, ... copy of
    a shingle has a hash of its own: the Jaccard similarity of these sets is the
    weighted one of the multisets."""
    texts, out = as_strings(texts), []
    for start, end in blocks(texts, TEXT_BYTES):
        doc, h, n = counted(*shingles(texts.slice(start, end - start)))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = np.repeat(h, n)
        h = np.where(nth > 0, mixed(h + nth.astype(np.uint64) * GOLDEN), h)
        doc = np.repeat(doc, n)
        order = np.lexsort((h, doc))
        out += np.split(h[order], np.cumsum(np.bincount(doc, minlength=end - start))[:-1])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def sign(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, size, bands`` of each row ``id, text`` that has a word; ``size`` in bytes."""
    ids = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = as_strings(batch.column("text"))
            for start, end in blocks(said, TEXT_BYTES):
                doc, h, n = counted(*shingles(said.slice(start, end - start)))
                found = band_hashes(signatures(doc, h, n, end - start, bands * rows), bands, rows)
                has = np.unique(doc)
                values = pa.array(found[has].ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, bands), pa.int32()), values)
                mine = batch.slice(start, end - start).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([mine.column("id"), pc.binary_length(mine.column("text")).cast(pa.int64()), lists], names=["id", "size", "bands"])
        give_back()

    return texts.mapInArrow(run, f"id {ids}, size long, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose texts' multisets are at least ``least`` similar."""
    ids = dict(pairs.dtypes)["a"]
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                said = pa.concat_arrays([part.column("ta"), part.column("tb")]).dictionary_encode()
                sets, which = copy_sets(said.dictionary), said.indices.to_pylist()
                hit += [start + i for i in range(part.num_rows) if similarity(sets[which[i]], sets[which[part.num_rows + i]]) >= least]
            took = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(took), batch.column("b").take(took)], names=["a", "b"])
        give_back()

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, f"a {ids}, b {ids}")


def block_links(sets: list[np.ndarray], comps: list, least: float, first: int | None = None, columns: int = 4096) -> list[tuple[int, int]]:
    """Links that join all components with a pair of similar texts; at most one
    fewer than there are components. Of the texts, the ``first`` ones are compared with
    the others, or all with each other. Counts of common shingles come from products
    of sparse blocks of the incidence matrix."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    both = times[col] > 1
    row, col = row[both], np.unique(col[both], return_inverse=True)[1]
    top, low = (n, 0) if first is None else (first, first)
    common = np.zeros((top, n - low), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    for start in range(0, width, columns):
        a, b = np.searchsorted(col, [start, start + columns])
        part = np.zeros((n, min(columns, width - start)), np.float32)
        part[row[a:b], col[a:b] - start] = 1
        common += part[:top] @ part[low:].T
    root = {c: c for c in comps}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    union = sizes[:top, None] + sizes[None, low:] - common
    near = (common >= least * union - 1e-3) & (union > 0)
    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1) if first is None else near), strict=True):
        if common[i, j] / union[i, j] >= least and (a := find(comps[i])) != (b := find(comps[low + j])):
            root[a] = b
            links.append((int(i), int(low + j)))
    return links


def compare_blocks(rows: DataFrame, texts: DataFrame, least: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links between the components of large buckets: rows ``h, id, size, comp, main``,
    where ``main`` is the bucket's largest component. Its texts and the others are dealt
    by the hash of the id into slices of about ``block`` texts and at most about
    ``block_bytes``; each slice of the others meets itself, every later one and every one
    of ``main``, in one task's group."""
    ids = dict(rows.dtypes)["id"]
    inside = F.col("comp") == F.col("main")
    slices = lambda c: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / block), F.ceil(F.sum(F.when(c, F.col("size"))) / block_bytes)).cast("int")
    plan = stored(rows.groupBy("h").agg(slices(inside).alias("mains"), slices(~inside).alias("others")), "bucket-slices")
    rows = rows.join(broadcast_if_small(plan), "h")
    own = F.pmod(F.xxhash64("id", F.lit("slice")), F.when(inside, F.col("mains")).otherwise(F.col("others"))).cast("int")
    upto = lambda a, b: F.sequence(a, b - 1)
    zero = F.lit(0)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    as_main = F.transform(upto(zero, F.col("others")), lambda i: place(i, F.col("own"), F.lit(False)))
    as_left = F.transform(upto(zero, F.col("mains") + F.col("others") - F.col("own")), lambda j: place(F.col("own"), F.when(j < F.col("mains"), j).otherwise(j + F.col("own")), F.lit(True)))
    as_later = F.transform(F.filter(upto(zero, F.col("others")), lambda i: i < F.col("own")), lambda i: place(i, F.col("mains") + F.col("own"), F.lit(False)))
    dealt = rows.withColumn("own", own).select("h", "id", "comp", F.explode(F.when(inside, as_main).otherwise(F.concat(as_left, as_later))).alias("at"))
    dealt = dealt.select("h", "at.*", "id", "comp").join(texts.select("id", "text"), "id")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("left", "descending"), ("id", "ascending")])
        first = pc.sum(group.column("left")).as_py()
        sets = copy_sets(as_strings(group.column("text")))
        links = block_links(sets, group.column("comp").to_pylist(), least, first if first < len(sets) else None)
        a, b = ([x[k] for x in links] for k in (0, 1))
        del sets
        give_back()
        return pa.table({"a": group.column("id").take(pa.array(a, pa.int64())), "b": group.column("id").take(pa.array(b, pa.int64()))})

    return dealt.groupBy("h", "i", "j").applyInArrow(run, f"a {ids}, b {ids}")


def components(links: DataFrame, limit: int | None = None) -> DataFrame:
    """``id, comp`` for every id of ``links`` (``a, b``) that is not the smallest
    of its connected component; ``comp`` is the smallest."""
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "m").alias("m"), "n"), "edges-least")
        large = stored(_with_least(both.where("u > v"), least, limit).select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct(), "edges")
        drop(edges, least)
        least = stored(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), "edges-least")
        small = _with_least(large, least, limit)
        small = small.select("v", F.col("m").alias("u")).unionByName(small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        edges = stored(small, "edges")
        drop(large, least)
    return edges.select(F.col("v").alias("id"), F.col("u").alias("comp"))


def _with_least(edges: DataFrame, least: DataFrame, limit: int | None = None) -> DataFrame:
    """``v, u, m``. Where ``least`` (``v, m, n``) is too large to broadcast, nodes that
    have over one of ``HUB_SHARE`` of all ends, and so fewer than that many nodes, still
    are; the others have few rows in any task."""
    if row_bytes(least)[1] <= (8_000_000 if limit is None else limit):
        return edges.join(F.broadcast(least.select("v", "m")), "v")
    ends = least.agg(F.sum("n")).first()[0]
    hub = F.col("n") * HUB_SHARE > ends
    hubs = F.broadcast(least.where(hub).select("v", "m"))
    return edges.join(hubs, "v").unionByName(edges.join(hubs, "v", "left_anti").join(least.where(~hub).select("v", "m"), "v"))


def _stars(edges: DataFrame) -> bool:
    """Whether each ``v`` has one ``u`` only, and none is another edge's ``u``."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(texts: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, paired: int = PAIRED, block: int = BLOCK, lookup: DataFrame | None = None) -> DataFrame:
    """``id, comp`` of the rows ``id, text`` that are linked to a smaller id.
    Ids should be unique and not null. ``lookup``: a table ``id, text`` that is
    cheaper to scan and holds at least the rows of ``texts``."""
    sig = stored(sign(texts, bands, rows), "signatures")
    # Points belong to one register, so a hash belongs to one band.
    banded = sig.select("id", "size", F.explode("bands").alias("h"))
    at = F.struct(F.xxhash64("id", F.lit("pivot")), "id")
    pivots = F.array_distinct(F.array(F.min("id"), F.min(at)["id"], F.max(at)["id"])).alias("pivots")
    buckets = stored(banded.groupBy("h").agg(F.count(F.lit(1)).alias("n"), pivots).where("n > 1"), "buckets")
    shared = stored(banded.join(broadcast_if_small(buckets), "h"), "bucket-rows")
    drop(sig, buckets)
    ids = stored(shared.select("id").distinct(), "candidates")
    maybe = bit_filter(ids.select(F.col("id").alias("digest")), ids.count())
    texts = texts if lookup is None else lookup
    texts = maybe(texts.withColumn("digest", F.col("id"))).drop("digest").join(broadcast_if_small(ids), "id", "left_semi")
    texts = stored(texts, "candidate-texts")
    with_pivot = shared.select("id", F.explode("pivots").alias("p")).where("id <> p")
    tested = stored(with_pivot.select(*_ordered(F.col("id"), F.col("p"))).distinct(), "pairs")
    comp = stored(components(stored(compare(tested, texts, least), "links")), "components")
    now = shared.select("h", "id", "size", "n").join(broadcast_if_small(comp), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    now = stored(now, "bucket-components")
    parts = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = stored(parts.groupBy("h").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "open-buckets")
    rest = stored(now.join(broadcast_if_small(open_), "h"), "open-rows")
    few = rest.where(F.col("n") <= paired)
    other = few.select("h", F.col("id").alias("id2"), F.col("comp").alias("comp2"))
    pairs = few.join(other, "h").where("id < id2 and comp <> comp2").select(*_ordered(F.col("id"), F.col("id2"))).distinct()
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = stored(comp.select(F.col("id").alias("b"), F.col("comp").alias("a")).unionByName(compare(pairs, texts, least)), "links")
    many = rest.where(F.col("n") > paired)
    if not many.isEmpty():
        links = links.unionByName(stored(compare_blocks(many, texts, least, block), "links"))
    out = components(links)
    drop(shared, ids, texts, tested, comp, now, open_, rest, pairs)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs``; ``class_id`` is the smallest
    id of the class.

    Texts are linked if their multisets of five-word shingles have a weighted
    Jaccard similarity of at least 0.8 and share a band; a class is a connected
    component of links. A text with one to four words is one shingle. Texts equal
    but for white space are one class, and so are null and empty texts; texts
    without words are linked to nothing else. Rows with a null id are classes
    without links to other texts (``class_id`` is null or their copies' id). Rows
    with the same id share their links. Other columns are ignored. An empty table
    gives no rows.
    """
    copies = find_copies(docs, id_col, text_col)
    first = keep_first(docs, id_col, text_col, copies)
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    texts, every = (t.select(*columns).where("id is not null and text is not null") for t in (first, docs))
    linked = stored(classes(texts, lookup=every, **options), "classes").select(F.col("id").alias("keep_id"), "comp")
    return verdicts(copies).select("doc_id", "keep_id").join(broadcast_if_small(linked), "keep_id", "left").select("doc_id", F.coalesce("comp", "keep_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each class, with all columns of ``docs``, in which
    exact dedup has left one row of equal texts (other copies of a text with words are
    near copies like any).

    Nulls and ties count as in ``near_dedup``: rows with a null id or without words all
    stay. Rows with the same id stay or go together. Nothing of ``docs`` is overwritten
    by names that clash. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    linked = stored(classes(texts, **options), "classes")
    (gone,) = fresh(docs, "gone")
    linked = broadcast_if_small(linked.select(F.col("id").alias(gone)))
    return docs.join(linked, docs[id_col] == F.col(gone), "left_anti").select(*columns_of(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_dedup(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op10_near_dedup": op10_near_dedup}
