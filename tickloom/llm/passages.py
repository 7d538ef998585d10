"""Substring dedup: passages of words that documents share, exactly or nearly.

1. Seeds: of all five-word windows of a text, those whose hash is the least of 16
   neighbouring ones, so that any 20 equal words hold a seed in both texts, and a
   quarter of the others by their hash alone, which edits beside them leave as it is:
   two texts that have k windows in common share none of these with probability
   0.75 ** k.
2. A seed's documents are joined with the smallest document that has it, its
   pivot; a seed in n documents gives n - 1 pairs. Pairs go on whose seeds are two
   windows at least: 50 equal words have 15 on average, and 40 of 50 words with edits
   between them about four.
3. Partners of a pivot are dealt into blocks, and each block meets its pivot's text
   once; the texts of many blocks are hashed and matched together. There the longest runs of five or more equal words, from every place of the
   text to every place of the pivot, are segments. They are found by their first and
   last windows, beside which the words differ, and so one by one even in repeated
   lines. Segments are chained in order: a chain's score is its matched words less a
   cost for gaps on both sides, and a Fenwick tree holds the best score up to each
   place of the pivot. A segment may give up its first words to follow another.
4. Chains are aligned: the words in gaps by their longest common subsequence. Chains
   that are long and similar enough are passages. Of other chains, the parts that are
   so are passages.
5. A document whose seeds all have pivots that hold parts of a passage only meets no
   document with the whole. So seeds that are in no passage yet join their documents
   once more, each with the one before it by id.
6. Equal windows of 50 words that are in no passage found with pivots are grouped as
   they are, and the documents of each are compared with the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, give_back, read, stored
from .exact_dedup import MAX_FILTER_BITS, bit_filter
from .words import GOLDEN, as_strings, blocks, mixed, window_hashes, word_hashes

SEED_WORDS = 5
SEED_WINDOW = 16
#: One of so many windows is a seed whatever is beside it.
SEED_SHARE = 4
#: Windows that are seeds in common with a pivot, so that the two texts are compared.
SEEDS_IN_COMMON = 2
MATCH_WORDS = 5
MIN_WORDS = 50
MIN_SIMILARITY = 0.8
GAP_COST = 0.25
#: Partners of a pivot in one block, and pairs about that are compared in one group.
PARTNERS = 128
PAIRS = 64
#: Bytes of text that are hashed together.
BLOCK_BYTES = 1_000_000


def _rolling(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each element and the ``width - 1`` after it."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.append(best(x[:-step], x[step:]), x[len(x) - step :])
        have += step
    return x


def seeds(texts: pa.Array | Sequence[str | None], width: int = SEED_WORDS, window: int = SEED_WINDOW, done: list[list[dict] | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of the distinct seeds of each text, and how many of its windows they
    are. Windows that lie in one of the passages ``done`` of the text are left out."""
    doc, start, h = window_hashes(*word_hashes(texts), width)
    if not len(h):
        return doc, h, doc
    h = h >> np.uint64(1)
    top = np.uint64(2**64 - 1)
    at = np.arange(len(h)) + (doc + 1) * window
    spaced = np.full(int(at[-1]) + 1 + window, top)
    spaced[at] = h
    least = _rolling(spaced, window, np.minimum)
    least[least == top] = 0
    reached = _rolling(least[::-1], window, np.maximum)[::-1]
    pick = np.flatnonzero((reached[at] == h) | (mixed(h) % np.uint64(SEED_SHARE) == 0))
    if done is not None:
        first = np.searchsorted(doc, np.arange(len(done) + 1))
        closed = np.zeros(len(h) + 1, np.int64)
        for t, ranges in enumerate(done):
            for r in ranges or ():
                if r["end_word"] - r["start_word"] >= width:
                    closed[first[t] + r["start_word"]] += 1
                    closed[first[t] + r["end_word"] - width + 1] -= 1
        pick = pick[np.cumsum(closed)[pick] == 0]
    doc, h = doc[pick], h[pick]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new], np.diff(np.append(np.flatnonzero(new), len(h)))


#: start in the document, start in the pivot, words
Segment = tuple[int, int, int]


def chain(segments: list[Segment], gap_cost: float = GAP_COST, origin: list[int] | None = None) -> list[list[Segment]]:
    """Disjoint chains of segments that follow each other in both texts, best
    first. A segment scores its words; a step costs ``gap_cost`` for each word
    between, in either text. Of segments with the same ``origin``, one is used."""
    if not segments:
        return []
    at = np.array(segments, np.int64)
    order = np.lexsort(at.T[::-1])
    at = at[order]
    i, j, n = at.T
    end, end_p = i + n, j + n
    # Before a segment, those go into the Fenwick tree that end at its start or sooner.
    waiting = np.argsort(end, kind="stable")
    until = np.searchsorted(end[waiting], i, side="right").tolist()
    places = np.unique(end_p)
    put, upto = (np.searchsorted(places, end_p) + 1).tolist(), np.searchsorted(places, j, side="right").tolist()
    paid, cost = (gap_cost * (end + end_p)).tolist(), (gap_cost * (i + j)).tolist()
    waiting, score, back, ready = waiting.tolist(), n.astype(float).tolist(), [-1] * len(at), 0
    # The largest value, and its segment, over ranges of places.
    value, item = [-1e18] * (len(places) + 1), [-1] * (len(places) + 1)
    for k, have in enumerate(until):
        for w in waiting[ready:have]:
            v, f = score[w] + paid[w], put[w]
            while f < len(value):
                if value[f] < v:
                    value[f], item[f] = v, w
                f += f & -f
        ready, best, before, f = have, -1e18, -1, upto[k]
        while f:
            if best < value[f]:
                best, before = value[f], item[f]
            f &= f - 1
        best -= cost[k]
        if best > 0:
            score[k], back[k] = score[k] + best, before
    origin = np.unique(np.array(origin)[order], return_inverse=True)[1].tolist() if origin else range(len(at))
    segments = segments_of(i, j, n)
    used, out = bytearray(len(at)), []
    for k in np.argsort(-np.array(score), kind="stable").tolist():
        own = []
        while k >= 0 and not used[origin[k]]:
            used[origin[k]] = 1
            own.append(segments[k])
            k = back[k]
        if own:
            out.append(own[::-1])
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by whole rows of bits."""
    where: dict[int, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    ones = (1 << len(b)) - 1
    row = ones
    for w in a:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & ones
    return len(b) - row.bit_count()


def parts(own: list[Segment], a: np.ndarray, b: np.ndarray, min_words: int, least: float) -> list[tuple[int, int, int, int, int]]:
    """Start and end in the document and in the pivot, and words in common, of the
    parts of a chain that are passages: the whole if it is one, else disjoint runs of
    its segments with the most words in common, as few as have them."""
    if own[-1][0] + own[-1][2] - own[0][0] < min_words:
        return []
    if len(own) == 1:
        ((i, j, n),) = own
        return [(i, i + n, j, j + n, n)]
    i, j, n = np.array(own).T
    room = np.minimum(i[1:] - i[:-1] - n[:-1], j[1:] - j[:-1] - n[:-1])
    if n.sum() + room.sum() < least * min_words:
        return []
    gaps = [common_words(a[x + m : y].tolist(), b[z + m : w].tolist()) for x, y, z, w, m in zip(i[:-1], i[1:], j[:-1], j[1:], n[:-1], strict=True)]
    # Words in common before each segment, the gap before it included.
    before = np.append(0, np.cumsum(n[:-1] + np.array(gaps, np.int64)))
    end, end_p = i + n, j + n
    best, back = np.zeros(len(own) + 1, np.int64), [-1] * (len(own) + 1)
    whole = _passes(before[-1] + n[-1], end[-1] - i[0], end_p[-1] - j[0], min_words, least)
    for k in range(len(own) - 1 if whole else 0, len(own)):
        matched = before[k] + n[k] - before[: k + 1]
        fits = np.flatnonzero(_passes(matched, end[k] - i[: k + 1], end_p[k] - j[: k + 1], min_words, least))
        best[k + 1] = best[k]
        if len(fits):
            total = matched[fits] + best[fits]
            at = int(total.argmax())
            if total[at] > best[k]:
                best[k + 1], back[k + 1] = total[at], int(fits[at])
    out, k = [], len(own)
    while k > 0:
        if (f := back[k]) < 0:
            k -= 1
            continue
        out.append((int(i[f]), int(end[k - 1]), int(j[f]), int(end_p[k - 1]), int(before[k - 1] + n[k - 1] - before[f])))
        k = f
    return out[::-1]


def _passes(matched, words, words_p, min_words: int, least: float):
    return (words >= min_words) & (matched >= least * np.maximum(words, words_p))


def segments_of(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> list[Segment]:
    return list(zip(i.tolist(), j.tolist(), n.tolist(), strict=True))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place of every element of ranges."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def unlike_beside(h: np.ndarray, side: np.ndarray, h_p: np.ndarray, side_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of equal windows ``h`` and ``h_p`` whose words ``side``
    and ``side_p`` differ."""
    order = np.lexsort((side_p, h_p))
    hs, ss = h_p[order], side_p[order]
    known, first, count = np.unique(hs, return_index=True, return_counts=True)
    where = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[where] == h)
    first, last = first[where[hit]], (first + count)[where[hit]]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    begin = np.flatnonzero(new)
    ends = np.append(begin[1:], len(hs))
    keys = mixed(hs[begin] * GOLDEN + ss[begin])
    by_key = np.argsort(keys)
    mine = mixed(h[hit] * GOLDEN + side[hit])
    group = by_key[np.minimum(np.searchsorted(keys, mine, sorter=by_key), len(keys) - 1)]
    same = keys[group] == mine
    # All places of the window but those in a row that have the same word beside it.
    low, high = np.where(same, begin[group], first), np.where(same, ends[group], first)
    owner, at = _ranges(np.concatenate((first, high)), np.concatenate((low - first, last - high)))
    return np.concatenate((hit, hit))[owner], order[at]


def maximal_runs(sizes: np.ndarray, words: np.ndarray, words_p: np.ndarray, width: int, total: float = 0, sizes_p: np.ndarray | None = None, pivot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it and in its pivot, and words of all runs of ``width`` or more
    equal words that can be extended on neither side. Texts may be left out whose
    runs have fewer than ``total`` words. ``words_p`` are one pivot's, or of ``sizes_p``
    each; then ``pivot`` has the number of each text's."""
    sizes_p = np.array([len(words_p)]) if sizes_p is None else sizes_p
    pivot = np.zeros(len(sizes), np.int64) if pivot is None else pivot
    doc, at, h = window_hashes(sizes, words, width)
    doc_p, at_p, h_p = window_hashes(sizes_p, words_p, width)
    none = np.zeros(0, np.int64)
    if not len(h_p) or not len(h):
        return none, none, none, none
    if len(sizes_p) > 1:  # a window is equal to those of its own pivot alone
        salt = mixed(np.arange(1, len(sizes_p) + 1, dtype=np.uint64) * GOLDEN)
        h, h_p = h ^ salt[pivot[doc]], h_p ^ salt[doc_p]
    hit = _among(h, h_p)
    # A run has at most ``width`` words for each of its windows, in one place of the pivot.
    doc, at, h = doc[hit], at[hit], h[hit]
    few = np.bincount(doc, minlength=len(sizes)) * width < total
    doc, at, h = (x[~few[doc]] for x in (doc, at, h))
    if not len(h):
        return none, none, none, none
    hit = _among(h_p, h)
    doc_p, at_p, h_p = doc_p[hit], at_p[hit], h_p[hit]
    flat = (np.cumsum(sizes) - sizes)[doc] + at
    flat_p = (np.cumsum(sizes_p) - sizes_p)[doc_p] + at_p
    edges = []
    for step, inside, inside_p in ((-1, at > 0, at_p > 0), (width, at + width < sizes[doc], at_p + width < sizes_p[doc_p])):
        # The end of a text is like no word, nor like the end of the other.
        side, side_p = np.zeros(len(h), np.uint64), np.ones(len(h_p), np.uint64)
        side[inside], side_p[inside_p] = words[flat[inside] + step], words_p[flat_p[inside_p] + step]
        k, q = unlike_beside(h, side, h_p, side_p)
        order = np.lexsort((at[k], at_p[q] - at[k], doc[k]))
        edges.append((k[order], q[order]))
    # The starts and ends of runs alternate on each diagonal of each text.
    (k, q), (last, _) = edges
    return doc[k], at[k], at_p[q], at[last] - at[k] + width


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that are among the known ones, and of very few others: by a
    bitmap of their first bits, and one of their last."""
    bits = max(12, min(22, (16 * len(known)).bit_length()))
    shift, mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
    marked = np.zeros(1 << bits, bool)
    marked[known >> shift] = True
    hit = np.flatnonzero(marked[h >> shift])
    marked[:] = False
    marked[known & mask] = True
    return hit[marked[h[hit] & mask]]


def shortened(doc: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, pairs: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Number of a segment, and words that it gives up at its start so that it can
    follow another one that ends inside it; each segment as it is (0 words) too."""
    out = [(np.arange(len(n)), np.zeros(len(n), np.int64))]
    apart = doc * (int(max((i + n).max(), (j + n).max())) + 1 if len(n) else 1)
    for start in (i, j):
        low, end = apart + start, apart + start + n
        by_end = np.argsort(end)
        first = np.searchsorted(end[by_end], low, side="right")
        sizes = np.searchsorted(end[by_end], low + n, side="left") - first
        block = np.cumsum(sizes) // pairs
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
            owner, at = _ranges(first[cut], sizes[cut])
            k, q = cut[owner], by_end[at]
            over = np.maximum(i[q] + n[q] - i[k], j[q] + n[q] - j[k])
            fits = (i[q] < i[k]) & (j[q] < j[k]) & (over < n[k])
            out.append((k[fits], over[fits]))
    k, over = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((over, k))
    k, over = k[order], over[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (over[1:] != over[:-1])
    return k[new], over[new]


def covering(found: list[tuple[int, int, int, int, int]], size: int) -> list[tuple[int, int, int, int, int]]:
    """Of passages of one text, those that hold words in no better one: first the
    ones apart from all better ones, then the ones that add most to these."""
    if len(found) < 2:
        return found
    covered, out, later = np.zeros(size, bool), [], []
    for f in sorted(found, key=lambda f: (-f[4], f)):
        if covered[f[0] : f[1]].any():
            later.append(f)
        else:
            covered[f[0] : f[1]] = True
            out.append(f)
    for f in sorted(later, key=lambda f: int(covered[f[0] : f[1]].sum()) - f[1] + f[0]):
        if not covered[f[0] : f[1]].all():
            covered[f[0] : f[1]] = True
            out.append(f)
    return sorted(out)


def passages(pivot: str, texts: pa.Array | Sequence[str], min_words: int = MIN_WORDS, least: float = MIN_SIMILARITY, width: int = MATCH_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """Text number, start, end, start and end in the pivot, words in common. Runs of
    equal words are matched at every place of the pivot."""
    return passages_of([pivot], texts, np.zeros(len(texts), np.int64), min_words, least, width)


def passages_of(pivots: pa.Array | Sequence[str], texts: pa.Array | Sequence[str], pivot: np.ndarray, min_words: int = MIN_WORDS, least: float = MIN_SIMILARITY, width: int = MATCH_WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """As ``passages``, of texts that have a pivot each, by its number. All are hashed and
    matched together; only texts with enough equal words are chained one by one."""
    sizes_p, words_p = word_hashes(pivots)
    sizes, words = word_hashes(texts)
    doc, at, other, runs = maximal_runs(sizes, words, words_p, width, min_words * least, sizes_p, pivot)
    total = np.bincount(doc, weights=runs, minlength=len(texts))
    enough = total[doc] >= min_words * least
    doc, at, other, runs = doc[enough], at[enough], other[enough], runs[enough]
    k, over = shortened(doc, at, other, runs)
    doc, at, other, runs = doc[k], at[k] + over, other[k] + over, runs[k] - over
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    starts, starts_p = np.cumsum(sizes) - sizes, np.cumsum(sizes_p) - sizes_p
    out = []
    for t in np.unique(doc):
        a, b = bounds[t], bounds[t + 1]
        p = pivot[t]
        own_words, own_words_p = words[starts[t] : starts[t] + sizes[t]], words_p[starts_p[p] : starts_p[p] + sizes_p[p]]
        found = []
        for own in chain(segments_of(at[a:b], other[a:b], runs[a:b]), origin=k[a:b].tolist()) if b - a > 1 else [segments_of(at[a:b], other[a:b], runs[a:b])]:
            if own[-1][0] + own[-1][2] - own[0][0] >= min_words:
                found += parts(own, own_words, own_words_p, min_words, least)
        out += [(int(t), *f) for f in covering(found, int(sizes[t]))]
    return out


def rolling_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` words in a row, in the same time for any width."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.append(np.uint64(1), np.full(len(h), GOLDEN)))
    inverse = np.uint64(pow(int(GOLDEN), -1, 2**64))
    sums = np.append(np.uint64(0), np.cumsum(mixed(h) * power[:-1]))
    shift = np.cumprod(np.append(np.uint64(1), np.full(len(h) - width, inverse)))
    return mixed((sums[width:] - sums[:-width]) * shift)


def open_windows(texts: pa.Array | Sequence[str | None], done: list[list[dict] | None], n: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, part and hash of each ``n`` words in a row that are not all in one of the
    passages ``done``. The part is the hash of somewhat more than half of these words:
    those up to or from their least seed window. Equal words have equal parts, and
    there are few parts in a text."""
    sizes, words = word_hashes(texts)
    width = min(SEED_WORDS, n)
    inner = n - width + 1
    if len(words) < n:
        return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    closed = np.zeros(len(words) + 1, np.int64)
    for t, ranges in enumerate(done):
        for r in ranges or ():
            if r["end_word"] - r["start_word"] >= n:
                closed[starts[t] + r["start_word"]] += 1
                closed[starts[t] + r["end_word"] - n + 1] -= 1
    at = np.flatnonzero((doc[: len(words) - n + 1] == doc[n - 1 :]) & (np.cumsum(closed)[: len(words) - n + 1] == 0))
    h = rolling_hashes(words, width)
    place = _rolling(np.arange(len(h)), inner, lambda i, j: np.where(h[i] <= h[j], i, j))[at] - at
    half = inner // 2
    part = rolling_hashes(words, half + width)[at + np.where(place >= half, place - half, place)]
    return doc[at], part, rolling_hashes(words, n)[at]


def open_table(docs: DataFrame, n: int, parts: bool) -> DataFrame:
    """``id, digest`` of the distinct parts of ``open_windows`` of the rows ``id, text,
    done``, or of the windows whose part is in ``kept``."""
    ids = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = as_strings(batch.column("text")), batch.column("done").to_pylist()
            for start, end in blocks(texts, BLOCK_BYTES):
                doc, part, h = open_windows(texts.slice(start, end - start), done[start:end], n)
                if parts:
                    h = part
                else:
                    kept = [np.array(k, np.int64).astype(np.uint64) for k in batch.column("kept").slice(start, end - start).to_pylist()]
                    bounds = np.searchsorted(doc, np.arange(end - start + 1))
                    keep = np.concatenate([np.isin(part[a:b], k) for a, b, k in zip(bounds, bounds[1:], kept, strict=False)])
                    doc, h = doc[keep], h[keep]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc[new] + start)), pa.array(h[new].astype(np.int64))], names=["id", "digest"])
        give_back()

    return docs.mapInArrow(run, f"id {ids}, digest long")


def open_pairs(rows: DataFrame, found: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """``pivot, id`` of documents that have ``min_words`` words in a row in common,
    which are in no passage of either, and were not compared in ``pairs``. A document
    may meet the pivots of its seeds in vain, since they hold stock phrases only.

    Windows of so many words are grouped as they are, those only whose part another
    document has too, so that a pair is made for a true passage only.
    """
    docs = with_done(rows, found)
    table = stored(open_table(docs, min_words, True), "open-parts")
    several = stored(table.groupBy("digest").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("digest"), "open-shared")
    maybe = bit_filter(several, several.count())
    kept = maybe(table).join(broadcast_if_small(several), "digest").groupBy("id").agg(F.collect_set("digest").alias("kept"))
    kept = stored(kept, "open-kept")
    windows = stored(open_table(docs.join(broadcast_if_small(kept), "id"), min_words, False), "open-windows")
    pivots = windows.groupBy("digest").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top").drop("top")
    more = windows.join(stored(pivots, "open-pivots"), "digest").where("id <> pivot").select("pivot", "id").distinct()
    return stored(more.join(pairs, ["pivot", "id"], "left_anti"), "open-pairs")


def some_of(rows: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """The rows of these ``id``s, and a few others by chance where a bitmap of the ids can be
    broadcast, so that texts are not shuffled for it."""
    ids = stored(ids.select(F.xxhash64("id").alias("digest")), tag)
    return bit_filter(ids, ids.count())(rows.withColumn("digest", F.xxhash64("id"))).drop("digest")


def with_done(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``done``, the places of the passages found in the document."""
    done = found.select(F.col("doc_id").alias("id"), F.struct("start_word", "end_word").alias("r")).groupBy("id").agg(F.collect_list("r").alias("done"))
    # A row of an id that has several texts does not say whose words it means.
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    done = stored(done.join(twice, "id", "left_anti"), "passages-done")
    return rows.join(broadcast_if_small(done), "id", "left")


def next_pairs(rows: DataFrame, found: DataFrame, pairs: DataFrame, repeated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pivot, id`` of documents that are neighbours, by id, among those that have a seed
    in no passage found so far. The smallest document of a seed may hold a part of a passage
    only that others hold whole; these then meet each other. A seed in n documents
    gives n - 1 pairs. ``repeated`` gives the seeds that more than one row has."""
    left = stored(repeated(with_done(rows, found)), "open-seeds")
    met = neighbours(left).groupBy("pivot", "id").agg(F.sum("n").alias("n"))
    out = stored(met.where(F.col("n") >= SEEDS_IN_COMMON).select("pivot", "id").join(pairs, ["pivot", "id"], "left_anti"), "next-pairs")
    drop(left)
    return out


def neighbours(table: DataFrame) -> DataFrame:
    """``pivot, id, n`` of each document of a digest and the one before it by id, from
    stored rows ``id, digest, n``; ``n`` is the smaller of theirs.

    Rows are dealt by ranges of digest and id and sorted in them, so a digest that very many
    documents have is spread like all others. The last document of a range meets the
    first of the next one: one row a task has both."""
    ids = dict(table.dtypes)["id"]
    dealt = table.select("digest", "id", "n").repartitionByRange("digest", "id").sortWithinPartitions("digest", "id")

    def rows(t: pa.Table, pivot: np.ndarray, at: np.ndarray, part: int | None = None) -> pa.RecordBatch:
        n = t.column("n").to_numpy()
        many = [pa.array(np.minimum(n[pivot], n[at])), t.column("digest").combine_chunks().take(pa.array(at)), pa.array([part] * len(at), pa.int32())]
        key = t.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([key.take(pa.array(pivot)), key.take(pa.array(at)), *many], names=["pivot", "id", "n", "digest", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if not t.num_rows:
                continue
            digest = t.column("digest").to_numpy()
            key = t.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.append(True, (digest[1:] != digest[:-1]) | (key[1:] != key[:-1])))
            n = np.add.reduceat(t.column("n").to_numpy(), begin)
            t = t.take(pa.array(begin)).set_column(2, "n", pa.array(n, pa.int64()))
            # The last document may go on in the next batch; it and the one before it are held.
            digest, last = digest[begin], len(begin) - 1
            at = np.flatnonzero(digest[1:last] == digest[: max(0, last - 1)])
            yield rows(t, at, at + 1)
            first = t.slice(0, 1) if first is None and last else first
            held = t.slice(max(0, last - 1))
        if held is not None:
            digest, last = held.column("digest").to_numpy(), np.array([held.num_rows - 1])
            at = np.flatnonzero(digest[1:] == digest[:-1])
            yield rows(held, at, at + 1)
            part = TaskContext.get().partitionId()
            for t, k in ((held.slice(0, 1) if first is None else first, np.array([0])), (held, last)):
                yield rows(t, k, k, part)

    met = stored(dealt.mapInArrow(run, f"pivot {ids}, id {ids}, n long, digest long, part int"), "seed-neighbours")
    ends: dict[int, list] = {}
    for r in met.where("part is not null").collect():  # two rows a task
        ends.setdefault(r["part"], []).append(r)
    across, before = [], None
    for _, own in sorted(ends.items()):
        low, high = sorted(own, key=lambda r: (r["digest"], r["id"]))
        if before and before["digest"] == low["digest"]:
            across.append((before["id"], low["id"], min(before["n"], low["n"])))
        before = high
    whole = met.where("part is null").select("pivot", "id", "n")
    if not across:
        return whole
    more = pa.table(dict(zip(("pivot", "id", "n"), map(list, zip(*across, strict=True)), strict=True)))
    return whole.unionByName(met.sparkSession.createDataFrame(more).select(*[F.col(c).cast(t) for c, t in whole.dtypes]))


def seed_table(docs: DataFrame, marks: Broadcast | None = None) -> DataFrame:
    """``id, digest, n`` of all seeds of the rows ``id, text``; ``n`` windows of the text
    are the seed. With a column ``done``, of those outside these passages; with the bitmap
    ``marks``, of those that it has."""
    ids, rest = dict(docs.dtypes)["id"], "done" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marks is None else np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            texts = as_strings(batch.column("text"))
            for start, end in blocks(texts, BLOCK_BYTES):
                done = batch.column("done").slice(start, end - start).to_pylist() if rest else None
                doc, h, n = seeds(texts.slice(start, end - start), done=done)
                if bits is not None:
                    place = h & np.uint64(8 * len(bits) - 1)
                    have = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    doc, h, n = doc[have], h[have], n[have]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc + start)), pa.array(h.astype(np.int64)), pa.array(n, pa.int64())], names=["id", "digest", "n"])
        give_back()

    return docs.mapInArrow(run, f"id {ids}, digest long, n long")


def seed_marks(digests: DataFrame) -> Broadcast | None:
    """A bitmap of the last bits of digests, of 16 MB at most; None if it would be larger."""
    bits = 1 << max(15, (16 * digests.count() - 1).bit_length())
    if bits > 2**MAX_FILTER_BITS:
        return None
    place = F.col("digest").bitwiseAND(bits - 1) + 1
    parts = digests.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = bytearray(bits // 8)
    for r in parts.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bitmap"]
    return digests.sparkSession.sparkContext.broadcast(bytes(out))


def repeated_seeds(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``id, digest, n`` of the seeds that several rows have, and of a few others by chance; and
    a function that gives these of other rows. Of most seeds, which one row has only, no more than
    the digest is shuffled: a bitmap drops them where they are made. (A filter and then a semi-join
    do not: Spark moves the semi-join below the filter.)"""
    several = seed_table(docs).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    several = stored(several, "seeds-repeated")
    marks = seed_marks(several)

    def some(rows: DataFrame) -> DataFrame:
        return seed_table(rows, marks) if marks is not None else seed_table(rows).join(several, "digest", "left_semi")

    return stored(some(docs), "seeds"), some


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, least: float = MIN_SIMILARITY, partners: int = PARTNERS) -> DataFrame:
    """``doc_id, start_word, end_word, other_id, other_start, other_end, words``:
    one row for each passage that a document shares with a pivot, a document with a
    smaller id, but for those inside a passage that it shares with a still smaller one; ``words`` of them are in common. The pivot's passage is the one to
    keep, the document's the one to cut.

    Null and short texts share nothing. Rows with a null id are left out. Of rows
    with the same id, each is compared with other ids only. Passages repeated inside
    one document are not its subject. Other columns are ignored. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    table, repeated = repeated_seeds(rows)
    least_of = F.min(F.struct("id", "n"))
    pivots = table.groupBy("digest").agg(least_of["id"].alias("pivot"), least_of["n"].alias("pivot_n"), F.max("id").alias("top"))
    pivots = stored(pivots.where("pivot <> top").drop("top"), "seed-pivots")
    met = table.join(broadcast_if_small(pivots), "digest").where("id <> pivot").groupBy("pivot", "id").agg(F.sum(F.least("n", "pivot_n")).alias("n"))
    pairs = stored(met.where(F.col("n") >= SEEDS_IN_COMMON).select("pivot", "id"), "seed-pairs")
    # Any 20 equal words hold a seed: documents without a repeated one share no passage.
    rows = some_of(rows, table.select("id").distinct(), "seed-holders")
    drop(table, pivots)
    found = compared(rows, pairs, min_words, least, partners)
    beside = next_pairs(rows, found, pairs, repeated)
    more = open_pairs(rows, found, pairs.unionByName(beside), min_words)
    beside = stored(beside.unionByName(more), "open-both")
    return by_smallest(stored(found.unionByName(compared(rows, beside, min_words, least, partners)), "passages"))


def by_smallest(found: DataFrame) -> DataFrame:
    """Without passages that lie in one that the document shares with a smaller document:
    seeds at the ends of a passage depend on the words beside it, so that a document can
    meet several that hold the same passage."""
    other = found.select(F.col("doc_id").alias("doc2"), F.col("other_id").alias("other2"), F.col("start_word").alias("start2"), F.col("end_word").alias("end2"))
    inside = (F.col("other2") < F.col("other_id")) & (F.col("start2") <= F.col("start_word")) & (F.col("end2") >= F.col("end_word"))
    return found.join(other, (F.col("doc_id") == F.col("doc2")) & inside, "left_anti")


def compared(rows: DataFrame, pairs: DataFrame, min_words: int, least: float, partners: int) -> DataFrame:
    """The passages that documents share with their pivots, by stored ``pivot, id``; stored."""
    ids = dict(rows.dtypes)["id"]
    dealt = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / partners).cast("int").alias("blocks"))
    dealt = stored(dealt, "pivot-blocks")
    needed = pairs.select("id").unionByName(dealt.select(F.col("pivot").alias("id"))).distinct()
    texts = stored(some_of(rows, needed, "passage-ids"), "passage-texts")
    few = broadcast_if_small(dealt)
    left = pairs.join(few, "pivot").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))
    # Groups cost far more than their bytes say, so adaptive plans should not merge them.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = -(-pairs.count() // PAIRS)
    bucket = F.pmod(F.xxhash64("pivot", "block"), F.lit(max(1, buckets))).alias("bucket")
    right = dealt.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("id"))
    # Whatever it is there for, a text is joined once, and goes to a bucket once.
    asked = left.select(bucket, "pivot", "id").unionByName(right.select(bucket, "pivot", "id")).groupBy("bucket", "id").agg(F.collect_set("pivot").alias("pivots"))
    dealt_texts = asked.join(texts, "id").select("bucket", "id", "text", "pivots").repartition(tasks, "bucket")
    kind = f"doc_id {ids}, start_word long, end_word long, other_id {ids}, other_start long, other_end long, words long"

    def run(t: pa.Table) -> pa.Table:
        lists = t.column("pivots").combine_chunks()
        own, pivot = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        keys = pa.concat_arrays([t.column("id").combine_chunks(), pivot]).dictionary_encode().indices.to_numpy()
        ids_at, pivot_at = keys[: t.num_rows], keys[t.num_rows :]
        # A text that asks for itself is a pivot; each of the others meets each text of its pivot.
        is_pivot = ids_at[own] == pivot_at
        said = pa.table({"key": ids_at[own[is_pivot]], "text": t.column("text").take(pa.array(own[is_pivot]))})
        said = said.group_by(["key", "text"]).aggregate([]).sort_by("key")
        pair = np.flatnonzero(~is_pivot)
        pair = pair[np.lexsort((ids_at[own[pair]], pivot_at[pair]))]
        low, high = (np.searchsorted(said.column("key").to_numpy(), pivot_at[pair], side=side) for side in ("left", "right"))
        row, at = _ranges(low, high - low)
        row = pair[row]
        every, others = as_strings(t.column("text").take(pa.array(own[row]))), as_strings(said.column("text"))
        found = []
        for start, end in blocks(every, BLOCK_BYTES):
            some, which = np.unique(at[start:end], return_inverse=True)
            found += [(int(row[start + t]), *rest) for t, *rest in passages_of(as_strings(others.take(pa.array(some))), every.slice(start, end - start), which, min_words, least)]
        give_back()
        cols = list(zip(*found, strict=True)) or [()] * 6
        long = [pa.array(c, pa.int64()) for c in cols]
        return pa.table({
            "doc_id": t.column("id").take(pa.array(own[np.array(cols[0], np.int64)])),
            "start_word": long[1],
            "end_word": long[2],
            "other_id": pivot.take(long[0]),
            "other_start": long[3],
            "other_end": long[4],
            "words": long[5],
        })

    out = stored(dealt_texts.groupBy("bucket").applyInArrow(run, kind), "passages-found")
    drop(texts, dealt)
    return out


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared passages of at least 50 words of all documents."""
    return shared_passages(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_passages": op6_passages}
