"""Language identification by cross-parsing entropy.

A suffix automaton of a sample of labelled texts is built per language. A text is
parsed greedily into the longest phrases that occur in a language's sample; the
language that needs the fewest phrases, normalised by the sample's length, wins. Every
letter of any sample has a code of its own, so scripts do not compete for places. The
transitions of an automaton lie in a plain table, or in one with two places for each, so
that its size grows with the sample and not with the alphabet.

All texts of a batch are walked in lock step, long ones in lanes. A lane starts in the
state that some letters before it lead to, and is walked again from the state in which
the lane before it really ends where that is another one, until all agree: the phrases
are those of the whole text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, give_back, read, stored
from .words import as_strings, blocks

#: Bounds of the training sample, in characters: of a language, of all languages, and of
#: a window, the unit that is sampled. A language has ``LEAST`` at least, however many
#: there are: a model of 7,000 languages takes about 150 MB.
CHARS_PER_LANG = 49_152
SAMPLE_CHARS = 1_000_000
WINDOW = 4096
LEAST = 256
#: Largest automaton that is a plain table of states and letters, and all of a model.
TABLE_BYTES = 16_000_000
TABLES_BYTES = 128_000_000
#: Most letters for which each automaton has a table of its first steps.
ROOT_LETTERS = 4096
#: Letters of a lane, and letters before it that lead to its first state.
LANE = 512
WARM_UP = 48
BLOCK_BYTES = 1_000_000
UNKNOWN = "und"
#: A text is in no known language if its phrases have fewer letters on average, when so
#: many letters are added to its own: few letters say little.
MIN_PHRASE = 2
MORE_LETTERS = 20


def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a table of ``size``, a power of two."""
    shift = np.uint64(64 - size.bit_length() + 1)
    x = keys.astype(np.uint64)
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> shift, (x * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift


@dataclass(frozen=True)
class Automaton:
    """State 0 is the root, where nothing leads; ``root`` has its transitions by letter,
    if there are few letters.
    ``table`` has the next state of each state and letter, at ``state * width + letter``,
    where that is small. Else ``entries`` has ``state * width + letter`` and the next
    state, in the upper and lower half of a number, at one of two places."""

    width: int
    root: np.ndarray | None
    table: np.ndarray | None
    entries: np.ndarray | None

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + code
        if self.table is not None:
            return self.table[key]
        one, two = places(key, len(self.entries))
        got = self.entries[one]
        rest = np.flatnonzero(got >> 32 != key)
        got[rest] = self.entries[two[rest]]
        return np.where(got >> 32 == key, got & 0xFFFFFFFF, 0).astype(np.int32)

    def begin(self, code: np.ndarray) -> np.ndarray:
        return self.step(np.zeros(len(code), np.int32), code) if self.root is None else self.root[code]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.root, self.table, self.entries) if x is not None)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    letters: str
    automata: list[Automaton]
    bits: list[float]

    def nbytes(self) -> int:
        return sum(a.nbytes() for a in self.automata)


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions, by state."""
    link, length, nexts = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def automaton(codes: list[int], width: int, table_bytes: int = TABLE_BYTES) -> Automaton:
    """Codes are below ``width``. Each transition goes to its first place, and one that
    is there already to its other one, and so on until all have a place."""
    nexts = transitions(codes)
    root = np.zeros(width, np.int32) if width <= ROOT_LETTERS else None
    for c, t in nexts[0].items() if root is not None else ():
        root[c] = t
    keys = np.fromiter((s * width + c for s, out in enumerate(nexts) for c in out), np.int64)
    to = np.fromiter((t for out in nexts for t in out.values()), np.int64, len(keys))
    if len(nexts) * width * 4 <= table_bytes:
        whole = np.zeros(len(nexts) * width, np.int32)
        whole[keys] = to
        return Automaton(width, root, whole, None)
    size = 1 << max(4, int(np.ceil(np.log2(2.5 * len(keys) + 1))))
    while True:
        both = np.stack(places(keys, size)).astype(np.int64)
        table, side = np.full(size, -1), np.zeros(len(keys), np.int64)
        waiting = np.arange(len(keys))
        for _ in range(500):
            at = both[side[waiting], waiting]
            before = np.unique(table[at])
            table[at] = waiting
            out = waiting[table[at] != waiting]
            waiting = np.concatenate((out, before[before >= 0]))
            if not len(waiting):
                break
            side[waiting] ^= 1
        if not len(waiting):
            break
        size *= 2
    has = table >= 0
    entries = np.full(size, -1, np.int64)
    entries[has] = keys[table[has]] << 32 | to[table[has]]
    return Automaton(width, root, None, entries)


def letters_of(text: str) -> str:
    """Lower case; every run of other characters than letters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def training_sample(docs: DataFrame, held_out: Column, chars_per_lang: int = CHARS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, at, text``: for each language the windows of its labelled texts with the
    smallest hashes, up to ``chars_per_lang`` characters, or an equal share of
    ``SAMPLE_CHARS`` where there are many languages. Windows lie side by side over whole
    texts of any length, so every language has one at least that has a text with a
    letter. Only their numbers are sorted, partly before the shuffle; a second scan cuts
    the chosen ones out."""
    said = F.col(text_col)
    rows = docs.where(~held_out & F.col(lang_col).isNotNull() & said.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), said).alias("key"), said.alias("text"))
    langs = rows.select("lang").distinct().count()
    share = max(LEAST, min(chars_per_lang, SAMPLE_CHARS // max(1, langs)))
    window = min(WINDOW, share)
    numbers = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / window).cast("int"))).alias("n")
    at = F.pmod(F.xxhash64("key", "n", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    first = W.partitionBy("lang").orderBy("at", "key", "n")
    chosen = rows.select("lang", "key", numbers).withColumn("at", at).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= share // window)
    chosen = stored(chosen.drop("rank").dropDuplicates(["lang", "key", "n"]), "lang-windows")
    found = rows.join(broadcast_if_small(chosen), ["lang", "key"]).dropDuplicates(["lang", "key", "n"])
    return found.select("lang", "at", F.substring("text", F.col("n") * window + 1, F.lit(window)).alias("text"))


def fit(sample: DataFrame) -> Model:
    """The automata, from ``training_sample``, each language's in a task of its own. The
    sample is bounded by its parameters, and so are the model and what the driver gets."""
    sample = stored(sample, "lang-sample")
    letters = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).distinct()
    known = "".join(sorted({c for r in letters.collect() for c in r["c"].lower() if c.isalpha()}))
    code = {" ": 0} | {c: i + 1 for i, c in enumerate(known)}
    table_bytes = min(TABLE_BYTES, TABLES_BYTES // max(1, sample.select("lang").distinct().count()))

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("at").to_pylist(), group.column("text").to_pylist(), strict=True))
        ref = " ".join(x for x in (letters_of(t) for _, t in rows) if x)
        lang = group.column("lang")[0].as_py()
        if not ref:
            return pa.table({"lang": pa.array([], pa.string()), "bits": pa.array([], pa.float64()), "automaton": pa.array([], pa.binary())})
        found = pickle.dumps(automaton([code[c] for c in ref], len(known) + 2, table_bytes))
        give_back()
        return pa.table({"lang": [lang], "bits": [math.log2(len(ref) + 1)], "automaton": pa.array([found], pa.binary())})

    got = sorted(sample.groupBy("lang").applyInArrow(build, "lang string, bits double, automaton binary").collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in got], known, [pickle.loads(r["automaton"]) for r in got], [r["bits"] for r in got])


@lru_cache(maxsize=1)
def encoder(letters: str) -> np.ndarray:
    """Code of each code point: 0 for what is no letter, the last for letters that no
    sample has."""
    table = np.zeros(0x110000, np.uint16 if len(letters) < 65_000 else np.uint32)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = len(letters) + 1
    for i, c in enumerate(letters):
        table[ord(c)] = i + 1
    return table


def encode_texts(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, one after the other, with single spaces inside and none
    at the ends; and each text's length."""
    low = [(t or "").lower() + " " for t in texts]
    codes = table[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    first = np.ones(len(codes), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.zeros_like(codes)
    before[1:] = codes[:-1]
    keep = (codes > 0) | ((before > 0) & ~first)
    codes, doc = codes[keep], doc[keep]
    last = np.ones(len(codes), bool)
    last[:-1] = doc[1:] != doc[:-1]
    keep = ~(last & (codes == 0))
    return codes[keep], np.bincount(doc[keep], minlength=len(low))


def walk(a: Automaton, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after each range of codes, and how many phrases begin in it."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, state = starts[order], sizes[order], states[order]
    count = np.zeros(len(sizes), np.int64)
    top = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(top), side="left")
    for t in range(top):
        n = active[t]
        c = codes[starts[:n] + t]
        s = state[:n]
        to = a.step(s, c)
        new = np.flatnonzero((to == 0) | (s == 0))
        count[new] += 1
        to[new] = a.begin(c[new])
        state[:n] = to
    ends, counts = np.empty_like(state), np.empty_like(count)
    ends[order], counts[order] = state, count
    return ends, counts


def count_phrases(codes: np.ndarray, sizes: np.ndarray, automata: list[Automaton], lane: int = LANE, warm_up: int = WARM_UP) -> np.ndarray:
    """Phrases per text (row) and language (column)."""
    out = np.zeros((len(sizes), len(automata)), np.int64)
    lanes = -(-sizes // lane)
    if not lanes.sum():
        return out
    doc = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * lane
    lengths = np.minimum(lane, np.repeat(sizes, lanes) - nth * lane)
    later = np.flatnonzero(nth > 0)
    for k, a in enumerate(automata):
        begin = np.zeros(len(doc), np.int32)
        # All lanes before a later one are whole, so letters before it are of its text.
        begin[later], _ = walk(a, codes, starts[later] - min(warm_up, lane), np.full(len(later), min(warm_up, lane)), begin[later])
        end, count = walk(a, codes, starts, lengths, begin)
        while len(wrong := later[begin[later] != end[later - 1]]):
            begin[wrong] = end[wrong - 1]
            end[wrong], count[wrong] = walk(a, codes, starts[wrong], lengths[wrong], begin[wrong])
        out[:, k] = np.bincount(doc, weights=count, minlength=len(sizes))
    return out


def decide(model: Model, phrases: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language with the smallest entropy (the first by name of equal ones), how
    far, relatively, it is ahead of the second, and the letters of its phrases on
    average, ``MORE_LETTERS`` added."""
    if not model.langs:
        return [UNKNOWN] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
    cost = phrases * np.array(model.bits) / np.maximum(sizes, 1)[:, None]
    best = np.argmin(cost, axis=1)
    ranked = np.sort(cost, axis=1)
    second = ranked[:, 1] if len(model.langs) > 1 else np.full(len(sizes), max(model.bits))
    score = np.where(sizes > 0, 1 - ranked[:, 0] / np.maximum(second, 1e-12), 0.0)
    mean = (sizes + MORE_LETTERS) / np.maximum(phrases[np.arange(len(best)), best], 1)
    return [model.langs[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.clip(score, 0, 1), mean


def predict(docs: DataFrame, model: Model, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` and ``phrase`` (as
    ``decide`` has them). A text that is null or has no letter is ``und`` with score 0. ``docs``
    should hold only the text and what identifies its rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c != text_col]
    schema = docs.select(*carried).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "phrase": F.lit(0.0)}).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = encoder(m.letters)
        for batch in batches:
            texts = as_strings(batch.column(text_col))
            for start, end in blocks(texts, block_bytes):
                codes, sizes = encode_texts(texts.slice(start, end - start).to_pylist(), table)
                langs, score, phrase = decide(m, count_phrases(codes, sizes, m.automata) if m.automata else np.zeros((len(sizes), 0)), sizes)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(phrase, pa.float64())], names=[*carried, "lang_pred", "score", "phrase"])
        give_back()

    return docs.mapInArrow(label, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars_per_lang: int = CHARS_PER_LANG) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``.

    Learns only from rows that are not held out (a null id is not) and have text and
    language. Without any such row every prediction is ``und``. Predictions see the
    text alone, all of it, so repeated rows get equal ones. Of languages with equal
    entropy the first by name counts. Other columns of ``docs`` are ignored. An empty
    table gives no rows.
    """
    model = fit(training_sample(docs, is_held_out(id_col), chars_per_lang, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a language that is known, with all columns;
    the predicted language takes the place of the given one.

    A text goes that is null or has no letter, or of which the best language's sample has
    hardly more than single letters: phrases of fewer than ``MIN_PHRASE`` letters on
    average, ``MORE_LETTERS`` added. Repeated rows stay or go
    together. Without any labelled text nothing is known and all rows go. An empty table
    gives no rows.
    """
    model = fit(training_sample(docs, is_held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col(text_col).alias("text"))
    known = predict(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase") >= MIN_PHRASE))
    return known.withColumn("row", F.col("row").withField(f"`{lang_col}`", F.col("lang_pred").cast(docs.schema[lang_col].dataType))).select("row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents."""
    return identify(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_language_id": op9_language_id}
