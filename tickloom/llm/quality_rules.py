"""Quality rules with adaptive thresholds.

Counts of each document's whole text come from one vectorised pass. Per language
and source, log-linear histograms of four rates are mergeable quantile sketches:
integer bins of relative width 1/32, so that partial sketches add up to the same
sketch whatever the partitioning, and a group's sketch merges into its language's
and the corpus'. Thresholds come from the sketch alone and replace fixed cutoffs: where
a rate falls into two classes that lie apart, the threshold is between them, and
elsewhere as far beyond a tail quantile as that is beyond the quartile. The documents
are joined with their group's thresholds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, read, stored

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Documents whose words are counted together, in characters.
BLOCK_CHARS = 4_000_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Groups with fewer documents use their language's thresholds, or the corpus'.
MIN_GROUP = 50
#: Rates, as integers: name, numerator, denominator, scale, and whether low ones are odd.
RATES = (
    ("chars_per_word", "word_chars", "n_words", 100, True),
    ("symbols", "n_symbols", "word_chars", 1000, False),
    ("dup_lines", "n_dup_lines", "n_words", 1000, False),
    ("repeats", "n_repeat_words", "n_words", 1000, False),
)
#: Percent of documents in a tail, and at most in the upper of two classes.
TAIL = 2
UPPER = 25
#: Two classes lie apart if so much of the variance of the bins is between them.
APART = 0.9


def repeated_words(words: list[list[str]], width: int = 5) -> np.ndarray:
    """Per text, the words that lie in a window of ``width`` words found at least
    twice in that text. Codes of pairs and of fours stay exact integers."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    if sizes.sum() < width:
        return out
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    codes = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    key = codes
    for step in range(1, width):
        key = key[:-1] * (codes.max() + 1) + codes[step:]
        key = pd.factorize(key)[0].astype(np.int64)
    starts = np.flatnonzero(doc[: len(key)] == doc[width - 1 :])
    own = pd.factorize(key[starts] * len(words) + doc[starts])[0]
    twice = starts[np.bincount(own)[own] > 1] if len(own) else starts
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + width, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words)).astype(np.int64)


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    words = [_WORD.findall(t or "") for t in texts]
    dups = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if _WORD.search(x)]
        dups.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([sum(map(len, w)) for w in words], np.int64),
        "n_symbols": np.array([sum(map((t or "").count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": repeated_words(words),
    }


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, lang, source`` and the five counts, one row per row."""
    ids = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                found = text_counts(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "lang", "source")), *(pa.array(found[n]) for n in names)],
                    names=["doc_id", "lang", "source", *names],
                )

    return rows.mapInArrow(count, f"doc_id {ids}, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def sketch_bin(v: Column) -> Column:
    """Exact below 32; above, 32 bins for each power of two."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 32, v).otherwise((e + 1) * 32 + F.call_function("shiftright", v, e) - 32)


def bin_start(b: Column) -> Column:
    """The smallest value of a bin."""
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b % 32 + 32, (F.floor(b / 32) - 1).cast("int")))


def bin_end(b: Column) -> Column:
    """The largest value of a bin."""
    return bin_start(b + 1) - 1


def sketch(rows: DataFrame) -> DataFrame:
    """``level, lang, source, rate, bin, n``: the sketch of each group (level 0),
    language (1) and of all (2). Levels 1 and 2 merge level 0's sketches."""
    rate = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), sketch_bin(F.col(name)).alias("bin")) for name, *_ in RATES]))
    base = rows.select("lang", "source", rate.alias("r")).groupBy("lang", "source", "r.rate", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None).cast("string")).alias("lang"), (F.col("source") if k < 1 else F.lit(None).cast("string")).alias("source")) for k in (0, 1, 2)]))
    return base.select(level.alias("g"), "rate", "bin", "n").groupBy("g.level", "g.lang", "g.source", "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, tail: int = TAIL, apart: float = APART) -> DataFrame:
    """``level, lang, source, docs`` and, per rate, ``lo_`` and ``hi_`` columns. Of all
    cuts of a sketch into two, that with the largest variance between the sides counts."""
    group = ["level", "lang", "source", "rate"]
    real = lambda c: F.col(c).cast("double")
    ahead = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = sketches.withColumn("m", F.col("bin") * F.col("n")).withColumn("mm", F.col("bin") * F.col("m"))
    q = q.select(*group, "bin", F.sum("n").over(ahead).alias("w"), F.sum("m").over(ahead).alias("s"), F.lead("bin").over(W.partitionBy(*group).orderBy("bin")).alias("next"), *[F.sum(c).over(W.partitionBy(*group)).alias(f"all_{c}") for c in ("n", "m", "mm")])
    off = real("all_m") * real("w") - real("all_n") * real("s")
    spread = real("w") * (real("all_n") - real("w")) * (real("all_n") * real("all_mm") - real("all_m") * real("all_m"))
    cut = F.struct((off * off / F.nullif(spread, F.lit(0.0))).alias("share"), (-F.col("bin")).alias("minus"), "w", "bin", "next")
    at = lambda k: F.min(F.when(F.col("w") * 100 >= F.col("all_n") * k, F.col("bin")))
    q = q.groupBy(*group).agg(F.max("all_n").alias("docs"), *[at(k).alias(f"q{k}") for k in (tail, 25, 75, 100 - tail)], F.max(F.when(F.col("next").isNotNull(), cut)).alias("cut"))
    between = F.floor((bin_end(F.col("cut.bin")) + bin_start(F.col("cut.next"))) / 2).cast("long")
    two = F.coalesce((F.col("cut.share") >= apart) & (F.col("cut.w") * 100 >= F.col("docs") * (100 - UPPER)), F.lit(False))
    hi = F.when(two, between).otherwise(2 * bin_end(F.col(f"q{100 - tail}")) - bin_start(F.col("q75")))
    lo = 2 * bin_start(F.col(f"q{tail}")) - bin_end(F.col("q25"))
    out = []
    for name, *_, low in RATES:
        mine = F.col("rate") == name
        out.append(F.max(F.when(mine, hi)).alias(f"hi_{name}"))
        if low:
            out.append(F.max(F.when(mine, lo)).alias(f"lo_{name}"))
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *out)


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, tail: int = TAIL, **columns: str) -> DataFrame:
    """Counts, ``base_failed`` and ``kept``, one row per row of ``docs``.

    ``base_failed``: fewer than ten words, or over 20 % of words in repeated
    windows. ``kept``: not ``base_failed``, and every rate within the thresholds of its
    language and source; groups with under ``min_group`` such documents use their
    language's, and small languages the corpus'. Null language or source is
    a group of its own. A null or empty text has no words and fails. Repeated rows
    count each time. Columns other than the four named are ignored.
    """
    rows = count_documents(docs, **columns)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = rows.withColumn("base_failed", failed)
    for name, over, under, scale, *_ in RATES:
        rows = rows.withColumn(name, F.when(F.col(under) > 0, F.expr(f"{scale} * {over} div {under}")).otherwise(F.lit(0)).cast("long"))
    rows = stored(rows, "quality-counts")
    found = stored(fences(sketch(rows.where("not base_failed")), tail), "quality-fences")
    limits = [c for c in found.columns if c[:3] in ("hi_", "lo_")]
    by = lambda k: found.where(F.col("level") == k)
    own, lang, every = by(0), by(1), by(2).first()
    pick = lambda t, p: t.select(*[F.col(c).alias(f"{p}_{c}") for c in ("lang", "source", "docs", *limits)])
    own = pick(own, "a").join(broadcast_if_small(pick(lang, "b")), F.col("a_lang").eqNullSafe(F.col("b_lang")), "left")
    use = lambda c: F.when(F.col("a_docs") >= min_group, F.col(f"a_{c}")).when(F.col("b_docs") >= min_group, F.col(f"b_{c}")).otherwise(F.lit(every[c]).cast("long") if every else F.lit(None).cast("long"))
    own = stored(own.select("a_lang", "a_source", *[use(c).alias(c) for c in limits]), "quality-limits")
    joined = rows.join(broadcast_if_small(own), F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left")
    inside = F.lit(True)
    for name, *_, low in RATES:
        inside &= F.col(name) <= F.col(f"hi_{name}")
        if low:
            inside &= F.col(name) >= F.col(f"lo_{name}")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[name for name, *_ in RATES]
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts."""
    return quality_rules(read(spark, sf_dir, "documents"))


def _sql() -> str:
    rates = ", ".join(f"CAST(CASE WHEN {u} > 0 THEN {s} * {o} // {u} ELSE 0 END AS BIGINT) AS {n}" for n, o, u, s, *_ in RATES)
    long = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rate, {n} AS v FROM r WHERE NOT base_failed" for n, *_ in RATES)
    tests = " AND ".join(
        f"coalesce({n} <= (CASE WHEN own_docs >= {MIN_GROUP} THEN own['{n}'].hi WHEN lang_docs >= {MIN_GROUP} THEN lg['{n}'].hi ELSE al['{n}'].hi END), true)"
        + (f" AND coalesce({n} >= (CASE WHEN own_docs >= {MIN_GROUP} THEN own['{n}'].lo WHEN lang_docs >= {MIN_GROUP} THEN lg['{n}'].lo ELSE al['{n}'].lo END), true)" if low else "")
        for n, *_, low in RATES
    )
    return rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {rates} FROM c
), v AS (
  {long}
), b AS (
  SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, rate,
         CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v
  FROM v, (SELECT unnest([0, 1, 2]) AS level)
), h AS (
  SELECT level, lang, source, rate, b, min(lowest) AS v, min(CASE WHEN lowest < 32 THEN lowest ELSE lowest + (1 << (length(bin(lowest)) - 6)) - 1 END) AS e, count(*) AS n
  FROM (SELECT level, lang, source, rate, v AS lowest, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 32 + (v >> (length(bin(v)) - 6)) - 32 END AS b FROM b) GROUP BY ALL
), u AS (
  SELECT level, lang, source, rate, b, v, e, sum(n) OVER o AS w, sum(b * n) OVER o AS s, lead(v) OVER g AS next_v,
         sum(n) OVER p AS all_n, sum(b * n) OVER p AS all_m, sum(b * b * n) OVER p AS all_mm
  FROM h
  WINDOW g AS (PARTITION BY level, lang, source, rate ORDER BY b), p AS (PARTITION BY level, lang, source, rate),
         o AS (PARTITION BY level, lang, source, rate ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), x AS (
  SELECT *, CASE WHEN next_v IS NOT NULL THEN (CAST(all_m AS DOUBLE) * CAST(w AS DOUBLE) - CAST(all_n AS DOUBLE) * CAST(s AS DOUBLE)) * (CAST(all_m AS DOUBLE) * CAST(w AS DOUBLE) - CAST(all_n AS DOUBLE) * CAST(s AS DOUBLE))
         / (CAST(w AS DOUBLE) * (CAST(all_n AS DOUBLE) - CAST(w AS DOUBLE)) * (CAST(all_n AS DOUBLE) * CAST(all_mm AS DOUBLE) - CAST(all_m AS DOUBLE) * CAST(all_m AS DOUBLE))) END AS share
  FROM u
), q AS (
  SELECT level, lang, source, rate, max(all_n) AS docs, min(v) FILTER (w * 100 >= all_n * {TAIL}) AS ql, min(e) FILTER (w * 100 >= all_n * 25) AS q1,
         min(v) FILTER (w * 100 >= all_n * 75) AS q3, min(e) FILTER (w * 100 >= all_n * {100 - TAIL}) AS qh,
         max({{'share': share, 'minus': -b, 'w': w, 'e': e, 'next_v': next_v}}) FILTER (next_v IS NOT NULL) AS cut
  FROM x GROUP BY level, lang, source, rate
), f AS (
  SELECT level, lang, source, CAST(max(docs) AS BIGINT) AS docs,
         map_from_entries(list((rate, {{'hi': CAST(CASE WHEN coalesce(cut.share >= {APART} AND cut.w * 100 >= docs * {100 - UPPER}, false) THEN (cut.e + cut.next_v) // 2 ELSE 2 * qh - q3 END AS BIGINT), 'lo': CAST(2 * ql - q1 AS BIGINT)}}))) AS m
  FROM q GROUP BY level, lang, source
), j AS (
  SELECT r.*, a.docs AS own_docs, a.m AS own, l.docs AS lang_docs, l.m AS lg, e.m AS al
  FROM r LEFT JOIN f a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
         LEFT JOIN f l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM r.lang AND a.docs IS NOT NULL
         LEFT JOIN f e ON e.level = 2 AND a.docs IS NOT NULL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept,
       {", ".join(n for n, *_ in RATES)}
FROM j
"""


SQL = {"op7_quality_rules": _sql()}
QUERIES = {"op7_quality_rules": op7_quality_rules}
