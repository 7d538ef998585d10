"""Language ID for any number of languages and texts of any length, and by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language_id

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, at int"


def made(langs, docs, words, seed=5):
    """Texts in made-up languages: each has its own words over the same letters."""
    r, rows = random.Random(seed), []
    for k in range(langs):
        lexicon = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 7))) for _ in range(60)]
        for _ in range(docs):
            rows.append((len(rows), " ".join(r.choices(lexicon, k=words)), f"l{k:04}", 1))
    return rows


def learned(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    held = language_id.is_held_out()
    want = {r["lang"] for r in df.where(~held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang").distinct().collect()}
    return language_id.fit(language_id.training_sample(df, held)), want


def test_sixty_languages_of_long_documents(spark):
    rows = made(60, 6, 1500)
    model, want = learned(spark, rows)
    assert set(model.langs) == want and len(want) >= 58
    assert model.nbytes() < 200_000_000
    truth = {r[0]: r[2] for r in rows}
    got = [x for x in language_id.identify(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect() if truth[x.doc_id] in want]
    assert len(got) > 60 and sum(x.lang_pred == truth[x.doc_id] for x in got) >= 0.95 * len(got)


def test_a_thousand_languages(spark):
    """Every language that has a labelled document with a letter is learned."""
    rows = made(1000, 4, 40) + [(9000 + i, t, f"odd{i}", 1) for i, t in enumerate(["", "12 3", None, "x"])]
    model, want = learned(spark, rows)
    assert set(model.langs) == want and len(want) > 950
    assert model.nbytes() < 200_000_000


@pytest.mark.parametrize("base", [0, 10_000, 20_000, 30_000])
def test_a_language_with_long_texts_only(spark, base):
    rows = [(base + i, t, lang, 1) for i, (_, t, lang, _) in enumerate(made(1, 4, 60_000, base) + [(0, t, "short", 1) for _, t, _, _ in made(1, 30, 80, base + 1)])]
    model, want = learned(spark, rows)
    assert set(model.langs) == want == {"l0000", "short"}


def test_sample_is_the_smallest_hashes(spark):
    """Windows of whole texts, none left out before the smallest are taken."""
    rows = made(2, 40, 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    held = language_id.is_held_out()
    got = sorted((r["lang"], r["at"], r["text"]) for r in language_id.training_sample(df, held, chars_per_lang=20_480).collect())
    own = df.where(~held).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    numbers = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 4096).cast("int"))).alias("n")
    at = F.pmod(F.xxhash64("key", "n", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    every = sorted((r["lang"], r["at"], r["text"][r["n"] * 4096 :][:4096]) for r in own.select("lang", "text", "key", numbers).withColumn("at", at).collect())
    assert got == [x for lang in ("l0000", "l0001") for x in [e for e in every if e[0] == lang][:5]]


def longest_matches(text, ref):
    """Number of greedy phrases, by a binary search for each in the sorted suffixes."""
    n = at = 0
    while at < len(text):
        low, high = 1, len(text) - at
        while low < high:  # the longest piece from here that is in the reference
            mid = (low + high + 1) // 2
            low, high = (mid, high) if text[at : at + mid] in ref else (low, mid - 1)
        n, at = n + 1, at + low
    return n


def test_op9_by_brute_force(spark):
    """Sample, parses and decision of every text of up to 2500 letters, in plain Python."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language_id.training_sample(df, language_id.is_held_out()).collect()
    refs = {}
    for lang, _, text in sorted((r["lang"], r["at"], r["text"]) for r in sample):
        refs.setdefault(lang, []).append(language_id.letters_of(text))
    refs = {lang: " ".join(t for t in own if t) for lang, own in sorted(refs.items())}
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    seen = 0
    for x in language_id.op9_language_id(spark, SF).collect():
        plain = language_id.letters_of(texts[x.doc_id] or "")
        if not plain:
            assert (x.lang_pred, x.score) == ("und", 0)
            continue
        if len(plain) > 2500:
            continue
        seen += 1
        cost = {lang: longest_matches(plain, ref) * math.log2(len(ref) + 1) / len(plain) for lang, ref in refs.items()}
        first, second = sorted(cost.values())[:2]
        assert x.lang_pred == min(cost, key=lambda k: (cost[k], k))
        assert np.isclose(x.score, 1 - first / second)
    assert seen > 80
