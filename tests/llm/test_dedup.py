"""Exact copies, near copies and shared passages, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, exact_dedup, near_dedup, passages

SCHEMA = "doc_id long, text string, digest string, bucket int"


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


ROWS = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "a b c "), (5, "a b c "), (6, "z" * 50_000), (7, "z" * 50_000), (None, "a b c"), (9, "only")]


def expected_groups(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, n in norm:
        own = [k for k, m in norm if m == n]
        ids = [k for k in own if k is not None]
        out.append((i, min(ids) if ids else None, len(own)))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """With a weak digest nearly all texts share one, and are told apart."""
    digest = (lambda c: F.encode((F.crc32(F.encode(c, "UTF-8")) % 2).cast("string"), "UTF-8")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(table(spark, ROWS), digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expected_groups(ROWS)
    assert Counter(r.doc_id for r in got if r.kept) == Counter([1, 3, 5, 6, 9])


def test_exact_dedup_keeps_columns(spark):
    got = exact_dedup.keep_first(table(spark, ROWS))
    assert got.columns == ["doc_id", "text", "digest", "bucket"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 6, 9]


def test_index_of_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    key = lambda rows: table(spark, rows).select(F.col("doc_id").alias("id"), exact_dedup.sha256(exact_dedup.normalised("text")).alias("digest"))
    index.add(key([(5, "a"), (6, "b")]))
    index.compact()
    index.add(key([(2, "a")]))
    assert Counter((r.keep_id, r.n) for r in index.compact().collect()) == Counter([(2, 2), (6, 1)])


def test_index_reads_few_files(spark):
    """Three batches: a compaction reads level 1 and the runs added since, and shuffles
    these only; a lookup reads the files whose filters let a digest through."""
    index = exact_dedup.DigestIndex(spark, memtable_rows=40)
    keyed = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").select("id", exact_dedup.sha256(F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("digest"))
    index.add(keyed(range(300)).coalesce(1))
    assert len(index.runs().inputFiles()) == 8
    first = index.compact()
    index.add(keyed(range(1200, 1500)))
    names = [f for f in index.merging().inputFiles()]
    assert {f.split("/level")[1][:8] for f in names} == {"0/000001", "1/000001"}
    plan = index.merging()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    index.compact()
    index.add(keyed([2007, 9998]).coalesce(1))
    asked = keyed([7, 250, 450, 777])
    assert {(r.keep_id, r.n) for r in index.lookup(asked).collect()} == {(7, 2), (250, 2), (1450, 1)}
    all_files = {*index.runs().inputFiles(), *index.compact().inputFiles()}
    read = {r.file for r in index.candidates(asked).select("file").collect()}
    assert 0 < len(read) <= 4 < len(all_files) and not any("/level0/000000" in f or "/level0/000001" in f for f in read)
    assert first.count() == 300 and index.compact().count() == 501


def test_filter_too_large_to_broadcast(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("digest"))
    some = rows.limit(10)
    assert exact_dedup.bit_filter(some, 10, max_bits=3)(rows).count() == 10
    assert 10 <= exact_dedup.bit_filter(some, 10)(rows).count() < 20


def test_components_with_hubs(spark):
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(400, 440)] + [(299, 440)]
    links = spark.createDataFrame(edges, "a long, b long")
    for limit in (None, 0):
        got = {r.id: r.comp for r in near_dedup.components(links, limit).collect()}
        assert got == {k: 0 for k in (*range(1, 300), *range(400, 441))}


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert passages.shared_passages(none).count() == 0


def weighted(a, b):
    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 0.0


def near_rows():
    """A star of near copies around one text, in which the outer ones are linked
    to their centre only, repeated lines, and texts that are unlike."""
    base = words(1, 300)
    rows = [(10, " ".join(base)), (11, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in range(5):
            w[(k * 5 + j * 57) % 300] = f"x{k}-{j}"
        rows.append((100 + k, " ".join(w)))
    line = " ".join(words(2, 12))
    rows += [(300, "\n".join([line] * 40)), (301, "\n".join([line] * 42)), (302, "\n".join([line] * 10))]
    rows += [(400 + k, " ".join(words(50 + k, 80))) for k in range(20)]
    rows += [(500, "one two"), (501, "one  two"), (502, "one two three"), (503, None), (504, ""), (505, " \n")]
    return rows


@pytest.mark.parametrize("paired, block", [(48, 1024), (2, 8)])
def test_near_dedup(spark, paired, block):
    """Small bounds send the large buckets through the blocks."""
    rows = near_rows()
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if weighted(a, b) >= 0.8 or (not (a or "").strip() and (a or "")[:1] == (b or "")[:1]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows), paired=paired, block=block).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_near_dedup_keeps_one(spark):
    rows = near_rows()
    got = near_dedup.keep_one(table(spark, rows))
    assert got.columns == ["doc_id", "text", "digest", "bucket"]
    kept = {r.doc_id for r in got.collect()}
    assert 10 in kept and not kept & {11, *range(100, 160)} and {300, 302, *range(400, 420)} <= kept


def test_signatures_are_unbiased():
    a, b = " ".join(words(3, 400)), " ".join(words(3, 400)[:300] + words(4, 100))
    line = " ".join(words(5, 9)) + " "
    for x, y in ((a, b), (line * 30, line * 20)):
        doc, h, n = near_dedup.counted(*near_dedup.shingles([x, y]))
        s = near_dedup.signatures(doc, h, n, 2, 4096)
        assert abs((s[0] == s[1]).mean() - weighted(x, y)) < 0.03


def test_block_links_span():
    texts = [t for _, t in near_rows()]
    sets = near_dedup.copy_sets(texts)
    links = near_dedup.block_links(sets, list(range(len(texts))), 0.8)
    assert all(weighted(texts[i], texts[j]) >= 0.8 for i, j in links)
    first = len(texts) // 3
    across = near_dedup.block_links(sets, list(range(len(texts))), 0.8, first)
    assert all(i < first <= j and weighted(texts[i], texts[j]) >= 0.8 for i, j in across)
    root = list(range(len(texts)))
    for i, j in across:
        root = [root[i] if x == root[j] else x for x in root]
    assert all(root[i] == root[j] for i in range(first) for j in range(first, len(texts)) if weighted(texts[i], texts[j]) >= 0.8)


def test_passages(spark):
    shared, other = words(7, 60), words(8, 55)
    edited = list(shared)
    edited[20:21] = ["new", "words"]
    del edited[40]
    rows = [
        (1, " ".join(words(20, 80) + shared + words(21, 40))),
        (2, " ".join(words(22, 10) + shared + words(23, 90))),
        (3, " ".join(words(24, 30) + edited)),
        (4, " ".join(other + words(25, 30))),
        (5, " ".join(words(26, 5) + other)),
        (6, " ".join(words(27, 300))),
        (7, " ".join(words(28, 50) + shared[:30] + words(29, 50))),
        (8, None),
        (9, ""),
        (10, "a " * 3000),
        (11, "a " * 2500),
    ]
    got = {(r.doc_id, r.other_id): r for r in passages.shared_passages(table(spark, rows)).collect()}
    assert set(got) == {(2, 1), (3, 1), (5, 4), (11, 10)}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].other_start) == (10, 70, 80)
    assert got[3, 1].words >= 56


def test_parts_of_a_chain():
    """Chains that are unlike as a whole are cut: equal passages around other words
    of their own length, and every other paragraph rewritten."""
    a, b = words(71, 60), words(72, 60)
    pivot, text = [" ".join(words(k, 30) + a + words(k + 1, 60) + b + words(k + 2, 30)) for k in (73, 83)]
    assert [f[1:] for f in passages.passages(pivot, [text])] == [(30, 90, 30, 90, 60), (150, 210, 150, 210, 60)]
    old = [words(90 + k, 100) for k in range(6)]
    new = [p if k % 2 else words(190 + k, 100) for k, p in enumerate(old)]
    got = passages.passages(" ".join(sum(old, [])), [" ".join(sum(new, []))])
    assert [f[1:3] for f in got] == [(100, 200), (300, 400), (500, 600)]


def test_passage_repeated_in_part():
    """The pivot holds the start of a passage before the passage."""
    shared = words(61, 60)
    pivot = words(62, 20) + shared[:35] + words(63, 500) + shared + words(64, 20)
    got = passages.passages(" ".join(pivot), [" ".join(words(65, 10) + shared + words(66, 10))])
    assert got == [(0, 10, 70, 555, 615, 60)]


def test_maximal_runs():
    """All of them, as by comparing every place with every place."""
    r = random.Random(3)
    for _ in range(100):
        a, b, c = ([f"{r.randrange(3)}" for _ in range(r.randrange(40))] for _ in range(3))
        expected = set()
        for t, x in enumerate((a, b)):
            for i in range(len(x)):
                for j in range(len(c)):
                    n = 0
                    while i + n < len(x) and j + n < len(c) and x[i + n] == c[j + n]:
                        n += 1
                    if n >= 5 and not (i and j and x[i - 1] == c[j - 1]):
                        expected.add((t, i, j, n))
        sizes, h = passages.word_hashes([" ".join(a), " ".join(b)])
        got = passages.maximal_runs(sizes, h, passages.word_hashes([" ".join(c)])[1], 5)
        assert Counter(zip(*(x.tolist() for x in got), strict=True)) == Counter(expected)


@pytest.mark.parametrize("every, least", [(8, 0.98), (10, 0.98), (12, 0.98)])
def test_seeds_of_edited_passages(every, least):
    """Of passages of 60 words with every n-th one replaced, in texts of their own,
    so many share a seed."""
    pairs, found = [], 0
    for k in range(400):
        old = words(1000 + k, 60)
        new = [f"new{k}-{i}" if i % every == every - 1 else w for i, w in enumerate(old)]
        pairs += [" ".join(words(2000 + 4 * k + m, 30) + p + words(4000 + 4 * k + m, 30)) for m, p in enumerate((old, new))]
    doc, h, _ = passages.seeds(pairs)
    for k in range(400):
        found += len(set(h[doc == 2 * k].tolist()) & set(h[doc == 2 * k + 1].tolist())) >= passages.SEEDS_IN_COMMON
    assert found >= least * 400


def test_passage_behind_parts(spark):
    """Documents with smaller ids hold each seed of a passage, and none the whole;
    the passage is as short as passages are."""
    for seed in range(1000, 1200):  # the first passage for which that is so
        shared = words(seed, 50)
        rows = [(k, " ".join(words(152 + k, 20) + shared[a : a + 40] + words(252 + k, 20))) for k, a in enumerate((0, 2, 4, 6, 8, 10))]
        rows += [(k, " ".join(words(350 + k, 20 + k) + shared + words(450 + k, 30))) for k in (13, 14, 15)]
        doc, h, _ = passages.seeds([t for _, t in rows])
        parts = set(h[doc < 6].tolist())
        if not any(n > 1 and x not in parts for x, n in Counter(h.tolist()).items()):
            break
    else:
        raise AssertionError("no such passage")
    got = sorted(tuple(r) for r in passages.shared_passages(table(spark, rows)).collect())
    assert got == [(14, 34, 84, 13, 33, 83, 50), (15, 35, 85, 13, 33, 83, 50)]


def test_passage_behind_halves(spark):
    """Three documents hold a half each of a passage of 92 words that two later ones share."""
    shared = words(777, 92)
    rows = [(k, " ".join(words(500 + k, 30) + shared[a : a + 46] + words(520 + k, 30))) for k, a in enumerate((0, 46, 23))]
    rows += [(k, " ".join(words(500 + k, 30) + shared + words(520 + k, 30))) for k in (3, 4)]
    assert [tuple(r) for r in passages.shared_passages(table(spark, rows)).collect()] == [(4, 30, 122, 3, 30, 122, 92)]


def test_edited_passages_behind_parts(spark):
    """Pairs of documents share passages of 92 words with every 12th replaced; three smaller
    documents hold 46 words of each. All pairs are found."""
    rows, want = [], []
    for k in range(60):
        shared, at = words(9000 + k, 92), 10 * k
        other = [f"e{k}_{i}" if i % 12 == 11 else w for i, w in enumerate(shared)]
        own = lambda i: words(20_000 + at + i, 25)  # noqa: E731, B023
        rows += [(at + i, " ".join(own(i) + shared[a : a + 46] + own(i + 4))) for i, a in enumerate((0, 46, 23))]
        rows += [(at + 3, " ".join(own(3) + shared + own(7))), (at + 8, " ".join(own(8) + other + own(9)))]
        want.append((at + 8, at + 3))
    got = {(r.doc_id, r.other_id): r for r in passages.shared_passages(table(spark, rows)).collect()}
    assert set(got) == set(want)
    assert all(r.end_word - r.start_word >= 80 for r in got.values())


def test_seeds_outside_passages():
    """Seeds inside a passage are left out, those that reach beyond it are not."""
    text = " ".join(words(61, 120))
    doc, h, _ = passages.seeds([text, None, text])
    rest, left, _ = passages.seeds([text, None, text], done=[[{"start_word": 30, "end_word": 80}], None, []])
    assert set(left[rest == 2].tolist()) == set(h[doc == 2].tolist())
    _, _, places = passages.window_hashes(*passages.word_hashes([text]), passages.SEED_WORDS)
    at = {int(x) >> 1: i for i, x in enumerate(places)}
    assert set(left[rest == 0].tolist()) == {x for x in h[doc == 0].tolist() if not 30 <= at[x] <= 75}
    assert len(passages.seeds([text], done=[[{"start_word": 0, "end_word": 120}]])[1]) == 0


def test_open_windows():
    """Parts and windows agree exactly where fifty words do, and passages are left out."""
    shared = words(41, 50)
    texts = [" ".join(words(42 + k, 10 + k) + shared + words(44 + k, 9)) for k in range(2)]
    doc, part, h = passages.open_windows([*texts, None, "a b"], [None, None, None, []])
    assert len(h) == 20 + 21 and len(set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())) == 1
    (same,) = set(h.tolist()) & set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())
    assert len(set(part[h == same].tolist())) == 1
    doc, _, _ = passages.open_windows(texts, [[{"start_word": 10, "end_word": 60}], []])
    assert Counter(doc.tolist()) == {0: 19, 1: 21}


def test_chain_scores():
    best = passages.chain([(0, 0, 10), (12, 12, 10), (5, 40, 6), (24, 30, 10)])
    assert best[0] == [(0, 0, 10), (12, 12, 10), (24, 30, 10)]
    assert best[1] == [(5, 40, 6)]


def test_common_words():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert passages.common_words(a, b) == best[-1][-1]


def test_pairs_compared_together():
    """Texts and pivots that are hashed and matched at once give what each pair gives alone."""
    r = random.Random(5)
    stock = [words(600 + k, 60) for k in range(4)]
    made = lambda: sum((r.choice([*stock, words(r.randrange(700, 900), 30), ["a", "b"] * 9]) for _ in range(r.randrange(6))), [])
    pivots, texts = ([" ".join(made()) for _ in range(n)] for n in (7, 60))
    which = [r.randrange(7) for _ in texts]
    alone = [(t, *f[1:]) for t, p in enumerate(which) for f in passages.passages(pivots[p], [texts[t]])]
    assert len(alone) > 20
    assert passages.passages_of(pivots, texts, np.array(which)) == alone


def test_neighbours(spark):
    """Across ranges and batches too, and where an id has a digest in several rows."""
    r = random.Random(6)
    rows = [(r.randrange(4000), r.choice([3, 3, 3, r.randrange(2000)]), r.randrange(1, 4)) for _ in range(20_000)]
    least, n = {}, Counter()
    for i, digest, k in rows:
        least.setdefault(digest, {}).setdefault(i, 0)
        least[digest][i] += k
    want = []
    for own in least.values():
        own = sorted(own.items())
        want += [(a[0], b[0], min(a[1], b[1])) for a, b in zip(own, own[1:], strict=False)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = passages.neighbours(spark.createDataFrame(rows, "id long, digest long, n long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])
    assert Counter(tuple(x) for x in got) == Counter(want)
    assert passages.neighbours(spark.createDataFrame([], "id string, digest long, n long")).count() == 0


def test_single_seeds_are_not_shuffled(spark, monkeypatch):
    """The seeds that one document has go no further than the task that makes them, also where
    nothing is broadcast."""
    for m in (common, passages):
        monkeypatch.setattr(m, "broadcast_if_small", lambda df, limit=None: df)
    docs = table(spark, [(k, " ".join(words(31, 60) + words(400 + k, 200))) for k in range(20)]).select(F.col("doc_id").alias("id"), "text")
    kept, repeated = passages.repeated_seeds(docs)
    assert "Exchange" not in repeated(docs)._jdf.queryExecution().executedPlan().toString()
    every = passages.seed_table(docs)
    want = {tuple(r) for r in every.join(every.groupBy("digest").count().where("count > 1"), "digest").select("id", "digest", "n").collect()}
    got = {tuple(r) for r in kept.collect()}
    assert want <= got and len(got) < 1.2 * len(want) < every.count() / 2
