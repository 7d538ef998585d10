"""The prefix trie, against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from tickloom.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    """Nodes of ``(conv_id, turn, role, text)`` rows, from plain dictionaries."""
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in by.items()}
    convs = own
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        convs = {c: own.get(c - c % 20, [])[: heads[c]] + turns[heads[c] :] for c, turns in own.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if len(q) > len(p) and q[: len(p)] == p] for p in members}
    out = []
    for p, who in members.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        tree = [p, *below[p]]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in tree if q)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children), sum(not below[q] for q in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def nodes(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, path string, words int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def some_rows(seed, n=60):
    """Few texts, so that many prefixes are shared, copies, ties, nulls and gaps."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c\td e"])) for _ in range(rng.choice([1, 2, 3, 7]))]
        if rng.random() < 0.3 and rows:
            other = rng.choice(rows)[0]
            turns = [r[2:4] for r in rows if r[0] == other]
        for i, (role, text) in enumerate(turns):
            rows.append((c, None if i == 0 and rng.random() < 0.3 else i * rng.choice([1, 1, 1, 0]), role, text))
    rows += [(None, 1, "user", "nobody's"), rows[0], (-40, 0, "user", "a"), (10**15, 0, "user", "a")]
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 10**6), (2, 60), (3, 15)])
def test_nodes(spark, seed, limit):
    """With everything in one group, and with most nodes merged by Spark over rounds."""
    rows = some_rows(seed)
    convs = prefix_trie.sequences(table(spark, rows))
    assert nodes(prefix_trie.trie(convs, limit)) == brute(rows, rebuild=False)


def test_rebuilt(spark):
    rows = [r for r in some_rows(5, 90) if r[0] != -40]
    convs = prefix_trie.rebuilt(prefix_trie.sequences(table(spark, rows)))
    assert nodes(prefix_trie.trie(convs, 30)) == brute(rows)


def test_long_and_hot(spark):
    """A third of all conversations are copies, a third share all turns but the last, and
    one has hundreds of turns."""
    rows = [(c, i, "user", f"t {i}") for c in range(40) for i in range(5)]
    rows += [(100 + c, i, "user", f"t {i}" if i < 4 else f"own {c}") for c in range(40) for i in range(5)]
    rows += [(7000 + c, 0, "user", "alone " * c) for c in range(40)]
    rows += [(9000, i, "user", "x" * (i % 7)) for i in range(400)]
    rows += [(9001, 0, "user", "word " * 200_000)]
    convs = prefix_trie.sequences(table(spark, rows))
    got, want = nodes(prefix_trie.trie(convs, 60)), brute(rows, rebuild=False)
    assert got == want


def test_one_conversation_and_none(spark):
    rows = [(3, 0, "user", "a")]
    assert nodes(prefix_trie.trie(prefix_trie.sequences(table(spark, rows)))) == brute(rows, rebuild=False)
    assert prefix_trie.trie(prefix_trie.sequences(table(spark, []))).count() == 0


def test_turnless(spark):
    """A conversation whose turns all go is still a member of the root."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b"), (20, 0, "user", "z")]
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, rows))))) == brute(rows)
