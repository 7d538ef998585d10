"""Packing and tokenizer alignment, against brute force with the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import alignment, byte_bpe, packing, sentence_pieces

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a  b ", "\n\n\tx\r\n", "word", "word", "don't we'll 12345 !!!", "naïve Ünïcode 漢字 \U0001f600", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "has ▁ the mark", "\x00nul\x01", "​zero ﻿width", "x" * 50_000, " " * 3_000 + "end", "\n" * 3_000, "ab " * 40_000,
]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(byte_bpe.MODEL)


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 5 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, part int")


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_byte_bpe_is_the_library(byte_level):
    bpe = byte_bpe.loaded(open(byte_bpe.MODEL, "rb").read())
    rng = random.Random(1)
    alphabet = "ab c\n\té漢!1'　\U0001f600"
    texts = [t for t in ODD if t] + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert bpe.ids(t, special=True).tolist() == byte_level.encode(t, add_special_tokens=False).ids
    plain = bpe.ids("<|endoftext|>")
    assert len(plain) > 1 and b"".join(bpe.tokens[int(i)].as_py() for i in plain) == b"<|endoftext|>"


# Packing


@pytest.mark.parametrize("size", [2, 3, 8, 16, 31])
def test_plan(size):
    rng = random.Random(size)
    for _ in range(40):
        counts = {n: rng.choice([0, 0, 1, 2, 5, 17]) for n in range(1, size)}
        chosen = packing.plan(counts, size)
        places, sequences = packing.Places(np.array(chosen.rows, np.int64).reshape(-1, 9)), {}
        for n, c in counts.items():
            for rank in range(c):
                at = 0
                for start, take, sequence, offset in sorted(places.of(n, rank)):
                    assert start == at and take > 0
                    at += take
                    sequences.setdefault(sequence, []).append((offset, take))
                assert at == n
        check_sequences(sequences, size)


def check_sequences(sequences, size):
    """Gapless, and full or a power of two."""
    short = []
    for pieces in sequences.values():
        at = 0
        for offset, take in sorted(pieces):
            assert offset == at
            at += take
        assert at == size or at < size and at & (at - 1) == 0
        short += [at] * (at < size)
    assert len(short) == len(set(short))


def test_fullest_is_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 7))}
        uses, gap = packing.fullest(counts, 41)
        items = [n for n, c in counts.items() for _ in range(c)]
        items.remove(max(items))
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        assert gap == min(41 - max(counts) - s for s in sums if s <= 41 - max(counts))
        assert uses[max(counts)] >= 1 and all(u <= counts[n] for n, u in uses.items()) and sum(n * u for n, u in uses.items()) == 41 - gap


def test_plan_does_not_grow_with_the_counts():
    chosen = packing.plan({n: 10**9 + n * 7919 % 10**6 for n in range(1, 256)}, 256)
    assert len(chosen.rows) < 3000


def packed_well(rows, wanted, size):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    check_sequences(sequences, size)
    got = Counter()
    for doc, pieces in by.items():
        # Repeated ids: a piece that starts at 0 begins the next of their rows.
        for r in pieces:
            got[doc, r["start"], r["length"], r["doc_tokens"]] += 1
    for doc in by:
        assert sum(length * n for (d, _, length, _), n in got.items() if d == doc) == sum(map(len, wanted[doc]))
    assert set(by) == set(wanted)


def test_pack_odd_texts(spark, byte_level):
    texts = [t for t in ODD if t != "x" * 50_000]
    rows = packing.pack(frame(spark, texts), size=64).collect()
    wanted = {}
    for i, t in enumerate(texts):
        wanted.setdefault(None if i == 5 else i // 2, []).append([*byte_level.encode(t or "", add_special_tokens=False).ids, 1])
    packed_well(rows, wanted, 64)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert any(ids == w[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(w) for w in wanted[r["doc_id"]])


def test_pack_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_op13(spark, byte_level):
    rows = packing.op13_packing(spark, SF).collect()
    wanted = {d: [[*byte_level.encode(t or "", add_special_tokens=False).ids, 1]] for d, t in documents(spark)}
    packed_well(rows, wanted, 2048)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = wanted[r["doc_id"]][0]
        assert r["start"] == ends.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        ends[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : ends[r["doc_id"]]], "<u4").tobytes())
    assert sum(ends.values()) == sum(len(w[0]) for w in wanted.values())


# Alignment


def brute_alignment(texts, byte_level):
    """(digest columns) per text, by plain loops over the libraries' own tokens."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    byte_level.encode_special_tokens = True
    letters = byte_bpe._letters()
    groups = []
    for t in texts:
        own = []
        if t:
            said = byte_level.encode(" " + t, add_special_tokens=False)
            a_ids, a_tokens = said.ids, said.tokens
            b = pieces.encode(t)
            a_bytes = [bytes(letters[c] for c in x) for x in a_tokens]
            b_bytes = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == f" {t}".encode():
                ends = []
                for side in (a_bytes, b_bytes):
                    at, e = 0, []
                    for x in side:
                        at += len(x)
                        e.append(at)
                    ends.append(e)
                common, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
                for e in common:
                    p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
                    own.append((a_ids[i:p], b[j:q]))
                    i, j = p, q
        groups.append(own)
    byte_level.encode_special_tokens = False
    count = Counter((x[-1], y[-1]) for own in groups for x, y in own)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for own in groups:
        links = [(x[-1], y[-1]) for x, y in own]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        sha = hashlib.sha256(said.encode()).hexdigest() if own else ""
        out.append((sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(own), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return out


def columns(rows):
    return sorted(map(repr, ((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)))


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_align_odd_texts(spark, byte_level, monkeypatch, block):
    monkeypatch.setattr(alignment, "PAIR_BLOCK", block)
    docs = frame(spark, ODD)
    aligned = alignment.align(docs).persist()
    got = columns(alignment.scored(aligned, alignment.pair_counts(aligned)).collect())
    aligned.unpersist()
    want = [(None if i == 5 else i // 2, *w) for i, w in enumerate(brute_alignment(ODD, byte_level))]
    assert got == sorted(map(repr, want))


def test_align_nothing(spark):
    aligned = alignment.align(frame(spark, []))
    assert alignment.scored(aligned, alignment.pair_counts(aligned)).count() == 0


def test_align_block_is_the_whole_encoder(byte_level):
    """Words encoded once each give the ids of whole texts."""
    a, b = byte_bpe.loaded(open(byte_bpe.MODEL, "rb").read()), alignment._pieces(open(sentence_pieces.MODEL, "rb").read())
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé ie  rstn\nü.漢", k=rng.randint(1, 60))) for _ in range(400)]
    (_, ids), (_, counts, _) = alignment.align_block(texts, a, b)
    ids &= ~alignment.LAST
    for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == b.core.whole.encode(t)


def test_op12(spark, byte_level):
    docs = documents(spark)
    want = [(d, *w) for (d, _), w in zip(docs, brute_alignment([t for _, t in docs], byte_level), strict=True)]
    assert columns(alignment.op12_alignment(spark, SF).collect()) == sorted(map(repr, want))
