"""Word hashes of whole texts straight from Arrow's buffers, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(GOLDEN), -1, 2**64))
_FIRST, _SECOND = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PAD = _U(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _FIRST
    x = (x ^ (x >> _U(27))) * _SECOND
    return x ^ (x >> _U(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
#: Bytes of which the powers are kept from call to call.
_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, min(_KEPT, 2 * n)), base)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= _KEPT:
            _powers[int(base)] = have
    return have[:n]


def as_strings(texts: pa.Array | pa.ChunkedArray | Sequence[str | None]) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        return texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def utf8(texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the places where each starts and the last ends; a
    null is empty."""
    texts = as_strings(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes, or of one text."""
    _, at = utf8(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, end
        start = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and first and last places (exclusive) of all."""
    n = len(data)
    if not n:
        return np.zeros(len(at) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    said = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = said[:-1]
    starts = np.flatnonzero(said & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = said[1:]
    ends = np.flatnonzero(said & (~after | edge[1:])) + 1
    return np.diff(np.searchsorted(starts, at)), starts, ends


def word_hashes(texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and 64-bit hashes of all words in order."""
    data, at = utf8(texts)
    sizes, starts, ends = word_bounds(data, at)
    if not len(starts):
        return sizes, np.zeros(0, np.uint64)
    # Polynomials of mixed bytes: a word's is the difference of two prefix sums.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(powers(GOLDEN, len(data)), _BYTES[data], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    word = sums[ends] - sums[starts]
    del sums
    return sizes, mixed(word * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def padded(sizes: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of one to ``width - 1`` words get that many words."""
    short = (sizes > 0) & (sizes < width)
    if not short.any():
        return sizes, h
    wide = np.where(short, width, sizes)
    out = np.full(int(wide.sum()), _PAD)
    shift = np.repeat((np.cumsum(wide) - wide) - (np.cumsum(sizes) - sizes), sizes)
    out[np.arange(len(h)) + shift] = h
    return wide, out


def window_hashes(sizes: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of every window of ``width`` words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(h) - width + 1)
    inside = doc[:n] == doc[len(h) - n :] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    out, high = np.full(n, 7, np.uint64), np.empty(n, np.uint64)
    for k in range(width):
        out *= GOLDEN
        out += h[k : k + n]
        # As ``mixed``, in place.
        for shift, factor in ((30, _FIRST), (27, _SECOND), (31, None)):
            np.right_shift(out, _U(shift), out=high)
            out ^= high
            if factor is not None:
                out *= factor
    return doc[at], at - (np.cumsum(sizes) - sizes)[doc[at]], out[at]
