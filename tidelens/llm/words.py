"""Words and shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space for `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_POWERS = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> np.ndarray:
    """1, m, m², … (n of them, modulo 2**64) of an odd multiplier."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS), 256), 0xD6E8FEB86659FD93, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def tokens(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: the joined buffer, starts and lengths in it, and each word's text number."""
    buf = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return buf, starts, ends - starts, np.searchsorted(begins, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its blocks of eight bytes, each mixed with its place, mixed with the length."""
    if not len(starts):
        return np.empty(0, U64)
    padded = np.r_[buf, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    blocks = (lengths + 7) // 8
    firsts = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(firsts, blocks)
    inside = np.minimum(np.repeat(lengths, blocks) - 8 * number, 8)
    values = eight[8 * number + np.repeat(starts, blocks)] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (8 - inside).astype(U64)))
    place = mix((number.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(mix(mix(values ^ place) + place), firsts) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text (the whole sequence where it is shorter), with their text numbers."""
    m = U64(0xA0761D6478BD642F)
    n = len(words)
    runs, owner = np.empty(0, U64), np.empty(0, np.int64)
    if n >= size:
        h = np.zeros(n - size + 1, U64)
        for k in range(size):
            h = h * m + words[k : n - size + 1 + k]
        same = text[: n - size + 1] == text[size - 1 :]
        runs, owner = mix(h[same]), text[: n - size + 1][same]
    counts = np.bincount(text, minlength=n_texts)
    short = (counts > 0) & (counts < size)
    if short.any():
        mine = short[text]
        w, t = words[mine], text[mine]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        place = np.arange(len(t)) - np.repeat(first, np.diff(np.r_[first, len(t)]))
        h = np.add.reduceat(w * np.multiply.accumulate(np.full(size, m, U64))[place], first) + counts[t[first]].astype(U64)
        runs, owner = np.r_[runs, mix(h ^ U64(0x5851F42D4C957F2D))], np.r_[owner, t[first]]
    return runs, owner


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, sorted by owner and value."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], o[keep]
