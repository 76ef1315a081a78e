"""Word shingles of UTF-8 texts: by 128-bit hashes of their words, and, to compare texts exactly, by numbers of their words."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd

from speckle.llm._common import mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are cut into words in pieces of about so many bytes; a worker forgets the words it has hashed beyond so many, or so many bytes of them.
PIECE, CACHE_WORDS, CACHE_BYTES = 1 << 20, 400_000, 32 << 20


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    r = 0xD1342543DE82EF95
    out = []
    for x in (r, pow(r, -1, 1 << 64)):
        p = np.full(n, np.uint64(x))
        p[:1] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def pieces(text: bytes):
    """text cut at white space into pieces of about PIECE bytes; a longer word is one."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and not (near := SPACE[np.frombuffer(text, np.uint8, min(4096, len(text) - hi), hi)]).any():
            hi += len(near)
        hi = len(text) if hi >= len(text) else hi + int(near.argmax())
        yield text[lo:hi]
        lo = hi


class _Table:
    """Words that a worker has met, each with 128 bits of BLAKE2b."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.hashes, self.size = np.empty((1 << 12, 2), np.uint64), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if new := set(words).difference(known):
            lo = len(known)
            for w in new:
                known[w] = len(known)
                self.size += len(w)
            while len(self.hashes) < len(known):
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            self.hashes[lo : len(known)] = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in new), "<u8").reshape(-1, 2)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


_table = _Table()


def forget() -> None:
    """Frees the words of this worker, which lives on when its task ends."""
    _table.clear()


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of every word, A-Z as a-z, (words, 2), and the number of words of each text.

    Words are runs without ASCII white space.
    """
    if len(_table.known) > CACHE_WORDS or _table.size > CACHE_BYTES:
        _table.clear()
    numbers, counts = [np.zeros(0, np.int64)], np.zeros(len(ends) - 1, np.int64)
    for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        for piece in pieces(raw[lo:hi].tobytes().lower()):
            numbers.append(_table.numbers(piece.split()))
            counts[i] += len(numbers[-1])
    return _table.hashes[np.concatenate(numbers)], counts


def _distinct(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """(n, 2) distinct pairs, sorted."""
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    same = h[1:] == h[:-1]
    if (g[1:][same] != g[:-1][same]).any():
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    keep = np.concatenate([[True], ~same])[: len(h)]
    return np.stack([h[keep], g[keep]], 1)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes, (n, 2), of the k-word shingles of each text; of fewer words, that of the whole sequence."""
    w, counts = words(raw, ends)
    a, b = w[:, 0].copy(), w[:, 1].copy()
    h, g = a[: max(0, len(a) - k + 1)].copy(), b[: max(0, len(a) - k + 1)].copy()
    for j in range(1, k):
        h, g = mix(h * ODD + a[j : len(a) - k + 1 + j]), mix(g * OTHER + b[j : len(a) - k + 1 + j])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(_distinct(h[at : at + n - k + 1], g[at : at + n - k + 1]))
        elif n:
            x, y = a[at : at + 1].copy(), b[at : at + 1].copy()
            for j in range(1, n):
                x, y = mix(x * ODD + a[at + j]), mix(y * OTHER + b[at + j])
            out.append(np.stack([mix(x + np.uint64(n)), mix(y + np.uint64(n))], 1))
        else:
            out.append(np.zeros((0, 2), np.uint64))
        at += n
    return out


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted numbers of the distinct k-word shingles of each text; equal shingles of these texts, and no others, have equal numbers.

    Windows are numbered by the numbers of shorter ones. Sequences of fewer than k words have negative numbers.
    """
    known: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    ids, counts, few = [np.zeros(0, np.int64)], [], {}
    for i, t in enumerate(texts):
        n = 0
        for piece in pieces(t.lower()):
            ws = piece.split()
            for w in set(ws).difference(known):
                known[w] = len(known)
            ids.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
            n += len(ws)
        counts.append(n)
        if 0 < n < k:
            few[i] = short.setdefault(tuple(t.lower().split()), -1 - len(short))
    w = np.concatenate(ids)
    x, size = w, 1
    while size < k and len(w) >= k:
        more = min(size, k - size)
        a, b = x[:-more], x[more:]
        x, size = pd.factorize(a * (int(b.max()) + 1) + b)[0], size + more
    out, at = [], 0
    for i, n in enumerate(counts):
        out.append(np.unique(x[at : at + n - k + 1]) if n >= k else np.array([few[i]] if n else [], np.int64))
        at += n
    return out
