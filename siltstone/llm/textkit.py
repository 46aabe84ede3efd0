"""Vectorised words, word hashes and word n-grams over blocks of whole texts.

A block joins the UTF-8 bytes of some texts with spaces. Words are runs of word bytes, each
gets a 64-bit hash, and n-grams combine the hashes of neighbours. Nothing here works on
prefixes: a text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
_STEP = np.uint64(0x2545F4914F6CDD1D)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a block of texts: ``doc`` (index of the text in the block), ``start`` and ``end``
    (bytes in the block), ``hash``; ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool = True) -> None:
        self.texts = texts
        joined = b" ".join(texts)
        if lower:
            joined = joined.lower()  # bytes: A-Z alone
        self.data = data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = np.frombuffer(joined.translate(word_bytes.astype(np.uint8).tobytes()), dtype=bool)
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.offset[1:])
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes(joined)

    def _hashes(self, joined: bytes) -> np.ndarray:
        """Eight bytes of each word at a time; later rounds see the words that are left. What a word
        has beyond its first 64 bytes is hashed at once."""
        padded = joined + bytes(8)
        eights = np.ndarray(len(joined) + 1, dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        h = mix((eights[self.start] & _FIRST[np.minimum(size, 8)]) * _STEP + size.astype(np.uint64))
        left, at = np.flatnonzero(size > 8), 8
        while len(left) and at < 64:
            more = eights[self.start[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]
            h[left] = mix(h[left] * _STEP + more)
            at += 8
            left = left[size[left] > at]
        for k in left:
            rest = hashlib.blake2b(joined[self.start[k] + at : self.end[k]], digest_size=8).digest()
            h[k] = mix(h[k : k + 1] * _STEP + np.frombuffer(rest, dtype="<u8"))[0]
        return h

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every n-gram inside a text."""
        count = len(self) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = self.hash[:count]
        for j in range(1, n):
            h = mix(h * _STEP + self.hash[j : j + count])
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return h[at], at


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about BLOCK bytes as (index of the first, their UTF-8 bytes)."""
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > BLOCK:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def gram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block (index of its first text, hashes, bounds): hashes[bounds[d]:bounds[d+1]] are
    the sorted distinct n-word shingles of text d, over words of NOT_SPACE bytes with A-Z
    lower-cased. A text of fewer words than n has its whole sequence as its one shingle; a text
    without words, or null, has none."""
    for first, run in blocks(texts):
        w = Words(run, NOT_SPACE)
        h, at = w.grams(n)
        bounds = np.searchsorted(at, w.first)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = h[1:] != h[:-1]
        keep[bounds[:-1][np.diff(bounds) > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
        h = h[keep]
        short = np.flatnonzero((np.diff(bounds) == 0) & (np.diff(w.first) > 0))
        if len(short):
            own = []
            for d in short:
                words = w.hash[w.first[d] : w.first[d + 1]]
                g = np.array([len(words)], dtype=np.uint64)
                for x in words:
                    g = mix(g * _STEP + x)
                own.append(g[0])
            h = np.insert(h, kept[short], np.array(own, dtype=np.uint64))
            more = np.zeros(len(kept), dtype=np.int64)
            more[short + 1] = 1
            kept = kept + np.cumsum(more)
        yield first, h, kept


def shingle_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct n-word shingle hashes) of each text, as gram_sets has them."""
    for first, h, bounds in gram_sets(texts, n):
        for d in range(len(bounds) - 1):
            yield first + d, h[bounds[d] : bounds[d + 1]]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run values[bounds[d]:bounds[d+1]], modulo 2^64; 0 of an empty run."""
    upto = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=upto[1:])
    return upto[bounds[1:]] - upto[bounds[:-1]]
