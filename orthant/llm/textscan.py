"""Vectorised scanning of texts with numpy: words, word hashes and shingles.

Texts are taken in blocks of about ``MAX_CHARS`` characters (a longer text is a
block of its own), laid end to end as code points, so that the cost per document is
a few numpy calls and memory stays bounded by the block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np

MAX_CHARS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the usual block size."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, MAX_CHARS + (1 << 17))
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= MAX_CHARS + (1 << 17):
            _powers[int(base)] = known
    return known[:n]


@cache
def word_table() -> np.ndarray:
    """For every code point, whether it is a letter, digit or mark of a word."""
    table = np.zeros(sys.maxunicode + 2, bool)
    for start in range(0, sys.maxunicode + 1, 1 << 16):
        for c in range(start, min(start + (1 << 16), sys.maxunicode + 1)):
            if chr(c).isalnum():
                table[c] = True
    table[0x300:0x370] = True  # combining marks
    return table


def blocks(texts: list[str], max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts are about ``max_chars`` long together."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > max_chars:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Scan:
    """The words of a block of documents.

    ``alnum``: words are maximal runs of letters and digits of the lower-cased text
    (punctuation and layout don't matter); else maximal runs of ``[^\\x20\\x09-\\x0D]``.
    ``first[d] .. first[d + 1]`` are the words of document d.
    """

    def __init__(self, texts: list[str], alnum: bool):
        if alnum:
            texts = [t.lower() for t in texts]
        self.cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends_of_docs = np.cumsum(sizes)
        self.starts_of_docs = self.ends_of_docs - sizes
        c = self.cps
        self.is_word = word_table()[c] if alnum else ~((c == 0x20) | ((c >= 9) & (c <= 13)))
        edge = np.flatnonzero(np.diff(self.is_word, prepend=False))
        self.starts, self.ends = edge[::2], edge[1::2]  # the last character is a separator
        self.first = np.searchsorted(self.starts, np.append(self.starts_of_docs, len(c)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a rolling polynomial."""
        n = len(self.cps)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.cps.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(INVERSE, n)[self.starts])


def windows(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one document, and their first words. The hash rolls:
    a window's polynomial is the difference of two prefix sums, whatever its length."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mix((sums[at + n] - sums[at]) * powers(INVERSE, len(words))[at] + np.uint64(n)), at


def shingles(scan: Scan, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles with their documents, in order of documents. A text of
    fewer than n words (but at least one) is one shingle by itself."""
    words = scan.hashes()
    h, at = windows(words, scan.doc, n)
    doc = scan.doc[at]
    counts = np.diff(scan.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = [windows(words[scan.first[d] : scan.first[d + 1]], np.zeros(counts[d], int), int(counts[d]))[0][0] for d in short]
        h, doc = np.append(h, np.array(own, np.uint64)), np.append(doc, short)
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc
