"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes find the n-grams that occur twice or more in
a document; the characters inside them, and inside repeated lines, over all characters
of words, say how much of the text repeats itself. The contract's base columns come from
the same scan. Each document is judged by its own whole text: no shuffle, no state.

Cases: a null or empty text has no words and fails; repeated rows are judged alike; further
columns are never looked at; a very long text is scanned as a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import map_arrow, plain_columns
from .textscan import Scan, blocks, mix, windows

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_chars double, dup_ngram_chars double, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. ``coverage``: n-gram length and the largest share of word
    characters that may lie in duplicated n-grams of that length. The first of the copies counts as well, so
    that a short clean text that says one line twice has up to 0.28."""

    min_words: int = 50
    max_repeat_words_pct: int = 50
    coverage: tuple[tuple[int, float], ...] = ((5, 0.40), (6, 0.38), (7, 0.36), (8, 0.34), (9, 0.32), (10, 0.30))
    max_dup_line_chars: float = 0.30
    max_symbols_per_word: float = 0.10
    mean_word: tuple[float, float] = (2.0, 14.0)


def duplicated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows have a hash that its document holds twice or more."""
    keyed = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(twice, keyed), len(twice) - 1)
    return twice[at] == keyed


def covered(first_words: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in one of the windows given by their first words."""
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, first_words, 1)
    np.add.at(depth, first_words + n, -1)
    return np.cumsum(depth[:-1]) > 0


def judge(texts: list[str], rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The columns of SCHEMA without doc_id, for a block of texts."""
    scan, n_docs = Scan(texts, alnum=False), len(texts)
    words, doc, total = scan.hashes(), scan.doc, len(scan.starts)
    sizes = scan.ends - scan.starts
    per_doc = lambda x, mask=slice(None): np.bincount(doc[mask], x[mask], n_docs).astype(np.int64)
    ones = np.ones(total, np.int64)
    n_words, word_chars = per_doc(ones), per_doc(sizes)
    symbol = np.isin(scan.cps, np.array([ord(c) for c in SYMBOLS], np.uint32))
    n_symbols = np.add.reduceat(symbol.astype(np.int64), scan.starts_of_docs)

    h3, at3 = windows(words, doc, 3)
    again3 = np.zeros(total + 16, bool)
    again3[at3[duplicated(h3, doc[at3])]] = True
    repeat_words = covered(np.flatnonzero(again3), 3, total)
    n_repeat = per_doc(ones, repeat_words)

    share, bad = np.zeros(n_docs), np.zeros(n_docs, bool)
    for n, limit in rules.coverage:
        # An n-gram occurs twice only if each 3-gram in it does: few windows are left to sort.
        h, at = windows(words, doc, n)
        likely = np.logical_and.reduce([again3[at + k] for k in range(n - 2)]) if len(at) else np.zeros(0, bool)
        h, at = h[likely], at[likely]
        inside = covered(at[duplicated(h, doc[at])], n, total)
        part = per_doc(sizes, inside) / np.maximum(word_chars, 1)
        share = np.maximum(share, part)
        bad |= part > limit

    n_dup, dup_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs)
    for d, text in enumerate(texts):
        if "\n" in text:
            seen: set[str] = set()
            for line in text.split("\n"):
                if line in seen:
                    n_dup[d] += 1
                    dup_chars[d] += len(line) - sum(map(line.count, SPACES))
                elif line.strip(SPACES):
                    seen.add(line)
    dup_share = dup_chars / np.maximum(word_chars, 1)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_words_pct * n_words)
    mean = word_chars / np.maximum(n_words, 1)
    bad |= (dup_share > rules.max_dup_line_chars) | (n_symbols > rules.max_symbols_per_word * n_words) | (mean < rules.mean_word[0]) | (mean > rules.mean_word[1])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed, "dup_line_chars": dup_share, "dup_ngram_chars": share, "kept": ~base_failed & ~bad}


def _judged(texts: list[str | None], rules: Rules) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    whole = [t or "" for t in texts]
    for i, j in blocks(whole):
        yield i, j, judge(whole[i:j], rules)


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, found in _judged(batch.column(1).to_pylist(), rules):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, found.values())], names=["doc_id", *found])

    return map_arrow(plain_columns(docs, doc_id=id_col, text=text_col), run, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in _judged(batch.column(at).to_pylist(), rules):
                yield batch.slice(i, j - i).filter(pa.array(found["kept"]))

    return map_arrow(docs, run, docs.schema)
