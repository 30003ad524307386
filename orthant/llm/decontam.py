"""Benchmark decontamination: size-partitioned MinHash containment search, then exact checks.

A short item inside a long document has a tiny Jaccard similarity to it, so documents are put
in classes by their number of distinct five-word shingles, and each class has a MinHash of its
own length: one-permutation hashing with ``BINS_PER_SHINGLE`` bins for each shingle of the
class's upper bound. Every bin keeps the least value that falls in it. A contained
shingle is then its bin's minimum with a probability of at least ``1 - 1/(2*BINS_PER_SHINGLE)``
whatever the document's length, and the cost is linear. A document and an item are a candidate pair
if a bin has the same minimum in both. An item of few shingles gets several permutations, as many as bring
the chance that all its shingles are missed below ``MISS``; for 10 shingles and more that is one.

A candidate pair is verified by exact shingle containment: of the item's distinct shingles (as
words, not hashes) at least ``threshold`` lie in the document.

Scale: documents are scanned where they are read, and never shuffled. Different texts of items come in
blocks of about ``BLOCK_CHARS`` characters, each of which is broadcast (24 bytes a shingle in a worker)
and has a scan of its own, so memory is bounded however many items there are; equal texts
under many ids are one text until ids are joined to what was found.

Cases: words are runs of letters and digits, lower-cased. An item of fewer than five words is
one shingle of all its words, sought among the documents' windows of that length. Null, empty or
wordless texts match nothing. Repeated rows give repeated pairs only once; further columns are
never looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow, materialize, plain_columns, shared_dir
from .textscan import Scan, blocks, mix, windows

WORDS, THRESHOLD = 5, 0.8
BINS_PER_SHINGLE, MISS = 4, 1e-9
BLOCK_CHARS = 24_000_000
FOUND = "doc_id long, k1 long, k2 long, n_shared long, n_item long"
_SEED = 0x9E3779B97F4A7C15


def word_list(text: str | None) -> list[str]:
    scan = Scan([text or ""], alnum=True)
    whole = scan.cps.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(scan.starts, scan.ends, strict=True)]


def shingle_set(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def bins_of(size_class: int) -> np.uint64:
    """Bins of the documents with at most 2**size_class shingles."""
    return np.uint64(BINS_PER_SHINGLE << size_class)


def permuted(h: np.ndarray, turn: int) -> np.ndarray:
    return mix(h ^ np.uint64(_SEED * (turn + 1) & 0xFFFFFFFFFFFFFFFF))


def bin_minima(h: np.ndarray, bins: np.uint64, turn: int = 0) -> np.ndarray:
    """One-permutation MinHash: the hash with the least value in each bin that isn't empty."""
    value = permuted(h, turn)
    where = mix(value) % bins
    order = np.lexsort((value, where))
    first = np.flatnonzero(np.diff(where[order], prepend=np.uint64(1 << 63)) != 0)
    return h[order][first]


class Items:
    """A block of different texts. Their shingles are kept as one sorted list a length; which of them are an
    item's minima in a class is found when a document's minimum meets one."""

    def __init__(self, texts: list[str], threshold: float):
        self.texts, self.threshold = texts, threshold
        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, j in blocks(texts):
            scan = Scan(texts[i:j], alnum=True)
            words, length = scan.hashes(), np.minimum(np.diff(scan.first), WORDS)
            for n in set(length[length > 0].tolist()):
                h, at = windows(words, scan.doc, n)
                mine = length[scan.doc[at]] == n
                own.setdefault(n, []).append((h[mine], scan.doc[at][mine] + i))
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.of_item: dict[int, np.ndarray] = {}
        self.turns = np.zeros(len(texts), np.int64)
        self.most: dict[int, int] = {}
        self.sizes = np.zeros(len(texts), np.int64)
        for n, parts in own.items():
            h, item = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.lexsort((h, item))
            h, item = h[order], item[order]
            new = (np.diff(h, prepend=np.uint64(0)) != 0) | (np.diff(item, prepend=-1) != 0)
            h, item = h[new], item[new]
            some, start, count = np.unique(item, return_index=True, return_counts=True)
            kept = np.ceil(threshold * count - 1e-9)
            self.turns[some] = np.maximum(1, np.ceil(math.log(MISS) / (kept * math.log(1 / (2 * BINS_PER_SHINGLE))))).astype(np.int64)
            self.most[n] = int(self.turns[some].max())
            self.of_item.update(zip(some.tolist(), np.split(h, start[1:]), strict=True))
            order = np.argsort(h, kind="stable")
            self.own[n] = h[order], item[order]
        self.set_of = lru_cache(4096)(lambda x: shingle_set(w := word_list(self.texts[x]), min(WORDS, len(w))))

    def candidates(self, h: np.ndarray, n: int) -> set[int]:
        """Items that have a bin's minimum in common with a document of the distinct shingle hashes h."""
        found: set[int] = set()
        theirs, item = self.own[n]
        bins = bins_of(max(0, int(len(h) - 1).bit_length()))
        for turn in range(self.most[n]):
            mine = bin_minima(h, bins, turn)
            lo, hi = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, "right")
            hit = np.flatnonzero(hi > lo)
            for k in hit.tolist():
                for x in item[lo[k] : hi[k]].tolist():
                    if x not in found and turn < self.turns[x] and self._is_minimum(x, mine[k : k + 1], bins, turn):
                        found.add(x)
        return found

    def _is_minimum(self, item: int, h: np.ndarray, bins: np.uint64, turn: int) -> bool:
        """Whether h, of the item's shingles, is its bin's minimum."""
        value, least = permuted(self.of_item[item], turn), permuted(h, turn)
        return not ((mix(value) % bins == mix(least) % bins) & (value < least)).any()

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, shared shingles, the item's shingles) of true containments."""
        scan = Scan(texts, alnum=True)
        words = scan.hashes()
        near: dict[int, set[int]] = {}
        for n in self.own:
            h, at = windows(words, scan.doc, n)
            cut = np.searchsorted(scan.doc[at], np.arange(len(texts) + 1))
            for d in range(len(texts)):
                if cut[d + 1] > cut[d] and (got := self.candidates(np.unique(h[cut[d] : cut[d + 1]]), n)):
                    near.setdefault(d, set()).update(got)
        for d, items in near.items():
            own_words, sets = word_list(texts[d]), {}
            for x in sorted(items):
                wanted = self.set_of(x)
                n = len(next(iter(wanted)))
                if n not in sets:
                    sets[n] = shingle_set(own_words, n)
                shared = len(wanted & sets[n])
                if shared >= self.threshold * len(wanted) - 1e-9:
                    yield d, x, shared, len(wanted)


_signed: dict[str, Items] = {}


def _signed_block(name: str, texts: list[str], threshold: float) -> Items:
    """The block's items; a Python worker keeps the last block for its next task."""
    if name not in _signed:
        _signed.clear()
        _signed[name] = Items(texts, threshold)
    return _signed[name]


def _item_blocks(items: DataFrame) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """A name and the different texts with two hashes, in blocks of bounded size, dealt by the first."""
    rows = items.where("text is not null").select("text", *_keys()).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(n):
        part = rows.where(F.pmod("k1", F.lit(n)) == k).collect()
        if part:
            yield uuid.uuid4().hex, sorted(tuple(r) for r in part)


def _keys() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2")]


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each (document, item) with the item's shingles in the document: doc_id, item_id, n_shared,
    n_item, containment."""
    texts = plain_columns(docs, doc_id=id_col, text=text_col)
    asked = plain_columns(items, item_id=item_id_col, text=item_text_col)
    spark, out = docs.sparkSession, docs.sparkSession.createDataFrame([], FOUND)
    for name, block in _item_blocks(asked):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            block = shared.value
            signed = _signed_block(name, [b[0] for b in block], threshold)
            for batch in batches:
                ids, whole = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for i, j in blocks(whole):
                    rows = [(ids[i + d], *block[x][1:], a, b) for d, x, a, b in signed.matches(whole[i:j])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "k1", "k2", "n_shared", "n_item"])

        out = out.union(map_arrow(texts, run, FOUND))
    ids = asked.where("text is not null").select("item_id", *_keys()).distinct()
    return out.distinct().join(ids, ["k1", "k2"]).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose texts hold no benchmark item. Each row is judged
    where it is read, so nothing is shuffled and ids may be null; what passes a block of items is written
    before the next block, so that a worker holds one block."""
    at, spark, folder = docs.columns.index(text_col), docs.sparkSession, None
    for k, (name, block) in enumerate(_item_blocks(plain_columns(items, item_id=item_id_col, text=item_text_col))):
        if k:
            folder = folder or shared_dir(spark)
            docs = materialize(docs, folder, f"clean-{k}")
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            signed = _signed_block(name, [b[0] for b in shared.value], threshold)
            for batch in batches:
                whole = [t or "" for t in batch.column(at).to_pylist()]
                for i, j in blocks(whole):
                    clean = np.ones(j - i, bool)
                    clean[[d for d, *_ in signed.matches(whole[i:j])]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        docs = map_arrow(docs, run, docs.schema)
    return docs
