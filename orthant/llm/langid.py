"""Language identification: averaged hashed subword embeddings and a linear softmax.

Character n-grams (2 to 4, with word edges, lower-cased) are hashed into buckets; a text is
the average of its buckets' embeddings, and a linear layer with softmax gives the language. Both
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``Params.per_lang`` rows a language and ``Params.max_rows`` in all, chosen by hash; of a longer text a
piece of ``Params.piece_chars`` at a place that depends on its hash), on those and on short windows of
them. A temperature, fitted on rows held back from the sample, calibrates the probabilities. A
prediction is marked as rejected below the limit under which ``Params.false_reject`` of the held-back
examples fall, so about that share of texts in a known language is rejected;
``Params.reject_below`` is the limit of models with too few examples to hold any back.

Prediction reads nothing but the text. As the average and the layer are linear, they fold into
one table of buckets x languages, which is all that is sent to the executors (bounded by
``Params.buckets``).

Cases: a null text, or one without a letter, is ``und`` with score 0; repeated rows get the same
answer; without any labelled row every text is ``und``; further columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow, plain_columns
from .textscan import Scan, blocks, mix

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 14
    dim: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    per_lang: int = 700
    epochs: int = 6
    least_steps: int = 1500
    rate: float = 0.5
    batch: int = 32
    window: int = 60
    piece_chars: int = 4000
    max_rows: int = 50_000
    false_reject: float = 0.01
    reject_below: float = 0.5
    seed: int = 7


def bags(texts: list[str], p: Params) -> list[np.ndarray]:
    """For each text the buckets of all its n-grams."""
    out: list[np.ndarray] = []
    for i, j in blocks(texts):
        scan = Scan(texts[i:j], alnum=True)
        c = np.where(scan.is_word, scan.cps, 0).astype(np.uint64)  # every edge of a word is the same sign
        c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(max(p.orders), np.uint64)])
        found, where = [], []
        n = len(scan.cps)
        for order in p.orders:
            h = np.full(n + 1, order, np.uint64)
            inner = np.zeros(n + 1, bool)
            broken = np.zeros(n + 1, bool)
            for k in range(order):
                part = c[k : k + n + 1]
                h = h * np.uint64(0x100000001B3) + part
                inner |= part != 0
                if 0 < k < order - 1:
                    broken |= part == 0
            at = np.flatnonzero(inner & ~broken)
            found.append((mix(h[at]) % np.uint64(p.buckets)).astype(np.int32))
            where.append(np.searchsorted(scan.ends_of_docs, at, "left").clip(max=j - i - 1))
        bounds = [np.searchsorted(w, np.arange(j - i + 1)) for w in where]
        out += [np.concatenate([f[b[d] : b[d + 1]] for f, b in zip(found, bounds, strict=True)]) for d in range(j - i)]
    return out


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, p: Params, limit: float | None = None):
        self.langs, self.table, self.bias, self.p = langs, table, bias, p
        self.limit = p.reject_below if limit is None else limit

    def logits(self, bag: np.ndarray) -> np.ndarray:
        counts = np.bincount(bag, minlength=self.p.buckets).astype(np.float32)
        return counts @ self.table / max(len(bag), 1) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = [t or "" for t in texts]
        has_letter = np.array([any(map(str.isalpha, t)) for t in known], bool)
        pred, score = [UNKNOWN] * len(known), np.zeros(len(known))
        if self.langs:
            for d, bag in enumerate(bags(known, self.p)):
                if has_letter[d]:
                    probs = softmax(self.logits(bag)[None, :].astype(np.float64))[0]
                    best = int(probs.argmax())
                    pred[d], score[d] = self.langs[best], probs[best]
        return pred, score, score < self.limit


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], p: Params = Params()) -> Model:
    """Train on labelled texts held in memory."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((p.buckets, 0), np.float32), np.zeros(0, np.float32), p)
    rng = np.random.default_rng(p.seed)
    label = np.searchsorted(names, langs)
    held = rng.random(len(texts)) < 0.2 if len(texts) >= 50 else np.zeros(len(texts), bool)
    whole = bags(texts, p)
    short = []
    for t in texts:  # windows of the same texts, so that short texts are known as well
        at = int(rng.integers(0, max(1, len(t) - p.window)))
        short.append(t[at : at + int(rng.integers(8, p.window))])
    examples = [(np.unique(b, return_counts=True), y, h, k) for k, group in enumerate((whole, bags(short, p))) for b, y, h in zip(group, label, held, strict=True) if len(b)]
    train = [(u, c / c.sum(), y) for (u, c), y, h, _ in examples if not h]
    emb = rng.normal(0, 0.3, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    epochs = max(p.epochs, -(-p.least_steps * p.batch // max(1, len(train))))  # few examples are seen more often
    for epoch in range(epochs):
        rate = p.rate * (1 - epoch / epochs)
        order = rng.permutation(len(train))
        for s in range(0, len(order), p.batch):
            rows = [train[i] for i in order[s : s + p.batch]]
            cut = np.cumsum([0, *(len(u) for u, _, _ in rows)])[:-1]
            u, w = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32)
            mean = np.add.reduceat(emb[u] * w[:, None], cut)
            g = softmax(mean @ out + bias)
            g[np.arange(len(rows)), [r[2] for r in rows]] -= 1
            g = (g / len(rows)).astype(np.float32)
            back = (g @ out.T)[np.repeat(np.arange(len(rows)), np.diff(np.append(cut, len(u))))] * w[:, None]
            out -= rate * mean.T @ g
            bias -= rate * g.sum(0)
            spread = np.argsort(u, kind="stable")
            edge = np.flatnonzero(np.diff(u[spread], prepend=-1))
            emb[u[spread][edge]] -= rate * 20 * np.add.reduceat(back[spread], edge)
    model = Model(names, emb @ out, bias, p)
    check = [(u, c, y) for (u, c), y, h, _ in examples if h]
    if check:
        z = np.array([(c[:, None] * model.table[u]).sum(0) / c.sum() + bias for u, c, _ in check])
        y = np.array([y for _, _, y in check])
        loss = lambda s: -np.log(softmax(z * s)[np.arange(len(y)), y] + 1e-12).mean()
        scale = min(np.geomspace(0.05, 20, 60), key=loss)
        model.table, model.bias = (model.table * scale).astype(np.float32), (bias * scale).astype(np.float32)
        model.limit = float(np.quantile(softmax(z * scale).max(1), p.false_reject))
    return model


def train_on(labelled: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about ``p.per_lang`` rows of each language, chosen by a hash of the id."""
    rows = plain_columns(labelled, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    # One row for each language that is told apart.
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [], p)
    each = min(p.per_lang, p.max_rows / len(counts))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(p.seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - p.piece_chars, F.lit(0)) + 1) + 1
    some = rows.where(place < F.element_at(share, F.col("lang"))).select("id", "lang", F.substring("text", at.cast("int"), F.lit(p.piece_chars)).alias("text"))
    sample = sorted(some.collect(), key=lambda r: (str(r.id), r.text))
    return fit([r.text for r in sample], [r.lang for r in sample], p)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for each document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bias, model.p, model.limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in blocks([t or "" for t in texts]):
                pred, score, rejected = own.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(plain_columns(docs, doc_id=id_col, text=text_col), run, SCHEMA)
