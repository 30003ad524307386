"""Near-duplicate detection: ProbMinHash signatures, banding, verification, components.

1. A text's distinct five-word shingles all have the weight 1, as in the verified similarity. Each
   shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, each
   register keeps the earliest, and a shingle's process ends once it is later than all registers (early
   termination). Two texts agree in a register with the Jaccard similarity of their sets.
2. Texts with the same set of shingles are one class at once (a group of copies is never
   expanded); the rest works on one representative of each set.
3. ``BANDS`` bands of ``ROWS`` registers are hashed; representatives that share a band are
   candidates. Within a bucket all are compared with its smallest member first (a star, linear
   in the bucket). Components of the verified links label the representatives.
4. Buckets that still hold several labels are compared again, member against member where the labels
   differ, in tiles of bounded size that give out only verified links. So no link between
   members of a bucket is lost, and no pair that isn't a link is ever a row.
5. Verification is exact but for collisions of 32-bit hashes within two documents: the Jaccard
   similarity of the shingle sets is 0.8 or more. Pairs whose signatures agree in so few registers
   that a similar pair is four standard deviations away aren't looked at.

Scale: texts are scanned for signatures, and once more, where they share a bucket, for their
sets of shingles, which are all that is joined later. Every table in between is written to the shared folder. Hot buckets, hot representatives and hot
classes meet only partial aggregation or joins that AQE may split.

Cases: a document is an id with a text: rows of one id with different texts are documents of their own,
repeated rows (same id and text) are one, of which one row stays. Null, empty and wordless texts are
classes by themselves. A text of one to four words is one shingle. The smallest doc_id names a class and
stays (of several texts of that id the one of the least hash); a null id comes after all others.
Further columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import map_arrow, materialize, plain_columns, shared_dir, text_hash
from .textscan import STEP, Scan, blocks, mix, shingles

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: More registers than the bands need: they make the estimate before verification sharper.
REGISTERS = 2 * BANDS * ROWS
#: Four standard deviations of the estimate below the threshold.
LEAST_AGREEING = int(REGISTERS * (THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5))
TILE = 512
SKETCH = "doc_id long, doc_hash long, fp_hi long, fp_lo long, bands array<long>, sig binary"
#: What a null id counts as.
LAST_ID = 2**63 - 1
_GOLD = 0x9E3779B97F4A7C15
_SIDE = np.uint64(0xA0761D6478BD642F)


def probminhash(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The registers (n_docs x m) of weighted shingles: in each, the shingle that came first."""
    first = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, np.uint64)
    live, now = np.arange(len(h)), np.zeros(len(h))
    step = 0
    while len(live):
        step = (step + _GOLD) & 0xFFFFFFFFFFFFFFFF
        random = mix(h[live] + np.uint64(step))
        now = now - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        latest = first.reshape(n_docs, m).max(1)
        going = now < latest[doc[live]]
        live, now, random = live[going], now[going], random[going]
        at = doc[live] * m + (mix(random ^ _SIDE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, now)
        won = first[at] == now
        who[at[won]] = h[live[won]]
    return who.reshape(n_docs, m)


def distinct_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each distinct shingle of each document, in order."""
    h, doc = shingles(Scan(texts, alnum=True), WORDS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero((np.diff(h, prepend=np.uint64(0)) != 0) | (np.diff(doc, prepend=-1) != 0))
    return h[new], doc[new]


def sketches(texts: DataFrame) -> DataFrame:
    """SKETCH of all documents (doc_id, doc_hash, text); without a word the rest is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in blocks(whole):
                h, doc = distinct_shingles(whole[i:j])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                none = np.diff(cut) == 0
                who = probminhash(h, np.ones(len(h)), doc, j - i)
                band = np.full((j - i, BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * STEP + who[:, r : BANDS * ROWS : ROWS])
                digests = [xxhash.xxh3_128_digest(h[cut[d] : cut[d + 1]]) for d in range(j - i)]
                fp = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                upto = pa.array(np.append(0, np.cumsum(np.where(none, 0, BANDS))).astype(np.int32), mask=np.append(none, False))
                sigs = [None if x else y.tobytes() for x, y in zip(none, (mix(who) & np.uint64(255)).astype(np.uint8), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(fp[:, 0], mask=none), pa.array(fp[:, 1], mask=none), pa.ListArray.from_arrays(upto, pa.array(band[~none].view(np.int64).ravel())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "doc_hash", "fp_hi", "fp_lo", "bands", "sig"],
                )

    return map_arrow(texts, run, SKETCH)


def alike(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Of pairs (a, b) of representatives those whose signatures agree well enough."""
    sig = sketch.select("rep", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_AGREEING))

    return map_arrow(both, run, "a long, b long")


def shingle_sets(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles): the distinct shingles of the texts of reps (rep, doc_id, doc_hash), as sorted 32-bit
    hashes. Of neighbouring repeated rows the first is read; a set that comes twice does no harm."""
    # The list of documents has no bound, so it is never broadcast.
    wanted = texts.join(reps.hint("merge"), ["doc_id", "doc_hash"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            reps = batch.column(0).to_numpy()
            new = np.diff(reps, prepend=reps[:1] - 1) != 0
            new[:1] &= reps[:1] != last
            last = reps[-1] if len(reps) else last
            some = batch.filter(pa.array(new))
            whole = [t or "" for t in some.column(1).to_pylist()]
            for i, j in blocks(whole):
                h, doc = distinct_shingles(whole[i:j])
                parts = np.split((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(doc, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([some.column(0).slice(i, j - i), pa.array([np.unique(x).tobytes() for x in parts], pa.binary())], names=["rep", "shingles"])

    return map_arrow(wanted, run, "rep long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of THRESHOLD or more."""
    small, large = sorted((len(x), len(y)))
    if small < THRESHOLD * large - 1e-9:
        return False
    both = np.concatenate((x, y))
    both.sort()
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= THRESHOLD * (len(both) - shared) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are similar."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            keep = [similar(np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32)) for u, v in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def rest_of_buckets(members: DataFrame, labels: DataFrame, sketch: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one bucket that have different labels, from buckets of several labels.

    Members are compared and verified where the bucket is, so that only links leave the task. A bucket
    of more than TILE members is dealt to pairs of tiles. A pair is compared in the first band
    that it shares by its whole hash, and not in the others.
    """
    labelled = members.join(labels.toDF("rep", "label"), "rep", "left").select("bucket", "band", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2")
    rows = labelled.join(mixed.select("bucket", "size"), "bucket").join(sketch.select("rep", "sig", "bands"), "rep").join(sets, "rep")
    tiles = F.ceil(F.col("size") / TILE)
    own = F.pmod(F.xxhash64("rep"), tiles)
    rows = rows.select("bucket", "band", "rep", "label", "sig", "shingles", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"), own.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    rows = rows.select("bucket", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "rep", "label", "sig", "shingles", "earlier")
    dealt = rows.repartition("bucket", "t1", "t2").sortWithinPartitions("bucket", "t1", "t2")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        t1, t2 = group[0][1:3]
        left = [r for r in group if r[3] == t1]
        right = left if t1 == t2 else [r for r in group if r[3] == t2]
        if not left or not right:
            return
        sigs = lambda rows: np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, REGISTERS)
        y, names, ids, earlier = sigs(right), np.array([r[5] for r in right]), np.array([r[4] for r in right]), np.array([r[8] for r in right], np.int64)
        for r, x in zip(left, sigs(left), strict=True):
            near = ((y == x).sum(1) >= LEAST_AGREEING) & (names != r[5]) & ((ids > r[4]) if t1 == t2 else True)
            near &= ~(earlier == np.array(r[8], np.int64)).any(1)
            mine = np.frombuffer(r[7], np.uint32)
            for k in np.flatnonzero(near).tolist():
                if similar(mine, np.frombuffer(right[k][7], np.uint32)):
                    yield max(r[4], right[k][4]), min(r[4], right[k][4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    out.update(compare(group))
                    group = []
                group.append(row)
            yield _pairs(out)
        if group:
            yield _pairs(set(compare(group)))

    return map_arrow(dealt, run, "a long, b long").distinct()


def _pairs(rows: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = plain_columns(docs, doc_id=id_col, text=text_col)
    return plain.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), text_hash(F.col("text")).alias("doc_hash"), "text")


def classes(texts: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, keep) for each row of (doc_id, doc_hash, text): keep is the document
    struct(doc_id, doc_hash) that stands for the row's class."""
    folder, document = shared_dir(texts.sparkSession), F.struct("doc_id", "doc_hash")
    sketch = materialize(sketches(texts), folder, "sketch")
    some = sketch.where("sig is not null")
    # Equal sets have equal bands and signatures. The number is that of the written row.
    reps = some.groupBy("fp_hi", "fp_lo").agg(F.min(document).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), folder, "reps")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("centre")).where("size > 1").drop("size")
    members = materialize(banded.join(shared, "bucket").select("bucket", "band", "rep", "centre"), folder, "members")
    wanted = reps.select("rep", "first.*").join(members.select("rep").distinct().hint("merge"), "rep", "left_semi")
    sets = materialize(shingle_sets(texts, wanted), folder, "sets")
    stars = members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(verified(alike(stars, reps), sets).distinct(), folder, "links")
    labels = components(links, folder, "first")
    more = materialize(rest_of_buckets(members, labels, reps, sets), folder, "more")
    if not more.isEmpty():
        labels = components(links.union(more), folder, "all")
    linked = labels.toDF("rep", "label").join(reps.select("rep", "first"), "rep")
    # Written, so that AQE can split the members of a large class.
    least = materialize(linked.groupBy("label").agg(F.min("first").alias("keep")), folder, "least")
    classed = reps.select("fp_hi", "fp_lo", "rep", "first").join(linked.join(least, "label").select("rep", "keep"), "rep", "left").select("fp_hi", "fp_lo", F.coalesce("keep", "first").alias("keep"))
    classed = materialize(classed, folder, "classes")
    by_set = some.select("doc_id", "doc_hash", "fp_hi", "fp_lo").join(classed, ["fp_hi", "fp_lo"]).select("doc_id", "doc_hash", "keep")
    return by_set.union(sketch.where("sig is null").select("doc_id", "doc_hash", document.alias("keep")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class), one row for each document."""
    found = classes(_texts(docs, id_col, text_col)).select("doc_id", "doc_hash", F.col("keep.doc_id").alias("class_id")).distinct()
    return found.select(*[F.when(F.col(c) != LAST_ID, F.col(c)).alias(c) for c in ("doc_id", "class_id")])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id. Of repeated rows one
    stays, so rows are only moved if they are repeated or if the list of what goes is too long to broadcast."""
    key = ["doc_id", "doc_hash"]
    found = classes(_texts(docs, id_col, text_col)).select(*key, (F.col("keep") == F.struct(*key)).alias("stays"))
    gone = found.groupBy(*key).agg(F.bool_and("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays")
    gone = materialize(gone, shared_dir(docs.sparkSession), "gone")
    packed = docs.select(F.coalesce(docs[id_col], F.lit(LAST_ID)).alias("doc_id"), text_hash(docs[text_col]).alias("doc_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    single = packed.join(gone, key, "left_anti")
    repeated = packed.join(gone.where("stays"), key, "left_semi").dropDuplicates(key)
    return single.union(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
