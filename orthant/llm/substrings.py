"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of 16 bits (each byte shifts it left and adds the byte's random number, so the last
16 bytes decide) proposes a cut after every byte where its upper bits are 0. A proposal with
another one at most ``MIN_GAP`` bytes before it is left out. So cuts depend on nothing but
the bytes right before them, and are the same again soon after an insertion. Chunks longer than
``MAX_CHUNK`` are cut evenly.

A document is an id with a text: rows of one id with different texts are documents of their own.
Chunks are deduplicated by a 64-bit digest: the document of the least id keeps its first one.
A run of neighbouring later copies is dropped if it has ``MIN_RUN`` bytes or more, so a common
phrase or line in a clean document stays (and so does a chunk whose digest collides by chance,
unless its neighbours do as well).

Scale: chunks are made once and written to the shared folder; digests are aggregated before the
shuffle, so a passage in a third of all documents is a row for each task. The table of shared
digests is written, so the join back shuffles both sides anew and AQE can split the partition
of a hot digest. Text is not shuffled to find the spans.

Cases: offsets count UTF-8 bytes; a null or empty text has no chunk; repeated rows (same id and text)
are one document; different texts of the least id both keep what they share; a null id comes
after all others; further columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_arrow, materialize, plain_columns, shared_dir, text_hash
from .textscan import blocks, mix

CUT_BITS, MIN_GAP, MAX_CHUNK, MIN_RUN = 4, 10, 256, 112
#: place is the start times 2**16 plus the size, again whether the document has the chunk before.
CHUNK = "doc_id long, doc_hash long, digest long, place long, again boolean"
#: What a null id counts as.
LAST_ID = 2**63 - 1
#: 0xFF is in no UTF-8 text; with 0 for it, texts laid end to end don't reach into each other.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
GEAR[0xFF] = 0
_PAD = b"\xff" * 16


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte; windows double, so four steps give 16 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_ends(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the ends of its chunks; the last is the text's end."""
    data = np.frombuffer(_PAD.join([*texts, b""]), np.uint8)
    found = np.flatnonzero(gear_hashes(data) >> np.uint16(16 - CUT_BITS) == 0) + 1
    found = found[found < len(data)]
    found = found[data[found] & 0xC0 != 0x80]  # never within a character
    starts = np.cumsum([0, *(len(t) + len(_PAD) for t in texts)])
    out = []
    for k, text in enumerate(texts):
        a, b = np.searchsorted(found, (starts[k] + 1, starts[k] + len(text)))
        own = found[a:b] - starts[k]
        own = own[np.diff(own, prepend=-MIN_GAP - 1) > MIN_GAP]
        own = np.append(own, len(text)) if len(text) else own[:0]
        long = np.flatnonzero(np.diff(own, prepend=0) > MAX_CHUNK)
        if len(long):
            more = [np.arange((own[i - 1] if i else 0) + MAX_CHUNK, own[i], MAX_CHUNK) for i in long]
            forced = np.concatenate(more)
            for _ in range(3):
                forced -= data[starts[k] + forced] & 0xC0 == 0x80
            own = np.sort(np.concatenate([own, forced]))
        out.append(own)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNK: the chunks of (doc_id, doc_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, hashes), texts = (batch.column(k).to_numpy() for k in (0, 1)), [t or "" for t in batch.column(2).to_pylist()]
            for i, j in blocks(texts):
                whole = [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]
                ends = chunk_ends(whole)
                counts = np.array([len(e) for e in ends])
                if not counts.sum():
                    continue
                stop = np.concatenate(ends)
                start = np.concatenate([np.append(0, e[:-1]) if len(e) else e for e in ends])
                digest = np.fromiter((xxhash.xxh3_64_intdigest(t[a:b]) for t, e in zip(whole, ends, strict=True) for a, b in zip([0, *e[:-1].tolist()], e.tolist(), strict=False)), np.uint64, len(stop))
                doc = np.repeat(np.arange(j - i), counts)
                order = np.lexsort((start, digest, doc))
                same = (np.diff(digest[order], prepend=np.uint64(0)) == 0) & (np.diff(doc[order], prepend=-1) == 0)
                again = np.zeros(len(stop), bool)
                again[order] = same
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc]), pa.array(hashes[i:j][doc]), pa.array(digest.view(np.int64)), pa.array((start << 16) + stop - start), pa.array(again)], names=["doc_id", "doc_hash", "digest", "place", "again"])

    return map_arrow(docs, run, CHUNK)


def _spans(docs: DataFrame, min_run: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``repeated_spans`` and doc_hash, for each document, with LAST_ID for a null id."""
    texts = plain_columns(docs, doc_id=id_col, text=text_col).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), text_hash(F.col("text")).alias("doc_hash"), "text")
    folder = shared_dir(docs.sparkSession)
    cut = materialize(chunks(texts), folder, "chunks")
    seen = cut.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), F.min("doc_hash").alias("lo"), F.max("doc_hash").alias("hi"), F.bool_or("again").alias("twice"))
    shared = materialize(seen.where("holder <> last or lo <> hi or twice").select("digest", "holder"), folder, "shared")
    later = (F.col("again") | (F.col("doc_id") > F.col("holder"))).alias("later")
    found = cut.join(shared, "digest").select("doc_id", "doc_hash", F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(0xFFFF).alias("size"), "holder", later)
    document = ["doc_id", "doc_hash"]
    # Repeated rows have the same chunks at the same places; the shuffle by document serves the windows as well.
    copies = found.repartition(*document).dropDuplicates([*document, "start", "size", "holder", "later"])
    in_order = Window.partitionBy(*document, "later").orderBy("start")
    follows = F.col("start") == F.lag(F.col("start") + F.col("size")).over(in_order)
    numbered = copies.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_order))
    runs = numbered.groupBy(*document, "later", "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.collect_set("holder").alias("holders"))
    gone = F.col("later") & (F.col("size") >= min_run)
    per_doc = runs.groupBy(*document).agg(
        F.sum("size").alias("n_shared"), F.sum(F.when(gone, F.col("size"))).alias("n_dropped"), F.sort_array(F.collect_list(F.when(gone, F.struct("start", "size")))).alias("spans"), F.array_distinct(F.flatten(F.collect_list(F.when(gone, F.col("holders"))))).alias("holders"),
    )
    rows = F.count_if(F.shiftright("place", 16) == 0)  # each row of the document has one chunk at 0
    counts = cut.groupBy(*document).agg((F.count("*") / rows).cast("long").alias("n_chunks"), (F.sum(F.col("place").bitwiseAND(0xFFFF)) / rows).cast("long").alias("n_bytes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    all_docs = texts.select(*document).distinct().join(counts, document, "left").join(per_doc, document, "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)")
    others = F.array_sort(F.filter("holders", lambda h: h != F.col("doc_id")))
    return all_docs.select(*document, zero("n_bytes"), zero("n_chunks"), zero("n_shared"), zero("n_dropped"), F.coalesce("spans", empty).alias("spans"), F.coalesce(others, F.expr("cast(array() as array<bigint>)")).alias("kept_in"))


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_chunks, n_shared (bytes of chunks that
    occur elsewhere, too), n_dropped (bytes), spans (start and size of what is dropped, in order) and
    kept_in (the ids of other documents that keep it)."""
    found = _spans(docs, min_run, id_col, text_col).drop("doc_hash")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def drop_repeats(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their texts without the dropped spans."""
    spans = _spans(docs, min_run, id_col, text_col).where("n_dropped > 0").select("doc_id", "doc_hash", "spans")
    packed = docs.select(F.coalesce(docs[id_col], F.lit(LAST_ID)).alias("doc_id"), text_hash(docs[text_col]).alias("doc_hash"), F.encode(docs[text_col], "UTF-8").alias("bytes"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = packed.join(spans, ["doc_id", "doc_hash"], "left")
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("bytes").cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["start"] + s["size"]))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("bytes"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.decode(F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y)), "UTF-8")
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(kept)
    return joined.select("row", text.alias("text")).select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
