"""Line deduplication: lines that many documents share stay in one document only.

Normalised lines are exploded with their positions and hashed (two 64-bit hashes); distinct
documents are counted for each hash. Lines over the threshold are dropped by position in every
document but the largest id that holds them, and the rest is put together in order.

Scale: only hashes, ids and positions of long lines are shuffled to find what is dropped; counts
are aggregated before the shuffle; the join back of a hot line is an inner equi-join that
AQE may split. Texts move once, to meet their list of dropped positions.

Cases: a null or empty text is one empty line. Rows that repeat an id count as one document and
each row loses its own lines. A null id never counts as a document and loses nothing. Further
columns are never looked at by ``line_decisions``; ``drop_common_lines`` returns them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, plain_columns, shared_dir

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_line_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, row_hash, drop): the positions that each row of (doc_id, row_hash, text) loses."""
    lines = docs.where("doc_id is not null").select("doc_id", "row_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    trimmed = lines.select("doc_id", "row_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.length("line") >= min_chars)
    key = F.translate("line", UPPER, LOWER)
    keyed = trimmed.select("doc_id", "row_hash", "pos", key.alias("key")).select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = keyed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs).drop("n")
    # Written, so that the join shuffles both sides anew and AQE can split the partition of a hot line.
    common = materialize(common, shared_dir(docs.sparkSession), "common")
    lost = keyed.join(common, ["h1", "h2"]).where("doc_id <> holder")
    return lost.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def without(lines: Column, drop: Column) -> Column:
    """``lines`` without the positions in ``drop`` (sorted), put together from the runs between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda i: i + 1))
    return F.flatten(F.zip_with(starts, F.concat(drop, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a)))


def _decided(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, row_hash, text) with the lines, and those kept."""
    drops = common_line_positions(docs, min_chars, min_docs)
    joined = docs.join(drops, ["doc_id", "row_hash"], "left").withColumn("lines", lines_of(F.col("text")))
    return joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("drop"))))


def line_decisions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, for each row."""
    own = plain_columns(docs, doc_id=id_col, text=text_col).withColumn("row_hash", F.xxhash64("text"))
    kept = _decided(own, min_chars, min_docs)
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns; the text is what stays of it."""
    packed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("row_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    drops = common_line_positions(packed.select("doc_id", "row_hash", "text"), min_chars, min_docs)
    kept = F.array_join(without(lines_of(F.col("text")), F.col("drop")), "\n")
    out = packed.join(drops, ["doc_id", "row_hash"], "left").select("row", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
