"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; no
source gives more than ``MAX_PASSES`` times its own words, and what is cut is shared again by
weight (water-filling, in one pass over the sources in order of words a weight).

Schedule: slot j of ``BLOCK_WORDS`` words has the golden-ratio point frac(j / phi), in whole 32-bit
numbers; the source whose share of [0, 1) holds the point fills the slot. Slots are ranked within
their source; rank r takes block r modulo the source's number of blocks. Blocks are equal
cuts of the source's documents laid end to end in a shuffled order (by a seeded hash of the id).
A document's take is the words of it in the blocks taken.

Scale: running sums and ranks have two levels, so that no source (which may have a third of all
rows) is ever ordered in one task: sums of hash ranges or slot chunks first, then within each.
The table of sources is broadcast only if counted to be at most ``MAX_BROADCAST_SOURCES``.

Cases: a null or empty text has size 0 and takes 0; without any word all targets are 0; rows that
repeat an id are documents of their own; a null id is shuffled by an empty string; further columns
are never looked at by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, plain_columns, shared_dir, text_hash

WEIGHTS = (5, 2, 1)
MAX_PASSES, BLOCK_WORDS = 3, 32
GOLDEN = 2654435769  # 2**32 / phi
ROWS_PER_RANGE, CHUNK_BITS, CELL_BITS = 2000, 12, 12
MAX_BROADCAST_SOURCES = 100_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, place (code-point order), source_size, total, target of each source. The two windows
    run over one row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = by_source.select("source", place.alias("place"), "source_size").withColumn("weight", weight)
    everyone = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * max_passes
    left = (F.col("total") - F.coalesce(F.sum(limit).over(filled), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    level = placed.withColumn("total", F.sum("source_size").over(everyone)).withColumn("all_weight", F.sum("weight").over(everyone)).withColumn("left", left)
    level = level.withColumn("full", limit <= F.col("left") * F.col("weight"))
    per_weight = F.coalesce(F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "place", "left"))).over(everyone)["left"], F.lit(0.0))
    # Sources are full up to the first one that isn't; that one's level is everybody's.
    goal = F.least((F.col("source_size") * max_passes).cast("double"), per_weight * F.col("weight"))
    return level.select("source", "place", "source_size", "total", goal.alias("target"))


def running_sum(rows: DataFrame, keys: list[str], span: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of their keys, ordered by (span,
    *order): spans are summed first and then each is summed within."""
    sums = rows.groupBy(*keys, span).agg(F.sum(value).alias("span_sum"))
    before = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, span, F.coalesce(F.sum("span_sum").over(before), F.lit(0)).alias("span_start"))
    inside = Window.partitionBy(*keys, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*keys, span]).withColumn(name, F.col(name) + F.col("span_start")).drop("span_start")


def schedule(sources: DataFrame, n_slots: int, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES) -> DataFrame:
    """place, block, times: how often each block of each source is taken by the slots."""
    goal = F.round("target").cast("long")
    upto = F.sum(goal).over(Window.orderBy("place"))
    whole = F.sum(goal).over(Window.partitionBy())
    edge = lambda x: F.floor(x / whole * F.lit(float(1 << 32))).cast("long")
    bounds = sources.where("target > 0").select("place", F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"), edge(upto - goal).alias("lo"), edge(upto).alias("hi")).where("lo < hi")
    shift = 32 - CELL_BITS
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    low, high = F.col("slot").bitwiseAND(0xFFFF), F.shiftright(F.col("slot"), 16).bitwiseAND(0xFFFF)
    point = (low * GOLDEN + F.shiftleft((high * GOLDEN).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)
    slots = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point)
    slots = slots.withColumn("cell", F.shiftright("point", shift)).join(_small(cells), "cell").where("lo <= point and point < hi")
    ranked = running_sum(slots.select("place", "blocks", "slot", F.shiftright("slot", CHUNK_BITS).alias("chunk"), F.lit(1).alias("one")), ["place"], "chunk", ["slot"], "one", "rank")
    taken = ranked.where(F.col("rank") < F.col("blocks") * max_passes)
    return taken.groupBy("place", F.pmod("rank", F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table


def _taken(docs: DataFrame, block_words: int, row: list[str]) -> DataFrame:
    """Of (doc_id, source, text, *row): doc_id, size, source_size, target, taken and row."""
    folder = shared_dir(docs.sparkSession)
    sized = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), *row), folder, "sized")
    sources = materialize(targets(sized), folder, "sources")
    first = sources.agg(F.max("total"), F.count("*")).first()
    total, n_sources = first[0] or 0, first[1]
    rows = sized.count()
    digits = max(1, (max(1, rows // ROWS_PER_RANGE) - 1).bit_length() // 4 + 1)
    near = F.broadcast(sources) if n_sources <= MAX_BROADCAST_SOURCES else sources
    placed = sized.alias("d").join(near.alias("s"), F.expr("d.source <=> s.source")).select("doc_id", "size", *row, "place", "source_size", "target")
    order = F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    shuffled = placed.withColumn("order", order).withColumn("range", F.substring("order", 1, digits))
    laid = materialize(running_sum(shuffled, ["place"], "range", ["order", "size", *row], "size", "start").drop("order", "range"), folder, "laid")
    times = schedule(sources, (total + block_words // 2) // block_words, block_words)
    at = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    parts = laid.where("size > 0").select("place", "start", "size", F.explode(at).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    got = parts.join(times, ["place", "block"]).groupBy("place", "start").agg(F.sum(inside * F.col("times")).alias("taken"))
    # With size > 0 a row's place and start are its own; rows of size 0 take nothing.
    return laid.join(got, ["place", "start"], "left").select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), *row)


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken, for each document."""
    return _taken(plain_columns(docs, doc_id=id_col, text=text_col, source=source_col), block_words, [])


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows, with all their columns, as the mix takes them: the whole document as often as all of its
    words are taken, and once more, if some are taken once more, a text of just those. A source's
    first blocks are taken once more than its last ones, so that is the start of the one document at the
    edge; every source comes out with exactly the words of its blocks. Documents of no words stay once.
    Repeated rows (same id, text and source) are told apart by their place only, so their takes are added
    and dealt as if they were one document."""
    own = plain_columns(docs, doc_id=id_col, text=text_col, source=source_col).withColumn("text_hash", text_hash(F.col("text")))
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), "text_hash", F.coalesce(F.xxhash64("source"), F.lit(0)).alias("k_source")]
    taken = _taken(own.withColumn("row_source", F.col("source")), block_words, ["text_hash", "row_source"]).withColumnRenamed("row_source", "source")
    plan = taken.select(*key, "size", "taken").groupBy("k_id", "k_null", "text_hash", "k_source").agg(F.min("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), text_hash(docs[text_col]).alias("text_hash"), docs[source_col].alias("source")).select("row", *key)
    joined = packed.join(plan, ["k_id", "k_null", "text_hash", "k_source"])
    return _emitted(joined, docs.columns, text_col)


def _emitted(joined: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """Rows (row, size, taken, rows) as often as they are taken."""
    each = F.col("taken") / F.col("rows")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(each / F.col("size"))).cast("int")
    more = F.when(F.col("size") == 0, 0).otherwise(F.floor(each) - times * F.col("size")).cast("int")
    text = F.col("row")[text_col]
    # Each word with the white space before it, so that a part is laid out as the text is.
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), more), "")
    texts = F.concat(F.array_repeat(text, times), F.when(more > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return joined.select("row", F.explode(texts).alias("text")).select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in columns])
