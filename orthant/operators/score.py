"""Expected dominance scores and exact top-k.

score(o) is the sum over instances a of o, and b of other objects, of p_a * p_b where a dominates b.

Up to ``DIRECT_MAX`` instances the right side is broadcast (its size is counted first) and compared
directly. Beyond, equal points are merged and sums over dominated points are taken in n log n: in two
dimensions by strips and cells of the plane, in three by strips along three orders and cells of space. An
object's own share is summed in the same way and taken off. In more dimensions pairs are compared in salted
blocks, which is quadratic. The ways differ in the order of sums, so in no more than the last digits of a double.
In three dimensions rows are shuffled in slices, each to its end: together they would take several times the disk of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.dominance import dominates
from orthant.shipping import ship
from orthant.storage import materialize, shared_dir

from . import plane, space

DIRECT_MAX, ND_SALTS = 8192, 32
#: In three dimensions, the points of a strip.
PARTITION_POINTS = 500_000
#: Objects of more instances are summed like whole queries; those of fewer within one task, so many rows at once.
OWN_MAX, OWN_ROWS = 4096, 100_000
DIGITS = 6


def rounded(c: Column | str) -> Column:
    """To six digits, by way of nine, so that the order of a sum doesn't decide what lies on an edge."""
    return F.round(F.round(c, DIGITS + 3), DIGITS)


def dominated_mass(inst: DataFrame, dims: int, keys: list[str], candidates: DataFrame | None = None, method: str = "auto", own: DataFrame | None = None) -> DataFrame:
    """(query_id, object_id, score): scores among the instances that agree in keys. ``candidates``
    (query_id, object_id) limits whose scores are wanted, never what they are held against. ``own``: what
    ``own_shares`` gave, if it is known."""
    wanted = inst if candidates is None else inst.join(candidates, ["query_id", "object_id"], "left_semi")
    if method == "auto":
        method = choose_method(inst, dims)
    if method != "grid":
        return {"direct": _direct, "blocks": _blocks}[method](wanted, inst, dims, keys)
    place = [f"d{d}" for d in range(dims)]
    found, slices, folder = _masses(inst, keys, dims), _slices(inst, dims), shared_dir(inst.sparkSession)
    totals = []
    for i, (rows, some) in enumerate(zip(space.sliced(wanted.select(*_columns(dims, keys)), place, slices), space.sliced(found.drop("p"), place, slices), strict=True)):
        total = rows.join(some, [*keys, *place]).groupBy("query_id", "object_id").agg(F.sum(F.col("p") * F.col("mass")).alias("score"))
        totals.append(materialize(total, folder, f"total-{i}") if slices > 1 else total)
    total = space.joined(totals).groupBy("query_id", "object_id").agg(F.sum("score").alias("score")) if slices > 1 else totals[0]
    own = own_shares(inst, dims) if own is None else own
    return total.join(own, ["query_id", "object_id"], "left").select("query_id", "object_id", F.greatest(F.col("score") - F.coalesce("own", F.lit(0.0)), F.lit(0.0)).alias("score"))


def own_shares(inst: DataFrame, dims: int) -> DataFrame:
    """(query_id, object_id, own): what an object's instances dominate of the object itself. Objects lie in
    one partition, so it is the same for scores within partitions. Objects are small as a rule, so a task has whole
    ones; the few beyond ``OWN_MAX`` instances are summed by strips."""
    keys, folder = ["query_id", "object_id"], shared_dir(inst.sparkSession)
    large = materialize(inst.groupBy(*keys).agg(F.count("*").alias("n_inst")).where(F.col("n_inst") > OWN_MAX).select(*keys), folder, "large")
    if large.isEmpty():
        return space.joined([materialize(_own_within(rows, dims), folder, f"own-{i}") for i, rows in enumerate(space.sliced(inst, keys, _slices(inst, dims)))])
    found = _masses(inst.join(large, keys, "left_semi"), keys, dims)
    strips = found.groupBy(*keys).agg(F.sum(F.col("p") * F.col("mass")).alias("own"))
    small = [_own_within(rows, dims) for rows in space.sliced(inst.join(large, keys, "left_anti"), keys, _slices(inst, dims))]
    return space.joined([materialize(own, folder, f"own-{i}") for i, own in enumerate([*small, strips])])


def within_groups(group: np.ndarray, place: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Of points sorted by group and place: the weight that each dominates in its group. A point dominates only
    later ones, which are met at growing distances; in the plane, long groups are halved."""
    ends = np.cumsum(np.bincount(group))[group]
    if len(place) == 2 and np.bincount(group).max() > 256:
        return plane.dominated_sums(group, *place, p)
    out, rows, step = np.zeros(len(group)), np.arange(len(group)), 1
    while len(rows := rows[rows + step < ends[rows]]):
        later = rows + step
        least, less = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        for x in place:
            least &= x[rows] <= x[later]
            less |= x[rows] < x[later]
        out[rows] += np.where(least & less, p[later], 0.0)
        step += 1
    return out


def _own_within(inst: DataFrame, dims: int) -> DataFrame:
    """The own shares of objects that fit in a task."""
    keys, place = ["query_id", "object_id"], [f"d{d}" for d in range(dims)]
    ship(inst.sparkSession.sparkContext)
    dealt = inst.select(*keys, *place, "p").repartition(*keys).sortWithinPartitions(*keys, *place)
    schema = dealt.select(*keys, F.col("p").alias("own")).schema

    def shares(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = [table.column(c).to_numpy() for c in place]
        p = table.column("p").to_numpy()
        own = np.bincount(group, p * within_groups(group, at, p))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        yield from table.select(keys).take(pa.array(first)).append_column("own", pa.array(own)).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if not size or batch is not None and size < OWN_ROWS:
                continue
            table = pa.Table.from_batches(held)
            group = plane._groups(table, keys)
            cut = size if batch is None else int(np.searchsorted(group, group[-1]))  # the last object may go on
            if cut:
                yield from shares(table.slice(0, cut), group[:cut])
                held, size = table.slice(cut).to_batches(), size - cut

    return dealt.mapInArrow(run, schema)


def _merged(inst: DataFrame, keys: list[str], dims: int) -> DataFrame:
    return inst.groupBy(*keys, *[f"d{d}" for d in range(dims)]).agg(F.sum("p").alias("p"))


def _slices(rows: DataFrame, dims: int) -> int:
    """In how many parts rows are shuffled; one in the plane."""
    return max(1, -(-rows.count() // space.SLICE_ROWS)) if dims == 3 else 1


def _masses(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """The different points (keys, d0.., p) of rows with the mass that each dominates in its group."""
    folder = shared_dir(rows.sparkSession)
    if dims == 1:
        return _masses(rows.withColumn("d1", F.lit(0.0)), keys, 2).drop("d1")
    if dims == 2:
        found = plane.masses(_merged(rows, keys, 2).select(*keys, F.col("d0").alias("x"), F.col("d1").alias("y"), F.lit(0).alias("role"), F.col("p").alias("w")), keys, folder, "plane")
        return found.select(*keys, F.col("x").alias("d0"), F.col("y").alias("d1"), F.col("w").alias("p"), F.col("sum_w").alias("mass"))
    parts = space.sliced(rows, space.PLACE, _slices(rows, dims))
    points = {f"points-{i}": materialize(_merged(part, keys, dims), folder, f"points-{i}") for i, part in enumerate(parts)}
    return space.masses(points, keys, folder, PARTITION_POINTS)


def choose_method(inst: DataFrame, dims: int) -> str:
    """How to compare, by counting (up to the limit) what would be broadcast."""
    if inst.limit(DIRECT_MAX + 1).count() <= DIRECT_MAX:
        return "direct"
    return "grid" if dims <= 3 else "blocks"


def _columns(dims: int, keys: list[str]) -> list[str]:
    return [*dict.fromkeys(["query_id", *keys]), "object_id", "p", *[f"d{d}" for d in range(dims)]]


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a.query_id", "a.object_id").agg(F.sum(F.col("a.p") * F.col("b.p")).alias("score"))


def _direct(wanted: DataFrame, inst: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    c = _columns(dims, keys)
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    other = F.col("a.object_id") != F.col("b.object_id")
    spread = wanted.select(*c).repartition(wanted.sparkSession.sparkContext.defaultParallelism)
    return _summed(spread.alias("a").join(F.broadcast(inst.select(*c)).alias("b"), [*same, other, dominates("a", "b", dims)]))


def _blocks(wanted: DataFrame, inst: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    """Left rows are dealt to salts, right rows to all of them: no task has a whole query."""
    c = _columns(dims, keys)
    left = wanted.select(*c, F.pmod(F.xxhash64("object_id", *[f"d{d}" for d in range(dims)]), F.lit(ND_SALTS)).alias("salt"))
    right = inst.select(*c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ND_SALTS - 1).cast("long"))).alias("salt"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "salt"]]
    return _summed(left.alias("a").join(right.alias("b"), [*same, F.col("a.object_id") != F.col("b.object_id"), dominates("a", "b", dims)]))


def objects_of(inst: DataFrame) -> DataFrame:
    return inst.groupBy("query_id", "object_id").agg(F.count("*").alias("n_inst"), F.sum("p").alias("mass"), F.min("part").alias("part"))


def scores(inst: DataFrame, dims: int, candidates: DataFrame | None = None, method: str = "auto", own: DataFrame | None = None) -> DataFrame:
    """query_id, object_id, n_inst, score; an object that dominates nothing scores 0."""
    objects = objects_of(inst).select("query_id", "object_id", "n_inst")
    if candidates is not None:
        objects = objects.join(candidates, ["query_id", "object_id"], "left_semi")
    return objects.join(dominated_mass(inst, dims, ["query_id"], candidates, method, own), ["query_id", "object_id"], "left").na.fill(0.0, ["score"])


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query, by rounded score and then id, with their rank. Spark keeps k rows a
    task and query before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "object_id")
    return scored.withColumn(by, rounded(by)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dominated_counts(inst: DataFrame, dims: int) -> DataFrame:
    """For each object, how many (instance, instance) pairs it dominates; counts, not pairs, leave a task."""
    ones = inst.withColumn("p", F.lit(1.0))
    return scores(ones, dims).select("query_id", "object_id", "n_inst", F.col("score").cast("long").alias("n_pairs"))
