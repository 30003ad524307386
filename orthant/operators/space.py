"""Sums over dominated points in space, for data of any size, with one row for each point.

``masses`` gives, of different points (keys, d0, d1, d2, p), the summed p of the points of the group that each dominates.
A dominates b if b comes later in all of the orders (d0, d1, d2), (d1, d2, d0) and (d2, d0, d1). A group of more
points than a task holds is cut into strips along each order, and what a point dominates is met once:

1. in its own strip of the first order,
2. in later strips of the first and its own of the second,
3. in later strips of the first and second and its own of the third,
4. in later strips of all three, where whole cells are summed by running sums.

So a point is dealt three times, to one strip of each order, and keeps one sum. Other groups are done within tasks. Strips
are cut at a sample of the points, which decides only how even they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthant.shipping import ship
from orthant.storage import discard, materialize

from .plane import _groups, later_and_higher

PLACE = ["d0", "d1", "d2"]
ORDERS = ((0, 1, 2), (1, 2, 0), (2, 0, 1))
#: The most strips of a group along an order (its cells are at most their cube), points below which a group isn't cut
#: for the sake of more tasks, and points of the sample for each strip.
MAX_STRIPS, LEAST_POINTS, SAMPLED = 128, 20_000, 100
#: Points that are compared with each other, cells of two coordinates up to which these have running sums, and cells of one step.
CHUNK, DENSE, STEP_CELLS = 128, 16_384, 2_000_000
#: Rows that are shuffled at a time.
SLICE_ROWS = 40_000_000


def sliced(rows: DataFrame, by: list[str], slices: int) -> list[DataFrame]:
    """All rows in parts by a hash, so that no more than a part of them is shuffled at a time."""
    if slices <= 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(slices)) == i) for i in range(slices)]


def joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _dense(u: np.ndarray, v: np.ndarray, strict: tuple[bool, bool], w: np.ndarray) -> np.ndarray:
    """Of points in an order the summed weights of later ones that aren't nearer in u and v (are farther, if strict).
    Running sums over the cells of u and v stand at each chunk; within a chunk all are compared."""
    n, nu, nv = len(u), int(u.max()) + 2, int(v.max()) + 2
    chunks, cells = -(-n // CHUNK), nu * nv
    turned = lambda x, kind: np.concatenate((x[::-1], np.zeros(chunks * CHUNK - n, x.dtype))).astype(kind).reshape(chunks, CHUNK)
    u, v, w = turned(u, np.int32), turned(v, np.int32), turned(w, float)
    ask_u, ask_v = u + strict[0], v + strict[1]
    out, carry, before = np.zeros((chunks, CHUNK)), np.zeros((nu, nv)), np.tri(CHUNK, k=-1, dtype=bool)
    size = max(1, min(128, STEP_CELLS // cells))
    for a in range(0, chunks, size):
        s = slice(a, min(chunks, a + size))
        at = np.arange(s.stop - a)[:, None]
        table = np.bincount((at * cells + u[s] * nv + v[s]).ravel(), w[s].ravel(), len(at) * cells).reshape(-1, nu, nv)
        total = table[:, ::-1, ::-1].cumsum(axis=1).cumsum(axis=2).cumsum(axis=0)[:, ::-1, ::-1] + carry
        held = np.concatenate((carry[None], total[:-1]))
        carry = total[-1]
        wins = (u[s][:, None, :] >= ask_u[s][:, :, None]) & (v[s][:, None, :] >= ask_v[s][:, :, None]) & before
        out[s] = held[at, ask_u[s], ask_v[s]] + np.matmul(wins.astype(float), w[s][:, :, None])[:, :, 0]
    return out.ravel()[:n][::-1]


def _in_plane(block: np.ndarray, v: np.ndarray, strict: bool, w: np.ndarray) -> np.ndarray:
    """Of points in an order the summed weights of later ones of the block that aren't nearer in v."""
    place = np.arange(len(v))
    rank = np.empty(len(v), np.int64)
    rank[np.lexsort((-place if strict else place, v, -block))] = place
    order, out = np.argsort(block, kind="stable"), np.empty(len(v))
    out[order] = later_and_higher(rank[order], [w[order]])[0]
    return out


def _halved(u: np.ndarray, v: np.ndarray, strict: tuple[bool, bool], w: np.ndarray) -> np.ndarray:
    """The same as ``_dense`` for any number of cells: level by level, the first half of a block of u asks the second."""
    out = np.zeros(len(u)) if strict[0] else _in_plane(u, v, strict[1], w)
    for level in range(int(u.max()).bit_length()):
        right = (u >> level) & 1 == 1
        out += np.where(right, 0.0, _in_plane(u >> (level + 1), v, strict[1], np.where(right, w, 0.0)))
    return out


def dominated_sums(at: list[np.ndarray], strict: tuple[bool, bool, bool], w: np.ndarray) -> np.ndarray:
    """Of points in memory the summed weights of other points that aren't nearer in any coordinate, and are farther in those
    that are strict (not all are). Points differ, or are strict in one."""
    codes = [np.unique(x, return_inverse=True)[1].astype(np.int64) for x in at]
    many = [int(c.max()) + 1 for c in codes]
    t = max((d for d in range(3) if not strict[d]), key=lambda d: many[d])
    u, v = sorted((d for d in range(3) if d != t), key=lambda d: many[d])
    order = np.argsort((codes[t] * many[u] + codes[u]) * many[v] + codes[v])
    sums = _dense if (many[u] + 1) * (many[v] + 1) <= DENSE else _halved
    out = np.empty(len(w))
    out[order] = sums(codes[u][order], codes[v][order], (strict[u], strict[v]), w[order])
    return out


class Cuts:
    """Where a group is cut into strips along the three orders. Coordinates are told apart only as far as the cuts do."""

    def __init__(self, sample: list[np.ndarray], strips: int):
        n = len(sample[0])
        ends = np.unique(np.arange(1, strips) * n // strips) if n else np.zeros(0, np.int64)
        chosen = [np.lexsort([sample[d] for d in reversed(order)])[ends] for order in ORDERS]
        self.values = [np.unique(x[np.concatenate(chosen)]) for x in sample]
        self.starts = [np.unique(self._code([x[rows] for x in sample], order)) for rows, order in zip(chosen, ORDERS, strict=True)]

    def _code(self, at: list[np.ndarray], order: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(at[0]), np.int64)
        for d in order:
            out = out * (2 * len(self.values[d]) + 1) + np.searchsorted(self.values[d], at[d]) + np.searchsorted(self.values[d], at[d], "right")
        return out

    def strips(self, at: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(starts, self._code(at, order), "right") for starts, order in zip(self.starts, ORDERS, strict=True)]


def _cell_sums(cells: pd.DataFrame) -> dict[int, np.ndarray]:
    """Of each group (its first strip) and cell, the mass of the cells that are later along all orders."""
    out = {}
    for first, rows in cells.groupby("g"):
        c = [rows[f"c{d}"].to_numpy() for d in range(3)]
        cube = np.zeros([x.max() + 2 for x in c])
        cube[c[0], c[1], c[2]] = rows["p"].to_numpy()
        for axis in range(3):
            cube = np.flip(np.cumsum(np.flip(cube, axis), axis=axis), axis)
        out[int(first)] = np.ascontiguousarray(cube[1:, 1:, 1:])
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    return table if table is not None and table.num_rows else None


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _within(points: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Groups that fit in a task."""
    dealt = points.repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        ends = np.flatnonzero(np.diff(_groups(table, keys), append=-1)) + 1
        at, p, mass, first = [_column(table, c) for c in PLACE], _column(table, "p"), np.zeros(table.num_rows), 0
        for end in ends:
            mass[first:end] = dominated_sums([x[first:end] for x in at], (False, False, False), p[first:end])
            first = end
        yield from table.append_column("mass", pa.array(mass)).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("mass", T.DoubleType())]))


def _placed(points: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """Points (g, d0, d1, d2, p) with their strips c0, c1, c2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, at = batch.column("g").to_numpy(), [batch.column(c).to_numpy() for c in PLACE]
            c = np.zeros((3, len(g)), np.int32)
            for first in np.unique(g):
                rows = np.flatnonzero(g == first)
                c[:, rows] = cuts[int(first)].strips([x[rows] for x in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, c), pa.array(np.zeros(len(g)))], [*batch.schema.names, "c0", "c1", "c2", "mass"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, *[T.StructField(f"c{d}", T.IntegerType()) for d in range(3)], T.StructField("mass", T.DoubleType())]))


def _met(table: DataFrame, turn: int, first: int, strips: int, beyond: dict[int, np.ndarray]) -> DataFrame:
    """``table`` with what is met in the strips of an order, from the first so many, added to mass; ``beyond``: sums over cells."""
    number = F.col("g") + F.col(f"c{turn}")
    dealt = table.where((number >= first) & (number < first + strips)).repartitionById(strips, number - first)
    strict = (turn > 0, turn > 1, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        g, c, p, mass = _column(table, "g"), [_column(table, f"c{d}") for d in range(3)], _column(table, "p"), _column(table, "mass").copy()
        at = [c[d] if strict[d] else _column(table, PLACE[d]) for d in range(3)]
        strip = g + c[turn]
        for s in np.unique(strip):
            rows = np.flatnonzero(strip == s)
            mass[rows] += dominated_sums([x[rows] for x in at], strict, p[rows])
            if beyond:
                mass[rows] += beyond[int(g[rows[0]])][tuple(x[rows] for x in c)]
        yield from table.set_column(table.column_names.index("mass"), "mass", pa.array(mass)).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, table.schema)


def masses(tables: dict[str, DataFrame], keys: list[str], folder: str, strip_points: int) -> DataFrame:
    """Points (keys, d0, d1, d2, p) with the mass that each dominates in its group. They are in tables below the folder, which go
    when they are no longer read."""
    points = joined(list(tables.values()))
    spark = points.sparkSession
    ship(spark.sparkContext)
    parallel, total, n = spark.sparkContext.defaultParallelism, points.count(), F.col("count")
    wanted = F.greatest(F.ceil(n / strip_points), F.least(F.ceil(n * parallel / max(1, total)), F.floor(n / LEAST_POINTS)))
    wide, first = [], 0  # as many rows as strips at most
    for row in points.groupBy(*keys).count().withColumn("strips", F.least(F.lit(MAX_STRIPS), wanted).cast("int")).where("strips > 1").collect():
        wide.append((*[row[k] for k in keys], first, row["strips"], row["count"]))
        first += row["strips"]
    tasks = max(parallel, -(-total // strip_points))
    if not wide:
        found = materialize(_within(points, keys, tasks), folder, "space-within")
        for name in tables:
            discard(spark, folder, name)
        return found
    large = sum(x[-1] for x in wide)
    named = F.broadcast(spark.createDataFrame([x[:-2] for x in wide], T.StructType([*points.select(*keys).schema.fields, T.StructField("g", T.IntegerType())])))
    rows = points.join(named, keys).select("g", *PLACE, "p")
    sample = rows.where(F.pmod(F.xxhash64(*PLACE), F.lit(max(1, large // (SAMPLED * first)))) == 0).select("g", *PLACE).toPandas()
    cuts = {x[-3]: Cuts([sample.loc[sample["g"] == x[-3], c].to_numpy() for c in PLACE], x[-2]) for x in wide}
    names = ["space-placed"]
    table = materialize(_placed(rows, cuts), folder, names[0])
    small = [materialize(_within(points.join(named, keys, "left_anti"), keys, tasks), folder, "space-within")] if large < total else []
    for name in tables:
        discard(spark, folder, name)
    cells = _cell_sums(table.groupBy("g", "c0", "c1", "c2").agg(F.sum("p").alias("p")).toPandas())
    at_once = max(parallel, SLICE_ROWS * first // large)
    for turn in range(3):
        before, names, parts = names, [], []
        for a in range(0, first, at_once):
            names.append(f"space-{turn}-{a}")
            parts.append(materialize(_met(table, turn, a, min(at_once, first - a), cells if turn == 2 else {}), folder, names[-1]))
        table = joined(parts)
        for name in before:
            discard(spark, folder, name)
    return joined([table.join(named, "g").select(*keys, *PLACE, "p", "mass"), *small])
