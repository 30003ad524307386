"""Sums over dominated points in the plane, in n log n, for data of any size.

Of a point in a group, ``masses`` gives the summed weights of the group's points that are neither nearer in x
nor in y and come later in both orders (x, y, role) and (y, x, role). Different points of one role so mean
dominance; with roles, equal points count if the asking one has the lower role, else not.

1. Range partitions by (group, x, y, role) are strips of x; within one, later and higher points are summed by
   merging halves (numpy, all groups and points of a strip at once).
2. Only groups at an edge of a strip of x can lie in several; all others are done. Range partitions of the
   former by (group, y, x, role) are strips of y; within one, points of later strips of x are summed in the same way.
3. Whole cells that are later in both kinds of strips are summed by two running sums over the cells.

Strips are cut by the points themselves, so ties in one coordinate don't make one large. Equal points of a
group must be merged before. Each step is written, as the strips of later steps refer to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthant.shipping import ship
from orthant.storage import discard, materialize

#: Points of a strip, and the most strips (the cells are at most their square).
STRIP_POINTS, MAX_STRIPS = 100_000, 1024


def later_and_higher(y: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For points in order of x with the ranks y (a permutation): the sums of each weight over the points
    behind with a larger rank. Halves are merged from the whole down to pairs, without sorting."""
    n = len(y)
    out = [np.zeros(n) for _ in weights]
    at = np.empty(n, np.int64)
    at[n - 1 - y] = np.arange(n)  # places by falling rank
    index = np.arange(n)
    for level in reversed(range(max(n - 1, 0).bit_length())):
        right = (at >> level) & 1
        start = index >> (level + 1) << (level + 1)  # of the block, which holds just its own places
        seen = np.cumsum(right)
        for w, sums in zip(weights, out, strict=True):
            total = np.concatenate(([0.0], np.cumsum(w[at] * right)))
            left = right == 0
            sums[at[left]] += total[index[left]] - total[start[left]]
        rights = seen - right - np.concatenate(([0], seen))[start]  # before a place, in its block
        size = np.minimum(1 << level, n - start)
        moved = np.empty(n, np.int64)
        moved[np.where(right == 1, start + size + rights, index - rights)] = at
        at = moved
    return out


def dominated_sums(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same for points in memory, repeated ones among them: of each the weight that it dominates in its group."""
    points, which = np.unique(np.column_stack([group, x, y]), axis=0, return_inverse=True)
    which = which.ravel()
    merged = np.bincount(which, w, len(points))
    rank = np.empty(len(points), np.int64)
    rank[np.lexsort((points[:, 1], points[:, 2], -points[:, 0]))] = np.arange(len(points))
    return later_and_higher(rank, [merged])[0][which]


class Standing:
    """Points that stay, with weights, to ask for the sum that a point dominates among them. They lie in order of (x, y)
    and are parted by the bits of their ranks in y, the highest first; each bit has running counts and sums."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.x, at_x = np.unique(x, return_inverse=True)
        self.y, at_y = np.unique(y, return_inverse=True)
        self.sorted_y = np.sort(y)
        key = at_x.astype(np.int64) * (len(self.y) + 1) + at_y + 1
        order = np.argsort(key, kind="stable")
        self.keys, w = key[order], w[order]
        rank = np.empty(len(x), np.int64)
        rank[np.argsort(at_y[order], kind="stable")] = np.arange(len(x))
        self.levels = []
        for level in reversed(range(len(x).bit_length())):
            one = (rank >> level) & 1
            ones = np.concatenate(([0], np.cumsum(one)))
            self.levels.append((level, len(x) - int(ones[-1]), ones, np.concatenate(([0], np.cumsum(w * one)))))
            split = np.argsort(one, kind="stable")
            rank, w = rank[split], w[split]
        self.last = np.concatenate(([0], np.cumsum(w)))

    def dominated(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For asking points, best in order of (x, y): the summed weights of other points that aren't nearer."""
        if not len(self.keys) or not len(x):
            return np.zeros(len(x), self.last.dtype)
        at = np.searchsorted(self.x, x)
        equal = self.x[np.minimum(at, len(self.x) - 1)] == x
        key = at * (len(self.y) + 1) + np.where(equal, np.searchsorted(self.y, y, "right"), 0)
        left, right = np.searchsorted(self.keys, key, "right"), np.full(len(x), len(self.keys))
        rank = np.searchsorted(self.sorted_y, y)
        out = np.zeros(len(x), self.last.dtype)
        for level, zeros, ones, sums in self.levels:
            high = (rank >> level) & 1 == 1
            out += np.where(high, 0, sums[right] - sums[left])
            a, b = ones[left], ones[right]
            left, right = np.where(high, zeros + a, left - a), np.where(high, zeros + b, right - b)
        return out + self.last[right] - self.last[left]


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of runs of equal keys in a sorted table."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def in_x_strip(table: pa.Table, keys: list[str], weights: list[str]) -> list[np.ndarray]:
    """Sums within a strip that is sorted by (keys, x, y, role). Ranks fall from group to group, so that
    a later group is never higher."""
    group = _groups(table, keys)
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort((_column(table, "role"), _column(table, "x"), _column(table, "y"), -group))] = np.arange(len(group))
    return later_and_higher(rank, [_column(table, w) for w in weights])


def in_y_strip(table: pa.Table, keys: list[str], weights: list[str]) -> list[np.ndarray]:
    """Sums within a strip that is sorted by (keys, y, x, role), over points of later strips ``cx`` of x only."""
    group, place = _groups(table, keys), np.arange(table.num_rows)
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort((place, -group))] = place
    order = np.lexsort((-place, _column(table, "cx"), group))
    out = []
    for got in later_and_higher(rank[order], [_column(table, w)[order] for w in weights]):
        back = np.empty(len(got))
        back[order] = got
        out.append(back)
    return out


def _stripped(points: DataFrame, strips: int, keys: list[str], order: list[str], name: str, weights: list[str], within, edges: bool = False) -> DataFrame:
    """points with the number of their strip as ``name`` and the sums added to sum_w of each weight. With ``edges``
    also ``edge``: whether the group is the first or the last of its strip."""
    ship(points.sparkSession.sparkContext)
    had = set(points.columns)
    dealt = points.repartitionByRange(strips, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(name, F.spark_partition_id())
    for w in weights:
        if f"sum_{w}" not in had:
            dealt = dealt.withColumn(f"sum_{w}", F.lit(0.0))
    if edges:
        dealt = dealt.withColumn("edge", F.lit(False))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in dealt.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(whole) if (whole := list(batches)) else None
        if table is None or not table.num_rows:
            return
        for w, got in zip(weights, within(table, keys, weights), strict=True):
            at = table.column_names.index(f"sum_{w}")
            table = table.set_column(at, f"sum_{w}", pa.array(_column(table, f"sum_{w}") + got))
        if edges:
            group = _groups(table, keys)
            table = table.set_column(table.column_names.index("edge"), "edge", pa.array((group == group[0]) | (group == group[-1])))
        yield from table.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


def masses(points: DataFrame, keys: list[str], folder: str, name: str, weights: tuple[str, ...] = ("w",)) -> DataFrame:
    """points (keys, x, y, role, weights) with sum_w for each weight w."""
    weights = list(weights)
    columns = [*keys, "x", "y", "role", *weights]
    points = materialize(points.select(*columns), folder, f"{name}-points")
    strips = max(1, min(MAX_STRIPS, -(-points.count() // STRIP_POINTS)))
    spark = points.sparkSession
    strips = max(strips, min(spark.sparkContext.defaultParallelism, MAX_STRIPS))
    first = materialize(_stripped(points, strips, keys, ["x", "y", "role"], "cx", weights, in_x_strip, edges=True), folder, f"{name}-x")
    discard(spark, folder, f"{name}-points")
    done = first.where("not edge").select(*columns, *[f"sum_{w}" for w in weights])
    second = materialize(_stripped(first.where("edge").drop("edge"), strips, keys, ["y", "x", "role"], "cy", weights, in_y_strip), folder, f"{name}-y")
    cells = second.groupBy(*keys, "cx", "cy").agg(*[F.sum(w).alias(w) for w in weights])
    # Only groups of several strips of both kinds have cells beyond others.
    wide = cells.groupBy(*keys).agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1")).where("x0 < x1 and y0 < y1").select(*keys)
    cells = materialize(cells.join(wide, keys, "left_semi"), folder, f"{name}-cells")
    grid = cells.select(*keys, "cx").distinct().join(cells.select(*keys, "cy").distinct(), keys).join(cells, [*keys, "cx", "cy"], "left").na.fill(0.0, weights)
    beyond = lambda fixed, moving: Window.partitionBy(*keys, fixed).orderBy(F.desc(moving)).rowsBetween(Window.unboundedPreceding, -1)
    above = grid.select(*keys, "cx", "cy", *[F.coalesce(F.sum(w).over(beyond("cx", "cy")), F.lit(0.0)).alias(f"above_{w}") for w in weights])
    full = above.select(*keys, "cx", "cy", *[F.coalesce(F.sum(f"above_{w}").over(beyond("cy", "cx")), F.lit(0.0)).alias(f"full_{w}") for w in weights])
    several = second.join(full, [*keys, "cx", "cy"], "left").select(*columns, *[(F.col(f"sum_{w}") + F.coalesce(f"full_{w}", F.lit(0.0))).alias(f"sum_{w}") for w in weights])
    return done.union(several)
