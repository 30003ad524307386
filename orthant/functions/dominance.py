"""Dominance as column expressions.

Relative to a query point a row has distances d0..dn-1 (|attribute - query coordinate|). ``a``
dominates ``b`` if none of its distances is larger and one is smaller. Boxes have, per dimension, the
least (m0..) and largest (x0..) distance of any of their points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def distance(attr: Column, q: Column) -> Column:
    return F.abs(attr - q)


def interval_min_distance(lo: Column, hi: Column, q: Column) -> Column:
    """0 inside the interval, else the distance to the nearer edge."""
    return F.greatest(lo - q, q - hi, F.lit(0.0))


def interval_max_distance(lo: Column, hi: Column, q: Column) -> Column:
    return F.greatest(F.abs(lo - q), F.abs(hi - q))


def no_farther(left: list[Column], right: list[Column]) -> Column:
    """left <= right in all dimensions and < in one."""
    all_le = reduce(lambda a, b: a & b, [x <= y for x, y in zip(left, right, strict=True)])
    return all_le & reduce(lambda a, b: a | b, [x < y for x, y in zip(left, right, strict=True)])


def cols(alias: str, prefix: str, dims: int) -> list[Column]:
    return [F.col(f"{alias}.{prefix}{d}" if alias else f"{prefix}{d}") for d in range(dims)]


def dominates(a: str, b: str, dims: int) -> Column:
    """Row a dominates row b (both aliases have d0..)."""
    return no_farther(cols(a, "d", dims), cols(b, "d", dims))


def dominates_box_fully(a: str, box: str, dims: int) -> Column:
    """Row a dominates whatever lies in the box."""
    return no_farther(cols(a, "d", dims), cols(box, "m", dims))


def dominates_box_possibly(a: str, box: str, dims: int) -> Column:
    """Something in the box may be dominated by row a."""
    return no_farther(cols(a, "d", dims), cols(box, "x", dims))


def box_could_dominate_box(a: str, b: str, dims: int) -> Column:
    """Something in box a may dominate something in box b."""
    return no_farther(cols(a, "m", dims), cols(b, "x", dims))


def dominates_arrays(a: Column, b: Column) -> Column:
    """The same for arrays of distances of any length."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda z: z) & F.exists(F.zip_with(a, b, lambda x, y: x < y), lambda z: z)


def register_sql(spark: SparkSession) -> None:
    """``dominates(a, b)`` over arrays of doubles as a function of the session's SQL."""
    spark.sql("create or replace temporary function dominates(a array<double>, b array<double>) returns boolean return forall(zip_with(a, b, (x, y) -> x <= y), z -> z) and exists(zip_with(a, b, (x, y) -> x < y), z -> z)")


def string_hash(s: Column) -> Column:
    """The 32-bit polynomial hash of a string's UTF-16 units (base 31), for ids within the BMP."""
    wrap = lambda h: (h + F.lit(2**31)).bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(wrap(h * 31 + F.ascii(c))))


def partition_of(server: Column, object_id: Column, partitions: int) -> Column:
    """The declared partition modulo their number, else the id's hash modulo it."""
    n = F.lit(partitions)
    return F.coalesce(F.pmod(F.when(server >= 0, server), n), F.pmod(string_hash(object_id.cast("string")), n)).cast("int")
