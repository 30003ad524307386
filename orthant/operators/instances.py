"""Instance tables: query points, distances, object summaries, audits and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.dominance import distance
from orthant.storage import shared_dir

from .ranks import numbered

SHARED_QUERY = "__shared_query_input__"


def with_distances(instances: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """Every instance for every query point that it belongs to, with d0.. . Instances without a query_id
    column, or of the shared input id, belong to all query points."""
    keep = [c for c in instances.columns if c != "query_id"]
    q = F.broadcast(queries.select("query_id", *[f"q{d}" for d in range(dims)]))  # of unknown size, else instances are made anew for each of its partitions
    if "query_id" in instances.columns:
        own = instances.where(F.col("query_id") != SHARED_QUERY).join(q, "query_id")
        both = own.unionByName(instances.where(F.col("query_id") == SHARED_QUERY).select(*keep).crossJoin(q))
    else:
        both = instances.crossJoin(q)  # one row for each query point, by definition of the query set
    return both.select("query_id", *keep, *[distance(F.col(f"a{d}"), F.col(f"q{d}")).alias(f"d{d}") for d in range(dims)])


def upserts(events: DataFrame) -> DataFrame:
    return events.where(F.upper("op_type") == "UPSERT")


def latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key if it is an upsert (deletes remove)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return upserts(events.withColumn("_rank", rank).where("_rank = 1").drop("_rank"))


def object_summary(instances: DataFrame, dims: int, keys: list[str] = ("object_id",)) -> DataFrame:
    """Instances, mass, bounding box (lo0.., hi0..) and centroid (c0..) of each object."""
    box = [f(f"a{d}").alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "c"))]
    return instances.groupBy(*keys).agg(F.count("*").alias("n_inst"), F.sum("p").alias("mass"), F.min("part").alias("part"), *box)


def probability_audit(instances: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Objects whose probabilities don't sum to 1, or that lie in several partitions."""
    found = instances.groupBy("query_id", "object_id").agg(F.sum("p").alias("mass"), F.count_distinct("part").alias("n_parts"))
    return found.withColumns({"bad_mass": F.abs(F.col("mass") - 1) > tolerance, "bad_parts": F.col("n_parts") > 1})


def containment_audit(instances: DataFrame, dims: int) -> DataFrame:
    """Instances outside their declared boxes (mbr_lo0.., mbr_hi0..)."""
    outside = [(F.col(f"a{d}") < F.col(f"mbr_lo{d}")) | (F.col(f"a{d}") > F.col(f"mbr_hi{d}")) for d in range(dims)]
    bad = outside[0]
    for x in outside[1:]:
        bad = bad | x
    return instances.where(bad)


def profile(rows: DataFrame, dims: int, keys: list[str] = ()) -> DataFrame:
    """Rows, objects, missing values and extents, in one pass."""
    per_dim = [e for d in range(dims) for e in (F.count_if(F.col(f"a{d}").isNull()).alias(f"missing_a{d}"), F.min(f"a{d}").alias(f"min_a{d}"), F.max(f"a{d}").alias(f"max_a{d}"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("object_id").alias("n_objects"), *per_dim)


def partition_index(instances: DataFrame, dims: int) -> DataFrame:
    """Objects, instances and extent of each partition."""
    return instances.groupBy("part").agg(F.count_distinct("object_id").alias("n_objects"), F.count("*").alias("n_inst"), *[f(f"a{d}").alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))])


def holdout(rows: DataFrame, order: list[str], every: int = 5) -> DataFrame:
    """``in_holdout``: each fifth row of a query. If nothing is left to train on, train on all."""
    placed = numbered(rows, ["query_id"], order, shared_dir(rows.sparkSession), "holdout", "_place")
    return placed.withColumn("in_holdout", F.col("_place") % every == 0).drop("_place")
