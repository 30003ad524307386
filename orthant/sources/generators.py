"""Generated inputs: query points, rules, uniform, clustered and Zipf-distributed uncertain objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def query_offset(query_id: Column) -> Column:
    """The number of an id q<number>, else 0."""
    return F.coalesce(F.regexp_extract(query_id, r"^q(\d{1,9})$", 1).try_cast("int"), F.lit(0))


def default_query_points(ids: DataFrame, dims: int) -> DataFrame:
    """Query points of ids: each coordinate is 0.2 + 0.15 * number + 0.05 * dimension, within [0, 1]."""
    n = query_offset(F.col("query_id"))
    return ids.select("query_id", *[F.round(clamp(F.lit(0.2) + n * 0.15 + 0.05 * d), 9).alias(f"q{d}") for d in range(dims)])


def synthetic_events(spark: SparkSession, objects: int = 500, dims: int = 4, queries: int = 2, missing_rate: float = 0.2, seed: int = 42, start_ms: int = 1_700_000_000_000, gap_ms: int = 20) -> DataFrame:
    """Clustered events of every object for every query, some attributes missing."""
    rows = spark.range(objects * queries).withColumns({"o": F.expr(f"id div {queries}"), "q": F.col("id") % queries})
    centre = (F.col("o") % 17) / 17.0 * 0.45
    attr = lambda d: F.when(F.rand(seed + 100 + d) >= missing_rate, clamp(centre + F.rand(seed + d) * 0.55)).alias(f"a{d}")
    return rows.select(F.concat(F.lit("object-"), F.col("o").cast("string")).alias("object_id"), F.concat(F.lit("object-"), F.col("o").cast("string"), F.lit("#"), F.col("q").cast("string")).alias("instance_id"), F.concat(F.lit("q"), F.col("q").cast("string")).alias("query_id"), F.timestamp_millis(F.lit(start_ms) + F.col("id") * gap_ms).alias("event_time"), F.lit("UPSERT").alias("op_type"), F.lit(1.0).alias("p"), F.lit(-1).alias("server_partition"), *[attr(d) for d in range(dims)])


def _with_instances(objects: DataFrame, low: int, high: int, seed: int, weight: Column) -> DataFrame:
    n = (F.floor(F.rand(seed + 7) * (high - low + 1)) + low).cast("int")
    each = objects.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("w", weight)
    return each.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("object_id")))


def region_objects(spark: SparkSession, n: int, kind: str = "uniform", max_side: float = 1.0, partitions: int = 8, seed: int = 42) -> DataFrame:
    """Square regions in [0, 100]^2 with 5 to 11 equally likely points each; centres are uniform, gaussian or
    zipf (over 100 ranks)."""
    ranks = [sum(1 / r for r in range(1, i + 1)) for i in range(1, 101)]
    zipf = lambda s: F.size(F.filter(F.array(*[F.lit(x / ranks[-1]) for x in ranks]), lambda e: e < F.rand(s))).cast("double")
    centre = {"uniform": lambda s: F.rand(s) * 100, "gaussian": lambda s: F.lit(50.0) + F.randn(s) * 15, "zipf": lambda s: zipf(s) + F.rand(s + 50)}[kind]
    base = spark.range(n).select(F.col("id").alias("object_id"), centre(seed).alias("x"), centre(seed + 1).alias("y"), (F.rand(seed + 2) * max_side / 2).alias("h"))
    edge = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
    boxed = base.select("object_id", edge(F.col("x") - F.col("h")).alias("mbr_lo0"), edge(F.col("y") - F.col("h")).alias("mbr_lo1"), edge(F.col("x") + F.col("h")).alias("mbr_hi0"), edge(F.col("y") + F.col("h")).alias("mbr_hi1"))
    inst = _with_instances(boxed, 5, 11, seed, F.lit(1.0))
    inside = lambda d: (F.col(f"mbr_lo{d}") + F.rand(seed + 20 + d) * (F.col(f"mbr_hi{d}") - F.col(f"mbr_lo{d}"))).alias(f"a{d}")
    return inst.select("object_id", F.concat_ws("-", "object_id", "i").alias("instance_id"), "p", (F.col("object_id") % partitions).cast("int").alias("part"), inside(0), inside(1), "mbr_lo0", "mbr_lo1", "mbr_hi0", "mbr_hi1")


def smartphone_objects(spark: SparkSession, n: int = 750, partitions: int = 8, seed: int = 42) -> DataFrame:
    """Objects around (price, battery) centres with 8 to 20 normally spread instances and random weights."""
    base = spark.range(n).select(F.col("id").alias("object_id"), F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))
    inst = _with_instances(base, 8, 20, seed, F.rand(seed + 3) + 0.01)
    return inst.select("object_id", F.concat_ws("-", "object_id", "i").alias("instance_id"), "p", (F.col("object_id") % partitions).cast("int").alias("part"), clamp(F.col("x") + F.randn(seed + 4) * 0.05).alias("a0"), clamp(F.col("y") + F.randn(seed + 5) * 0.05).alias("a1"))


def query_set(spark: SparkSession, instances: DataFrame, n: int, dims: int = 2, seed: int = 42) -> DataFrame:
    """n uniform query points in the extent of the instances."""
    extent = instances.agg(*[f(f"a{d}").alias(f"{k}{d}") for d in range(dims) for f, k in ((F.min, "lo"), (F.max, "hi"))])
    return spark.range(n).crossJoin(extent).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), *[(F.col(f"lo{d}") + F.rand(seed + d) * (F.col(f"hi{d}") - F.col(f"lo{d}"))).alias(f"q{d}") for d in range(dims)])
