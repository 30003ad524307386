"""Score bounds, thresholds, pruning, emission counts, traces and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.dominance import dominates
from orthant.storage import materialize, shared_dir

from . import plane
from .score import dominated_mass, objects_of, rounded, scores, top_k

KEY = ["query_id", "object_id"]


def partition_bounds(inst: DataFrame, dims: int, method: str = "auto", candidates: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Bounds without boxes: lb is the score within the own partition, ub adds the object's mass
    times the mass of other partitions (once). The window runs over one row for each partition."""
    local = dominated_mass(inst, dims, ["query_id", "part"], candidates, method, own).withColumnRenamed("score", "lb")
    masses = inst.groupBy("query_id", "part").agg(F.sum("p").alias("part_mass"))
    masses = masses.withColumn("all_mass", F.sum("part_mass").over(Window.partitionBy("query_id")))
    objects = objects_of(inst) if candidates is None else objects_of(inst).join(candidates, KEY, "left_semi")
    found = objects.join(local, KEY, "left").na.fill(0.0, ["lb"]).join(masses, ["query_id", "part"])
    remote = F.col("all_mass") - F.col("part_mass")
    return found.select(*KEY, "part", "n_inst", "mass", rounded("lb").alias("lb"), rounded(F.col("lb") + F.col("mass") * remote).alias("ub"))


def thresholds(bounds: DataFrame, k: int, scope: str = "both") -> DataFrame:
    """tau of each (query_id, part): the k-th largest lower bound of the partition, of the query, or
    the larger; null (nothing is pruned) with fewer than k objects."""
    ranked = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lb"), "object_id"))
    kth = lambda keys, name: bounds.withColumn("r", ranked(keys)).where(F.col("r") == k).select(*keys, F.col("lb").alias(name))
    parts = bounds.select("query_id", "part").distinct()
    both = parts.join(kth(["query_id", "part"], "tau_local"), ["query_id", "part"], "left").join(kth(["query_id"], "tau_global"), "query_id", "left")
    tau = {"both": F.greatest("tau_local", "tau_global"), "partition": F.col("tau_local"), "global": F.col("tau_global")}[scope]
    return both.withColumn("tau", tau)


def pruned(bounds: DataFrame, k: int, scope: str = "both") -> DataFrame:
    """bounds with tau and ``survives`` (ub >= tau; ties survive)."""
    tau = thresholds(bounds, k, scope).select("query_id", "part", "tau")
    return bounds.join(tau, ["query_id", "part"]).withColumn("survives", F.col("tau").isNull() | (F.col("ub") >= F.col("tau")))


def pruned_top_k(inst: DataFrame, bounds: DataFrame, dims: int, k: int, scope: str = "both", method: str = "auto", own: DataFrame | None = None) -> DataFrame:
    """Survivors are scored against all instances."""
    bounds = materialize(bounds, shared_dir(inst.sparkSession), "bounds")
    left = pruned(bounds, k, scope).where("survives")
    exact = scores(inst, dims, left.select(*KEY), method, own)
    return top_k(exact.join(bounds.select(*KEY, "lb", "ub"), KEY), k)


def false_prunes(marked: DataFrame, exact_top: DataFrame) -> DataFrame:
    """Per query: objects, pruned ones, and true answers among them (must be 0)."""
    lost = exact_top.select(*KEY).join(marked.where("survives").select(*KEY), KEY, "left_anti").groupBy("query_id").agg(F.count("*").alias("false_prunes"))
    counts = marked.groupBy("query_id").agg(F.count("*").alias("objects"), F.count_if(~F.col("survives")).alias("pruned"))
    return counts.join(lost, "query_id", "left").select("query_id", "objects", "pruned", (F.col("objects") - F.col("pruned")).alias("refined"), F.coalesce("false_prunes", F.lit(0)).cast("long").alias("false_prunes"))


def traces(marked: DataFrame, pruned_name: str = "pruned-by-dscp", limit: int = 25) -> DataFrame:
    """The decision for the first objects of each query, by id; what the index skipped (``skipped``) is told apart."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("object_id"))
    decision = F.when(F.col("survives"), "survived").otherwise(pruned_name)
    if "skipped" in marked.columns:
        decision = F.when(F.col("skipped"), "pruned-by-index").otherwise(decision)
    return marked.withColumn("decision", decision).withColumn("n", first).where(F.col("n") <= limit).drop("n")


def emission_counts(inst: DataFrame, marked: DataFrame) -> DataFrame:
    """Shuffle records of survivors without boxes: one for each (instance, competitor), or one for each
    instance when they are packed; competitors are the other objects' instances of the partition."""
    objects = objects_of(inst)
    parts = objects.groupBy("query_id", "part").agg(F.count("*").alias("part_objects"))
    own = objects.join(parts, ["query_id", "part"]).join(marked.where("survives").select(*KEY), KEY, "left_semi")
    out = own.groupBy("query_id").agg(F.sum(F.col("n_inst") * (F.col("part_objects") - 1)).alias("baseline_emissions"), F.sum("n_inst").alias("aes_emissions"))
    return out.withColumn("aer", rounded(F.when(F.col("baseline_emissions") == 0, 0.0).otherwise(F.col("aes_emissions") / F.col("baseline_emissions"))))


def treatment_emissions(inst: DataFrame, marked: DataFrame, packed: bool) -> DataFrame:
    """Per query the records that a treatment emits for its survivors: packed (one for each instance) or not."""
    counts = emission_counts(inst, marked)
    return counts.select("query_id", (F.col("aes_emissions") if packed else F.col("baseline_emissions")).alias("emissions"))


def emissions(inst: DataFrame, packed: bool) -> DataFrame:
    """The records themselves: an instance with its competitors (packed) or with each of them."""
    others = inst.select("query_id", "part", F.col("object_id").alias("competitor")).distinct()
    pairs = inst.select("query_id", "part", "object_id", "instance_id").join(others, ["query_id", "part"]).where("competitor <> object_id")
    return pairs.groupBy("query_id", "part", "object_id", "instance_id").agg(F.sort_array(F.collect_list("competitor")).alias("competitors")) if packed else pairs


def certified_bounds(inst: DataFrame, dims: int, k: int) -> DataFrame:
    """Bounds around the exact score by the best instance's probability; tau, and what it prunes."""
    best = inst.groupBy(*KEY).agg(F.max("p").alias("best"), F.sum("p").alias("mass"))
    total = inst.groupBy("query_id").agg(F.sum("p").alias("total"))
    found = scores(inst, dims).join(best, KEY).join(total, "query_id").withColumn("remaining", F.col("total") - F.col("mass"))
    found = found.select(*KEY, "n_inst", rounded("score").alias("score"), rounded(F.greatest(F.col("score") - F.col("best"), F.lit(0.0))).alias("lb"), rounded(F.least(F.col("remaining"), F.col("score") + F.col("best"))).alias("ub"))
    tau = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lb"), "object_id"))).where(F.col("r") == k).select("query_id", F.col("lb").alias("tau"))
    return found.join(tau, "query_id", "left").withColumn("survives", F.col("tau").isNull() | (F.col("ub") >= F.col("tau")))


def proxy_scores(inst: DataFrame, dims: int) -> DataFrame:
    """A cheap stand-in for the score: sum of p * (dims - L1 distance)."""
    l1: Column = F.lit(0.0)
    for d in range(dims):
        l1 = l1 + F.col(f"d{d}")
    return inst.groupBy(*KEY, "part").agg(rounded(F.sum(F.col("p") * (F.lit(float(dims)) - l1))).alias("proxy"))


def best_proxies(proxies: DataFrame, n: int | Column, keys: list[str]) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("proxy"), "object_id"))
    return proxies.withColumn("r", order).where(F.col("r") <= n).drop("r")


def proxy_top_k(inst: DataFrame, dims: int, k: int, limit: int) -> DataFrame:
    """Approximate: the best max(k, limit) by proxy are scored exactly."""
    chosen = best_proxies(proxy_scores(inst, dims), max(k, limit), ["query_id"])
    return top_k(scores(inst, dims, chosen.select(*KEY)), k)


def partitioned_top_k(inst: DataFrame, dims: int, k: int, parts: int, multiplier: int = 4) -> DataFrame:
    """Approximate: the best of each partition by proxy, together, are scored exactly."""
    each = max(k, -(-k * multiplier // parts))
    chosen = best_proxies(proxy_scores(inst, dims), each, ["query_id", "part"])
    return top_k(scores(inst, dims, chosen.select(*KEY)), k)


def precision_at_k(exact: DataFrame, guess: DataFrame) -> DataFrame:
    hits = exact.join(guess.select(*KEY).withColumn("hit", F.lit(1)), KEY, "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("hits"))
    return hits.withColumn("precision", rounded(F.when(F.col("n_exact") == 0, 1.0).otherwise(F.col("hits") / F.col("n_exact"))))


def centroid_skyline(summaries: DataFrame, dims: int, k: int) -> DataFrame:
    """Objects (query_id, part, object_id, d0.. of centroids) with the number of centroids of their partition
    that dominate theirs; ``kept`` if fewer than k. In the plane these are counted as what is dominated
    once the axes are turned round; in more dimensions centroids are compared."""
    keys = ["query_id", "part"]
    if dims == 2:
        turned = summaries.groupBy(*keys, (-F.col("d0")).alias("x"), (-F.col("d1")).alias("y")).agg(F.count("*").cast("double").alias("w")).withColumn("role", F.lit(0))
        found = plane.masses(turned, keys, shared_dir(summaries.sparkSession), "skyline").select(*keys, (-F.col("x")).alias("d0"), (-F.col("y")).alias("d1"), F.col("sum_w").cast("long").alias("dominators"))
        counted = summaries.join(found, [*keys, "d0", "d1"]).select(*KEY, "part", "dominators")
    else:
        a, b = summaries.alias("a"), summaries.alias("b")
        over = b.join(a, [F.col("a.query_id") == F.col("b.query_id"), F.col("a.part") == F.col("b.part"), F.col("a.object_id") != F.col("b.object_id"), dominates("b", "a", dims)])
        counts = over.groupBy("a.query_id", "a.object_id").agg(F.count("*").alias("dominators"))
        counted = summaries.select(*KEY, "part").join(counts, KEY, "left").na.fill(0, ["dominators"])
    return counted.withColumn("kept", F.col("dominators") < k)


def box_bounds(inst: DataFrame, dims: int) -> DataFrame:
    """An upper bound of each object from boxes of objects alone: its mass times the mass of all whose farthest corner
    its nearest corner dominates. Objects are few beside instances. Two dimensions."""
    corners = inst.groupBy(*KEY).agg(F.sum("p").alias("mass"), *[f(f"d{d}").alias(f"{n}{d}") for d in range(dims) for f, n in ((F.min, "m"), (F.max, "x"))])
    corners = materialize(corners, shared_dir(inst.sparkSession), "corners")
    asked = corners.select("query_id", F.col("m0").alias("x"), F.col("m1").alias("y"), F.lit(1).alias("role"), F.lit(0.0).alias("w"))
    given = corners.select("query_id", F.col("x0").alias("x"), F.col("x1").alias("y"), F.lit(0).alias("role"), F.col("mass").alias("w"))
    points = asked.union(given).groupBy("query_id", "x", "y", "role").agg(F.sum("w").alias("w"))
    found = plane.masses(points, ["query_id"], shared_dir(inst.sparkSession), "boxes").where("role = 1").select("query_id", F.col("x").alias("m0"), F.col("y").alias("m1"), "sum_w")
    return corners.join(found, ["query_id", "m0", "m1"]).select(*KEY, rounded(F.col("mass") * F.col("sum_w")).alias("box_ub"))
