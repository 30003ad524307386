"""The engine's queries over the driver's tables and the same in DuckDB's SQL.

U1: objects are parts, instances all their line items, each with p = 1/n, attributes quantity/50 and price/100000 (and
discount*10). Their distances are read several times by one plan and so written first. U2 hides every fifth
second attribute. U3: objects are users, instances their events (certain). U4: objects are labels, instances
embeddings with all their components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthant.operators import bounds as B
from orthant.operators import impute as I
from orthant.operators import rtree, score
from orthant.functions.dominance import register_sql
from orthant.operators.instances import SHARED_QUERY, holdout, latest, object_summary, partition_index, probability_audit, profile, with_distances
from orthant.sources import events as E
from orthant.sources import generators as G
from orthant.storage import materialize, shared_dir

from . import engine

K, PARTS, HIDE = 10, 4, 5
QUERY_POINTS = (("q0", 0.2, 0.25, 0.5), ("q1", 0.35, 0.4, 0.5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_points(spark: SparkSession, n: int = 2) -> DataFrame:
    return spark.createDataFrame(list(QUERY_POINTS[:n]), "query_id string, q0 double, q1 double, q2 double")


def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    share = F.lit(1.0) / F.count("*").over(Window.partitionBy("l_partkey"))
    return items.select(F.col("l_partkey").alias("object_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("instance_id"), share.alias("p"), (F.col("l_partkey") % PARTS).cast("int").alias("part"), (F.col("l_quantity") / 50.0).alias("a0"), (F.col("l_extendedprice") / 100000.0).alias("a1"), (F.col("l_discount") * 10.0).alias("a2"), "l_orderkey", "l_linenumber")


def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % HIDE == 0
    return u1(spark, sf_dir).withColumn("a1", F.when(~hidden, F.col("a1"))).withColumn("query_id", F.lit("q0"))


def d1(spark: SparkSession, sf_dir: str, n: int = 2, dims: int = 2) -> DataFrame:
    """Distances, with what scores and bounds need beside them."""
    rows = with_distances(u1(spark, sf_dir), query_points(spark, n), dims).select("query_id", "object_id", "part", "p", *[f"d{d}" for d in range(dims)])
    return materialize(rows, shared_dir(spark), "distances")


def _top(spark, sf_dir, n, dims):
    return score.top_k(score.scores(d1(spark, sf_dir, n, dims), dims), K).select("query_id", "object_id", "n_inst", "score", "rank")


def ptd_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 1, 2)


def ptd_multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 2, 2)


def ptd_ndim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 2, 3)


def ptd_score_all_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scores(d1(spark, sf_dir), 2).withColumn("score", score.rounded("score"))


def ptd_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scores(d1(spark, sf_dir), 2, method="grid").withColumn("score", score.rounded("score"))


def ptd_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 2
    rows = vectors.select(F.col("label").cast("long").alias("object_id"), F.col("vec_id").cast("string").alias("instance_id"), (F.lit(1.0) / F.count("*").over(Window.partitionBy("label"))).alias("p"), (F.col("label") % PARTS).alias("part"), *[F.col("embedding")[d].cast("double").alias(f"a{d}") for d in range(dims)])
    point = spark.createDataFrame([("q0", *[0.0] * dims)], ", ".join(["query_id string", *[f"q{d} double" for d in range(dims)]]))
    return score.top_k(score.scores(with_distances(rows, point, dims), dims), K).select("query_id", "object_id", "n_inst", "score", "rank")


def dominance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.dominated_counts(d1(spark, sf_dir), 2)


def object_mbr_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_summary(u1(spark, sf_dir), 2).select("object_id", "part", "n_inst", score.rounded("mass").alias("mass"), "lo0", "hi0", "lo1", "hi1", *[F.round(F.round(c, 12), 9).alias(c) for c in ("c0", "c1")])


def partition_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_index(u1(spark, sf_dir), 2)


def probability_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_audit(d1(spark, sf_dir)).withColumn("mass", score.rounded("mass"))


def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(u2(spark, sf_dir), 2)


def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(u2(spark, sf_dir), 2, ["part"]).select("part", "n_rows", "n_objects", "missing_a0", "missing_a1", (F.col("missing_a1") / F.col("n_rows")).alias("missing_rate"))


def _instances_out(rows: DataFrame) -> DataFrame:
    return rows.select("object_id", "instance_id", *[F.round(c, 9).alias(c) for c in ("p", "a0", "a1")])


def impute_rule_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances_out(I.expand(u2(spark, sf_dir), I.rule_candidates(I.default_rules(2), 2)))


def synopsis_determinant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = I.determinants(u2(spark, sf_dir), 2)
    return chosen.select("query_id", "target", "determinant", score.rounded("lo").alias("lo"), score.rounded("hi").alias("hi"), score.rounded("estimate").alias("estimate"))


def synopsis_bucket_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = u2(spark, sf_dir)
    found = I.bucket_candidates(rows, I.determinants(rows, 2), 2)
    return found.select("query_id", "target", "bucket", "n", score.rounded("lo").alias("lo"), score.rounded("hi").alias("hi"), score.rounded("p_lo").alias("p_lo"))


def _imputed(rows: DataFrame) -> DataFrame:
    chosen = I.determinants(rows, 2)
    return I.impute(rows, chosen, I.bucket_candidates(rows, chosen, 2), 2)


def impute_synopsis_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances_out(_imputed(u2(spark, sf_dir)))


def imputation_mae_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = holdout(u2(spark, sf_dir), ["l_orderkey", "l_linenumber", "object_id", "a0"])
    train = rows.where("not in_holdout")
    chosen = I.determinants(train, 2)
    errors = I.holdout_errors(rows.where("in_holdout"), chosen, I.bucket_candidates(train, chosen, 2), 2)
    return errors.select("query_id", "n_values", score.rounded("mae").alias("mae"))


def ptd_imputed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = materialize(with_distances(_imputed(u2(spark, sf_dir)).drop("query_id"), query_points(spark), 2), shared_dir(spark), "distances")
    return score.top_k(score.scores(inst, 2), K).select("query_id", "object_id", "n_inst", "score", "rank")


def bounds_no_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.partition_bounds(d1(spark, sf_dir), 2).withColumn("mass", score.rounded("mass"))


def kth_lower_bound_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.thresholds(B.partition_bounds(d1(spark, sf_dir), 2), K)


def dscp_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pruned(B.partition_bounds(d1(spark, sf_dir), 2), K).select("query_id", "object_id", "part", "lb", "ub", "tau", "survives")


def _pruned(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    inst = d1(spark, sf_dir)
    method = score.choose_method(inst, 2)
    own = score.own_shares(inst, 2) if method == "grid" else None
    return B.pruned_top_k(inst, B.partition_bounds(inst, 2, method, own=own), 2, K, scope, method, own)


def dscp_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, "both").select("query_id", "object_id", "n_inst", "score", "lb", "ub", "rank")


def partition_scope_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, "partition").select("query_id", "object_id", "n_inst", "score", "rank")


def object_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.traces(B.pruned(B.partition_bounds(d1(spark, sf_dir), 2), K)).select("query_id", "object_id", "part", "lb", "ub", "tau", "decision")


def false_prune_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = d1(spark, sf_dir)
    return B.false_prunes(B.pruned(B.partition_bounds(inst, 2), K), score.top_k(score.scores(inst, 2), K))


def emission_counts_aer(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = d1(spark, sf_dir)
    return B.emission_counts(inst, B.partition_bounds(inst, 2).withColumn("survives", F.lit(True)))


def certified_bounds_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.top_k(B.certified_bounds(d1(spark, sf_dir), 2, K).where("survives"), K).select("query_id", "object_id", "n_inst", "score", "lb", "ub", "rank")


def proxy_candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.proxy_top_k(d1(spark, sf_dir), 2, K, 40).select("query_id", "object_id", "n_inst", "score", "rank")


def partitioned_candidate_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = d1(spark, sf_dir)
    return B.precision_at_k(score.top_k(score.scores(inst, 2), K), B.partitioned_top_k(inst, 2, K, PARTS))


def str_leaf_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.build(u1(spark, sf_dir), 2)[0]


def _boxes(spark, sf_dir):
    items, points = u1(spark, sf_dir), query_points(spark)
    return with_distances(items, points, 2), materialize(rtree.summaries(rtree.build(items, 2)[1], points.select("query_id", "q0", "q1"), 2), shared_dir(spark), "boxes")


def node_full_partial_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst, boxes = _boxes(spark, sf_dir)
    found = rtree.remote_masses(inst, boxes, 2, 0)
    return found.select("query_id", "object_id", score.rounded("full_mass").alias("full_mass"), score.rounded("partial_mass").alias("partial_mass"), "partial_refs")


def node_emission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst, boxes = _boxes(spark, sf_dir)
    return rtree.emission_counts(inst, boxes, 2, 0)


def leaf_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.leaf_upper_bounds(_boxes(spark, sf_dir)[1], 2).withColumn("leaf_ub", score.rounded("leaf_ub"))


def export_level_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.export_level_cost(*_boxes(spark, sf_dir), 2)


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.rank_indexed(u1(spark, sf_dir), query_points(spark), 2, K)[0].select("query_id", "object_id", "n_inst", "score", "rank")


def centroid_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = object_summary(u1(spark, sf_dir), 2).crossJoin(query_points(spark))
    return B.centroid_skyline(centres.select("query_id", "object_id", "part", *[F.round(F.abs(F.col(f"c{d}") - F.col(f"q{d}")), 9).alias(f"d{d}") for d in range(2)]), 2, K)


def hgtp_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.rank(u1(spark, sf_dir), query_points(spark), 2, K, "hgtp")[0].select("query_id", "object_id", "n_inst", "score", "rank")


def treatment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of every treatment for one query; all must agree."""
    ready, out = engine.Prepared(u1(spark, sf_dir), query_points(spark, 1), 2, K), None
    for name, how in engine.TREATMENTS.items():
        one = ready.top(how).select(F.lit(name).alias("treatment"), "query_id", "object_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("user_id").alias("object_id"), F.col("event_id").cast("string").alias("instance_id"), F.lit(1.0).alias("p"), (F.col("user_id") % PARTS).cast("int").alias("part"), (F.col("value") / 100.0).alias("a0"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("a1"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("op_type"), "ts")


def latest_upsert_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = latest(user_events(spark, sf_dir), ["object_id"], [F.desc("ts"), F.desc("event_id")])
    return score.top_k(score.scores(with_distances(live, query_points(spark), 2), 2), K).select("query_id", "object_id", "n_inst", "score", "rank")


def window_live_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking after the last event over what the last 30 days hold: the batch form of the live window."""
    rows = user_events(spark, sf_dir)
    end = rows.agg(F.max("ts").alias("last"))
    live = latest(rows.crossJoin(end).where("ts >= last - interval 30 days").drop("last"), ["object_id"], [F.desc("ts"), F.desc("event_id")])
    return score.top_k(score.scores(with_distances(live, query_points(spark), 2), 2), K).select("query_id", "object_id", "n_inst", "score", "rank")


def events_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded as JSON records and decoded again."""
    rows = table(spark, sf_dir, "events")
    raw = rows.select(F.col("user_id").cast("string").alias("objectId"), F.lit("q0").alias("queryId"), F.expr("unix_millis(cast(ts as timestamp))").alias("eventTime"), F.when(F.col("event_type") == "error", "DELETE").alias("opType"), F.array(F.col("value"), F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("double"))).alias("attributes"), F.array(F.lit(False), F.lit(False)).alias("missingMask"), "event_id")
    decoded = E.decode(raw.select("event_id", E.encode(["objectId", "queryId", "eventTime", "opType", "attributes", "missingMask"]).alias("value")), "value")
    return decoded.select("event_id", "object_id", "query_id", "op_type", "p", "server_partition", F.expr("unix_millis(event_time)").alias("millis"), F.col("attributes")[0].alias("a0"), F.col("attributes")[1].alias("a1"), F.col("missing")[1].alias("missing_a1"))


def default_query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"))
    return G.default_query_points(ids, 3)


def java_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.functions.dominance import partition_of, string_hash

    names = table(spark, sf_dir, "customer")
    return names.select("c_custkey", string_hash(F.col("c_name")).alias("hash"), partition_of(F.lit(-1), F.col("c_name"), 8).alias("part"))


def _metrics(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    ready, out = engine.Prepared(u1(spark, sf_dir), query_points(spark), 2, K), None
    for name in names:
        one = ready.metrics(engine.treatment(name))
        out = one if out is None else out.unionByName(one)
    return out


def treatment_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each treatment prunes and emits; packed treatments never emit more."""
    return _metrics(spark, sf_dir, list(engine.TREATMENTS))


def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.run_averages(_metrics(spark, sf_dir, ["aes-dscp", "baseline"]))


def best_first_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves in the order of a best-first visit by their bounds, and which of them it reads."""
    items, points = u1(spark, sf_dir), query_points(spark)
    inst = d1(spark, sf_dir)
    leaves, nodes = rtree.build(items, 2)
    boxes = rtree.summaries(nodes, points.select("query_id", "q0", "q1"), 2)
    return rtree.best_first(items, leaves, boxes, 2, B.partition_bounds(inst, 2).select("query_id", "object_id", "lb"), K)


def impute_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a hidden second attribute as records: instances of upserts, identities of deletes."""
    rows = user_events(spark, sf_dir).withColumn("a1", F.when(F.col("event_id") % HIDE != 0, F.col("a1")))
    done = I.with_deletes(I.expand(rows, I.rule_candidates(I.default_rules(2), 2)), rows, 2)
    return done.select("object_id", "instance_id", "op_type", *[F.round(c, 9).alias(c) for c in ("p", "a0", "a1")])


def own_query_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of one query each and of all queries: every third order is shared, others belong to one."""
    mine = F.when(F.col("l_orderkey") % 3 == 0, SHARED_QUERY).otherwise(F.concat(F.lit("q"), (F.col("l_orderkey") % 3 - 1).cast("string")))
    found = with_distances(u1(spark, sf_dir).withColumn("query_id", mine), query_points(spark), 2)
    return found.groupBy("query_id", "object_id").agg(F.count("*").alias("n_inst"), score.rounded(F.sum("p")).alias("mass"), F.min("d0").alias("m0"), F.max("d1").alias("x1"))


def csv_events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as CSV files with their own names of columns, and read as events again."""
    path = f"{shared_dir(spark)}/events.csv"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ObjectId"), F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string")).alias("queryId"), F.expr("unix_millis(cast(ts as timestamp))").alias("EVENTTIME"), F.when(F.col("event_type") == "error", "delete").alias("opType"), F.col("value").alias("speed"), F.when(F.col("event_id") % HIDE != 0, F.col("value") * 2).alias("load"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    read = E.read_csv(spark, path)
    by_day = F.date_format("event_time", "yyyy-MM-dd").alias("day")
    return read.groupBy("query_id", "op_type", by_day).agg(F.count("*").alias("n_rows"), F.count_distinct("object_id").alias("n_objects"), F.count_if(F.col("a1").isNull()).alias("missing_a1"), F.min("a0").alias("min_a0"), F.max("a0").alias("max_a0"))


def sql_dominates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function on all line items against a point."""
    register_sql(spark)
    u1(spark, sf_dir).createOrReplaceTempView("orthant_items")
    return spark.sql("select object_id, count(*) as n_inst, count_if(dominates(array(a0, a1, a2), array(0.5D, 0.4D, 0.5D))) as n_below, count_if(dominates(array(0.5D, 0.4D, 0.5D), array(a0, a1, a2))) as n_above from orthant_items group by object_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (ptd_exact_topk, ptd_multi_query_topk, ptd_ndim_topk, ptd_score_all_objects, ptd_grid_scores, ptd_embedding_topk, dominance_pairs, object_mbr_mass, partition_index_query, probability_audit_query, csv_profile, missing_profile, impute_rule_expand, synopsis_determinant_choice, synopsis_bucket_candidates, impute_synopsis_expand, imputation_mae_holdout, ptd_imputed_topk, bounds_no_mbr, kth_lower_bound_tau, dscp_survivors, dscp_topk, partition_scope_topk, object_traces, false_prune_audit, emission_counts_aer, certified_bounds_topk, proxy_candidate_topk, partitioned_candidate_precision, str_leaf_assignment, node_full_partial_mass, node_emission_counts, leaf_upper_bounds, export_level_cost, indexed_topk, centroid_skyline, hgtp_topk, treatment_matrix, treatment_emissions, run_averages, best_first_survivors, impute_with_deletes, own_query_instances, csv_events_scan, sql_dominates, latest_upsert_topk, window_live_topk, events_json_decode, default_query_points, java_hash_partition)
    return {f.__name__.removesuffix("_query"): f for f in own}
