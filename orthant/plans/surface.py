"""Registered queries of the surfaces around the ranking: sources and sinks read back, streams, emitted records, traces,
gates and evidence; each with its SQL beside it.

Files are made from the driver's tables in the shared folder first and then read by the scan in question. E1: objects are
users, instances all their events, each with p = 1/n, attributes value/100 and k/100.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthant.operators import bounds as B
from orthant.operators import impute as I
from orthant.operators import rtree, score
from orthant.operators.instances import containment_audit, latest, probability_audit, with_distances
from orthant.sources import events as E
from orthant.sources import generators as G
from orthant.sources import raw
from orthant.storage import materialize, shared_dir
from orthant.streaming import live

from . import engine, evidence, suites
from .oracles import BASE2, BOUNDS, BOXES, CENTRES, EVENTS, EXACT2, HIDDEN, IMPROVED, ITEMS, MET, NODE_DIST, PAIRS, POINTS, TAU, TREATMENT_NAMES, dist2, dom, q, scored, six
from .queries import K, PARTS, QUERY_POINTS, d1, query_points, table, u1, u2, user_events

DAYS = 7
FOUR = ("baseline", "aes-only", "dscp-only", "aes-dscp")


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file in a folder that executors share."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()
    return path


def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.lit(1.0) / F.count("*").over(Window.partitionBy("object_id"))
    return user_events(spark, sf_dir).withColumn("p", share)


def first_query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points that stand in the rows of a CSV scan: those of each query's first row."""
    path = f"{shared_dir(spark)}/points.csv"
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(F.col("user_id").alias("objectId"), F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("queryId"), F.lit(0).alias("eventTime"), F.col("value").alias("a0"), (F.col("value") / 100.0).alias("queryA0"), (F.col("event_id") * 0.5).alias("queryA1"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return E.queries_of(E.read_csv(spark, path, place=True), 2, "row_place")


def sidecar_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query set from its own file for instances that belong to all queries."""
    path = f"{shared_dir(spark)}/set.csv"
    spark.createDataFrame([p[:3] for p in QUERY_POINTS], "queryId string, queryA0 double, queryA1 double").write.option("header", True).csv(path)
    found = with_distances(E.shared_input(u1(spark, sf_dir)), E.read_query_set(spark, path), 2)
    return found.groupBy("query_id", "object_id").agg(F.count("*").alias("n_inst"), F.min("d0").alias("m0"), F.max("d1").alias("x1"))


def _intel(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/intel"
    at = lambda form: F.date_format(F.col("ts").cast("timestamp"), form)
    text = lambda c: c.cast("string")
    whole = F.when(F.col("event_id") % 5 != 0, F.concat_ws(" ", text(F.get_json_object("props", "$.k")), text(F.col("event_id") % 97), F.lit("2.5")))
    rows = table(spark, sf_dir, "events").select(F.concat_ws(" ", at("yyyy-MM-dd"), at("HH:mm:ss.SS"), text(F.col("event_id")), text(F.col("user_id")), text(F.col("value")), whole).alias("value"))
    rows.write.mode("overwrite").option("compression", "gzip").text(path)
    return path


def intel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gzipped lines of sensor readings, read as events again."""
    read = raw.read_intel(spark, _intel(spark, sf_dir))
    return read.groupBy("object_id", "query_id").agg(F.count("*").alias("n_rows"), F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"), F.min("a0").alias("min_a0"), F.max("a1").alias("max_a1"), F.max("a2").alias("max_a2"), F.count_if(F.col("a3").isNull()).alias("missing_a3"))


def _pump(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the 25 nations of the schema
    lines = [",timestamp,sensor_00,sensor_01,machine_status"] + [f"{r.n_nationkey},2018-04-01 00:{r.n_nationkey:02d}:00,{r.n_nationkey * 0.5},{'' if r.n_regionkey == 0 else r.n_regionkey},REGION{r.n_regionkey}" for r in rows]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sensor.csv", "\n".join(lines) + "\n")
    return put(spark, f"{shared_dir(spark)}/pump.zip", data.getvalue())


def pump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a zipped CSV of a pump's sensors, read as events again."""
    return raw.read_pump(spark, _pump(spark, sf_dir)).select("object_id", "instance_id", "query_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "op_type", "p", "a0", "a1")


def _gas(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the 25 nations of the schema
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("run.dat", "id time readings\n" + "".join(f"{r.n_nationkey} {r.n_regionkey * 0.25} {' '.join(str(r.n_nationkey + d) for d in range(9))} nan\n" for r in rows))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
    return put(spark, f"{shared_dir(spark)}/gas.zip", outer.getvalue())


def gas_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as readings in a ZIP in a ZIP, read as events again."""
    return raw.read_gas(spark, _gas(spark, sf_dir)).select("object_id", "query_id", F.expr("unix_millis(event_time)").alias("millis"), "a0", "a8", "a9")


def all_raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three archives as one table of attributes of different widths."""
    read = raw.provider("all")(spark, _intel(spark, sf_dir), _pump(spark, sf_dir), _gas(spark, sf_dir))
    kind = F.regexp_extract("object_id", "^([a-z]+)-", 1).alias("kind")
    return read.groupBy(kind, "query_id", F.size("attributes").alias("width")).agg(F.count("*").alias("n_rows"), F.count_distinct("object_id").alias("n_objects"), F.max(F.col("attributes")[0]).alias("max_a0"))


def road_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as boxes of a shapefile; an axis without extent is widened."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the 25 nations of the schema
    body = b""
    for r in rows:
        box = struct.pack("<i4d", 3 if r.n_nationkey % 2 else 5, r.n_nationkey, r.n_regionkey, r.n_nationkey + r.n_regionkey, r.n_regionkey + 1.0)
        body += struct.pack(">ii", r.n_nationkey + 1, len(box) // 2) + box
    return raw.read_shapes(spark, put(spark, f"{shared_dir(spark)}/roads.shp", b"\0" * 100 + body))


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(user_events(spark, sf_dir), ["object_id"], [F.desc("ts"), F.desc("event_id")])
    return materialize(with_distances(found, query_points(spark), 2), shared_dir(spark), "alive")


def _certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.top_k(B.certified_bounds(_alive(spark, sf_dir), 2, K).where("survives"), K)


def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking written as a results file and read back as text."""
    path = f"{shared_dir(spark)}/results.csv"
    E.write_results(_certified(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


def run_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archived ranking of a run."""
    folder = f"{shared_dir(spark)}/run"
    E.archive_run(folder, {"parameters": {"k": K, "queries": 2}}, top=_certified(spark, sf_dir))
    limits = spark.read.text(f"{folder}/manifest").select(F.get_json_object("value", "$.parameters.k").cast("int").alias("k"))
    return spark.read.parquet(f"{folder}/top").crossJoin(limits).where("rank <= k").select("query_id", F.col("object_id").cast("string").alias("object_id"), "rank", "score", "lb", "ub", "n_inst")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's report written as text, and its ranked objects parsed from the lines again."""
    ready = engine.Prepared(user_events(spark, sf_dir).where("op_type = 'UPSERT'"), query_points(spark), 2, K)
    how = engine.treatment("aes-dscp")
    path = f"{shared_dir(spark)}/report"
    lines = evidence.report(ready.top(how), ready.metrics(how), ready.traces(how))
    lines.coalesce(1).sortWithinPartitions("query_id", "line_no").select("value").write.mode("overwrite").text(path)  # some lines a query
    return evidence.parse_top(evidence.read_report(spark, path)).select("query_id", "rank", "object_id", "score", "lb", "ub", "n_inst")


def snapshot_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in files, read by a stream as far as they are available and landed as a table."""
    folder = shared_dir(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("objectId"), F.col("event_id").cast("string").alias("instanceId"), F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string")).alias("queryId"), F.expr("unix_millis(cast(ts as timestamp))").alias("eventTime"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("opType"), F.array("value").alias("attributes"), F.array(F.lit(False)).alias("missingMask"))
    rows.select(E.encode(rows.columns).alias("value")).write.mode("overwrite").text(f"{folder}/in")
    landed = live.snapshot(E.decode(spark.readStream.schema("value string").text(f"{folder}/in"), "value"), folder, 600)
    return landed.groupBy("query_id", "op_type").agg(F.count("*").alias("n_rows"), F.count_distinct("instance_id").alias("n_instances"), F.max(F.col("attributes")[0]).alias("max_a0"))


def live_stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking that a stream of all events gives at its end over the last week: users with the events since their last
    error, every second event in another query."""
    folder = shared_dir(spark)
    rows = user_events(spark, sf_dir).select(F.col("object_id").cast("string").alias("object_id"), "instance_id", F.concat(F.lit("q"), (F.col("event_id") % 2).cast("string")).alias("query_id"), F.col("ts").cast("timestamp").alias("event_time"), "op_type", "p", F.array("a0", "a1").alias("attributes"))
    landed = materialize(rows, folder, "in")
    stream = spark.readStream.schema(landed.schema).parquet(f"{folder}/in")
    points = {p[0]: list(p[1:3]) for p in QUERY_POINTS}
    out = live.live_rankings(stream, points, K, DAYS * 86_400_000, emit="batch")
    writing = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    if not writing.awaitTermination(3600):
        writing.stop()
        raise TimeoutError("the stream didn't end")
    every = spark.read.schema(out.schema).parquet(f"{folder}/out")
    last = every.groupBy("query_id").agg(F.max("event_time").alias("event_time"))
    return every.join(last, ["query_id", "event_time"]).select("query_id", "rank", "object_id", "score", "lb", "ub", "n_inst")


def synopsis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(I.determinants(u2(spark, sf_dir), 2))


def indexed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose instances all have boxes; some of one query's have none."""
    rows = u1(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), (F.col("l_orderkey") % 3).cast("string")))
    whole = F.when(F.col("l_orderkey") % 6 != 4, F.col("a0"))
    return engine.box_gate(rows.withColumns({"mbr_lo0": F.col("a0"), "mbr_hi0": whole, "mbr_lo1": F.col("a1"), "mbr_hi1": F.col("a1")}), 2)


def hgtp_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = engine.Prepared(u1(spark, sf_dir), query_points(spark), 2, K)
    return ready.traces(engine.treatment("hgtp")).select("query_id", "object_id", "part", "decision")


def indexed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the indexed plan, with what the index skipped."""
    marked = engine.mark_indexed(u1(spark, sf_dir), query_points(spark), 2, K)
    return B.traces(marked).select("query_id", "object_id", "part", "lb", "ub", "decision")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("q0").alias("query_id"), F.col("label").cast("long").alias("object_id"), F.col("vec_id").cast("string").alias("instance_id"), (F.col("label") % PARTS).alias("part"))


def emission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without boxes: every vector with each other label of its partition."""
    found = B.emissions(_labelled(spark, sf_dir), packed=False)
    return found.select("part", F.concat_ws("|", "instance_id", F.col("competitor").cast("string")).alias("record"))


def emission_records_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packed: one record for each vector."""
    found = B.emissions(_labelled(spark, sf_dir), packed=True)
    return found.select("part", F.concat_ws("|", "instance_id", F.array_join(F.col("competitors").cast("array<string>"), ";")).alias("record"))


def node_emission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed records of partial references: every event with the leaves of a remote partition that it may dominate in part."""
    rows, points = e1(spark, sf_dir), query_points(spark, 1)
    boxes = rtree.summaries(rtree.build(rows, 2)[1], points, 2)
    found = rtree.emissions(with_distances(rows, points, 2), boxes, 2, packed=True)
    return found.select("object_id", "node_part", F.concat_ws("|", "instance_id", F.array_join(F.col("nodes").cast("array<string>"), ";")).alias("record"))


def _four(spark: SparkSession, sf_dir: str) -> tuple[engine.Prepared, DataFrame]:
    ready, out = engine.Prepared(u1(spark, sf_dir), query_points(spark), 2, K), None
    for name in FOUR:
        one = ready.metrics(engine.treatment(name))
        out = one if out is None else out.unionByName(one)
    return ready, out


def ablation_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, metrics = _four(spark, sf_dir)
    wrong = B.false_prunes(ready.marked(engine.treatment("dscp-only")), ready.top(engine.treatment("baseline")))
    return evidence.ablation_invariants(metrics, wrong)


def treatment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many emissions each treatment saves against the baseline."""
    return evidence.compare_treatments(_four(spark, sf_dir)[1], "baseline")


def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.experiment_matrix(spark, ["u1"], list(engine.TREATMENTS), repetitions=2).drop("run")


def suite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the ablation of the largest suite."""
    return suites.plan(spark, "road-full-20q", "ablation", repetitions=2, allow_full=True).drop("run")


def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing saves, for vectors of odd and even ids, as the lines of three kinds of files."""
    rows = _labelled(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), F.expr("cast(instance_id as long) % 2"))).withColumn("p", F.lit(1.0))
    marked = score.objects_of(rows).withColumn("survives", F.lit(True))
    found = suites.reductions(B.emission_counts(rows, marked), "query_id", "baseline_emissions", ["aes_emissions"])
    out = None
    for kind in ("csv", "markdown", "latex"):
        one = suites.rendered(found, kind, "query_id", "baseline_emissions", ["aes_emissions"]).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def run_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that lost its errors."""
    rows = table(spark, sf_dir, "events").withColumn("query_id", F.concat(F.lit("q"), F.col("event_id") % 2))
    kept = rows.where("event_type <> 'error'")
    return suites.watched(rows, kept, kept.select("query_id", "user_id").distinct())


def synthetic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doesn't depend on the random numbers of generated events."""
    rows = G.synthetic_events(spark, 500, 4, 2)
    inside = F.bool_and(F.array_max(F.array(*[F.coalesce(F.col(f"a{d}"), F.lit(0.5)) for d in range(4)])).between(0, 1) & F.array_min(F.array(*[F.coalesce(F.col(f"a{d}"), F.lit(0.5)) for d in range(4)])).between(0, 1))
    missing = sum((F.count_if(F.col(f"a{d}").isNull()) for d in range(4)), F.lit(0)) / (F.count("*") * 4)
    return rows.groupBy("query_id").agg(F.count("*").alias("n_rows"), F.count_distinct("object_id").alias("n_objects"), F.min(F.expr("unix_millis(event_time)")).alias("first_ms"), F.max(F.expr("unix_millis(event_time)")).alias("last_ms"), inside.alias("in_range"), missing.between(0.15, 0.25).alias("rate_held"))


def generated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each generator, and how many have wrong masses or partitions or instances outside their boxes."""
    kinds = {k: G.region_objects(spark, 300, k) for k in ("uniform", "gaussian", "zipf")} | {"smartphone": G.smartphone_objects(spark, 300)}
    out = None
    for kind, rows in kinds.items():
        bad = probability_audit(rows.withColumn("query_id", F.lit("q0"))).agg(F.count("*").alias("n_objects"), F.count_if(F.col("bad_mass") | F.col("bad_parts")).alias("n_bad"))
        astray = containment_audit(rows, 2).agg(F.count("*").alias("n_outside")) if kind != "smartphone" else spark.range(1).select(F.lit(0).cast("long").alias("n_outside"))
        points = G.query_set(spark, rows, 5).agg(F.count("*").alias("n_points"))
        one = bad.crossJoin(astray).crossJoin(points).withColumn("kind", F.lit(kind))  # rows of one aggregate each
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (first_query_points, sidecar_query_set, intel_scan, pump_scan, gas_scan, all_raw_scan, road_boxes, results_csv, run_archive, text_report, snapshot_ingest, live_stream_topk, synopsis_summary, indexed_gate, hgtp_traces, indexed_traces, emission_records, emission_records_packed, node_emission_records, ablation_invariants, treatment_comparison, experiment_matrix, suite_plan, rendered_tables, run_monitor, synthetic_profile, generated_objects)
    return {f.__name__: f for f in own}


CERTIFIED = (
    EVENTS, POINTS[2], "last_one as (select * from happened qualify row_number() over (partition by object_id order by ts desc, event_id desc) = 1)", "alive as (select * from last_one where event_type <> 'error')", dist2("alive"), scored(),
    "best as (select query_id, object_id, max(p) as best from inst group by all)",
    f"c as (select e.query_id, object_id, n_inst, {six('score')} as score, {six('greatest(score - best, 0)')} as lb, {six('least(sum(mass) over (partition by e.query_id) - mass, score + best)')} as ub from exact e join best using (query_id, object_id))",
    "ranked as (select *, row_number() over (partition by query_id order by score desc, object_id) as rank from c qualify rank <= 10)",
)
GAS_START = 1_700_000_000_000
# The last week of the stream, without what an error of its user has removed.
STREAMED = f"""
told as (select 'q' || (event_id % 2) as query_id, object_id::varchar as object_id, instance_id, epoch_us(ts) // 1000 as ms, p, part, a0, a1, event_type from happened),
ends as (select query_id, max(ms) - {DAYS * 86_400_000} as floor from told group by all),
live_rows as (select t.* from told t join ends using (query_id) where event_type <> 'error' and ms >= floor and not exists (
  select 1 from told d where d.event_type = 'error' and d.query_id = t.query_id and d.object_id = t.object_id and (d.ms > t.ms or d.ms = t.ms and d.instance_id > t.instance_id))),
inst as (select query_id, object_id, instance_id, p, part, abs(a0 - q0) as d0, abs(a1 - q1) as d1 from live_rows join points using (query_id))"""
REFERRED = """
refs as (select query_id, object_id, sum(p * node_mass) filter (where is_full) as full_mass, sum(p * node_mass) filter (where not is_full) as partial_mass from met group by all)"""
INDEX_BOUNDS = f"""
bounds as (select e.query_id, e.object_id, e.part, {six('local + coalesce(full_mass, 0)')} as lb, {six('local + coalesce(full_mass, 0) + coalesce(partial_mass, 0)')} as ub from exact e left join refs using (query_id, object_id))"""
SKIPPED = f"""
reached as (select a.query_id, a.part, a.node, sum(b.mass) as leaf_ub from boxes a join boxes b on a.query_id = b.query_id and {dom('a', 'b', left='m', right='x')} group by all),
heavy as (select part, leaf as node, max(mass) as heaviest from leaves group by all),
kth as (select query_id, lb as tau from bounds qualify row_number() over (partition by query_id order by lb desc, object_id) = 10),
skipped as (select r.query_id, l.object_id from reached r join heavy using (part, node) join leaves l on l.part = r.part and l.leaf = r.node join kth using (query_id) where {six('leaf_ub * heaviest')} < tau)"""

RENDERED = r"""with
n as (select 'q' || (vec_id % 2) as query_id, label, count(*) as n_inst from embeddings group by all),
o as (select *, count(*) over (partition by query_id, label % 4) as part_objects from n),
t as (select query_id, sum(n_inst * (part_objects - 1))::bigint as b, sum(n_inst)::bigint as a from o group by all),
r as (select *, row_number() over (order by query_id) as i, case when b <> 0 then round(round((b - a) / b * 100, 9)::decimal(38, 9), 2)::double end as pct from t),
s as (select *, format('{:,}', b) as bt, format('{:,}', a) || coalesce(' (' || printf('%.2f', pct), '') as saved from r)
select 'csv' as kind, i + 1 as line_no, query_id || ',' || b || ',' || a || ',' || coalesce(pct::varchar, '') as value from s
union all select 'csv', 1, 'query_id,baseline_emissions,aes_emissions,aes_emissions_pct'
union all select 'markdown', i + 2, '| ' || query_id || ' | ' || bt || ' | ' || saved || case when pct is null then '' else '%)' end || ' |' from s
union all select 'markdown', 1, '| query_id | baseline_emissions | aes_emissions |'
union all select 'markdown', 2, '| --- | ---: | ---: |'
union all select 'latex', i + 4, query_id || ' & ' || bt || ' & ' || saved || case when pct is null then '' else '\%)' end || ' \\' from s
union all select 'latex', line_no, value from (values (1, '\begin{tabular}{lrr}'), (2, '\hline'), (3, 'query\_id & baseline\_emissions & aes\_emissions \\'), (4, '\hline'), (1099511627776, '\hline'), (1099511627777, '\end{tabular}')) f(line_no, value)"""


def oracle_sql() -> dict[str, str]:
    treated = q(*EXACT2, BOUNDS, TAU, CENTRES, IMPROVED, select="{}")
    names = ", ".join(f"('{n}')" for n in TREATMENT_NAMES)
    four = ", ".join(f"'{n}'" for n in FOUR)
    of = lambda t, c: f"max({c}) filter (where treatment = '{t}')"
    intel = "select 'intel-mote-' || user_id as object_id, 'q0' as query_id, count(*) as n_rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_time, min(value) as min_a0, max(json_extract_string(props, '$.k')::double) filter (where event_id % 5 <> 0) as max_a1, (max(event_id % 97) filter (where event_id % 5 <> 0))::double as max_a2, count(*) filter (where event_id % 5 = 0) as missing_a3 from events group by all"
    return {
        "first_query_points": "select 'q' || (user_id % 7) as query_id, arg_min(value, event_id) / 100.0::double as q0, min(event_id) * 0.5::double as q1 from events group by all",
        "sidecar_query_set": q(*BASE2, select="select query_id, object_id, count(*) as n_inst, min(d0) as m0, max(d1) as x1 from inst group by all"),
        "intel_scan": intel,
        "pump_scan": "select 'pump-' || (n_nationkey + 1) as object_id, 'pump-' || (n_nationkey + 1) || '#raw' as instance_id, 'pump-region' || n_regionkey as query_id, strftime(timestamp '2018-04-01 00:00:00' + to_minutes(n_nationkey), '%Y-%m-%d %H:%M:%S') as at, 'UPSERT' as op_type, 1e0 as p, n_nationkey * 0.5e0 as a0, case when n_regionkey <> 0 then n_regionkey::double end as a1 from nation",
        "gas_scan": f"select 'gas-' || n_nationkey || '-' || (n_nationkey + 1) as object_id, 'q0' as query_id, ({GAS_START} + n_regionkey * 900000)::bigint as millis, n_nationkey::double as a0, n_nationkey + 8e0 as a8, null::double as a9 from nation",
        "all_raw_scan": f"select 'intel' as kind, query_id, 4 as width, sum(n_rows)::bigint as n_rows, count(*) as n_objects, (select max(value) from events) as max_a0 from ({intel}) group by all union all select 'pump', 'pump-region' || n_regionkey, 2, count(*), count(*), max(n_nationkey) * 0.5e0 from nation group by all union all select 'gas', 'q0', 10, count(*), count(*), max(n_nationkey)::double from nation",
        "road_boxes": "select (n_nationkey + 1)::bigint as object_id, n_nationkey - case when n_regionkey = 0 then 0.5e0 else 0e0 end as mbr_lo0, n_regionkey::double as mbr_lo1, n_nationkey + n_regionkey + case when n_regionkey = 0 then 0.5e0 else 0e0 end as mbr_hi0, n_regionkey + 1e0 as mbr_hi1 from nation",
        "results_csv": q(*CERTIFIED, select="select query_id, rank::varchar as rank, object_id::varchar as object_id, printf('%.6f', score) as score, printf('%.6f', lb) as lower_bound, printf('%.6f', ub) as upper_bound, n_inst::varchar as instances from ranked"),
        "run_archive": q(*CERTIFIED, select="select query_id, object_id::varchar as object_id, rank, score, lb, ub, n_inst from ranked"),
        "text_report": q(EVENTS, POINTS[2], "alive as (select * from happened where event_type <> 'error')", dist2("alive"), scored(), BOUNDS, "ranked as (select *, row_number() over (partition by query_id order by shown desc, object_id) as rank from (select *, " + six("score") + " as shown from bounds) qualify rank <= 10)", select="select query_id, rank, object_id::varchar as object_id, shown as score, lb, ub, n_inst from ranked"),
        "snapshot_ingest": "select 'q' || (event_id % 2) as query_id, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as op_type, count(*) as n_rows, count(distinct event_id) as n_instances, max(value) as max_a0 from events group by all",
        "live_stream_topk": q(EVENTS, POINTS[2], STREAMED, scored(), f"c as (select query_id, object_id, n_inst, {six('score')} as score, {six('greatest(score - 1, 0)')} as lb, {six('least(sum(mass) over (partition by query_id) - mass, score + 1)')} as ub from exact)", select="select query_id, row_number() over (partition by query_id order by score desc, object_id) as rank, object_id, score, lb, ub, n_inst from c qualify rank <= 10"),
        "synopsis_summary": q(ITEMS, HIDDEN, PAIRS.format(t="rows2"), select="select query_id, count(*) as n_rules, round(avg(estimate), 6) as avg_estimate from chosen group by all"),
        "indexed_gate": q(ITEMS, select="select 'q' || (l_orderkey % 3) as query_id, count(*) as n_inst, bool_and(l_orderkey % 6 <> 4) as indexed from items group by all"),
        "hgtp_traces": treated.format("select o.query_id, o.object_id, o.part, case when l.object_id is null then 'pruned-by-hgtp' else 'survived' end as decision from objects o left join left_over l on l.dscp and l.improved and l.query_id = o.query_id and l.object_id = o.object_id qualify row_number() over (partition by o.query_id order by o.object_id) <= 25"),
        "indexed_traces": q(*EXACT2, BOXES, NODE_DIST.format(nodes="node0"), MET, REFERRED, INDEX_BOUNDS, TAU, SKIPPED, select="select m.query_id, m.object_id, m.part, lb, ub, case when s.object_id is not null then 'pruned-by-index' when survives then 'survived' else 'pruned-by-dscp' end as decision from marked m left join skipped s using (query_id, object_id) qualify row_number() over (partition by m.query_id order by m.object_id) <= 25"),
        "emission_records": "select a.label % 4 as part, a.vec_id || '|' || b.label as record from embeddings a join (select distinct label from embeddings) b on a.label % 4 = b.label % 4 and a.label <> b.label",
        "emission_records_packed": "select a.label % 4 as part, a.vec_id || '|' || string_agg(b.label::varchar, ';' order by b.label) as record from embeddings a join (select distinct label from embeddings) b on a.label % 4 = b.label % 4 and a.label <> b.label group by a.vec_id, a.label",
        "node_emission_records": q(EVENTS, "items as (select * replace (1e0 / count(*) over (partition by object_id) as p) from happened)", POINTS[1], dist2("items"), BOXES, NODE_DIST.format(nodes="node0"), MET, select="select object_id, node_part, instance_id || '|' || string_agg(node::varchar, ';' order by node) as record from met where not is_full group by object_id, node_part, instance_id"),
        "ablation_invariants": treated.format(f"select query_id, {of('aes-only', 'emissions')} <= {of('baseline', 'emissions')} as aes_emits_no_more, {of('aes-dscp', 'emissions')} <= {of('dscp-only', 'emissions')} as aes_emits_no_more_with_dscp, {of('aes-only', 'pruned')} = {of('baseline', 'pruned')} and {of('aes-dscp', 'pruned')} = {of('dscp-only', 'pruned')} as aes_prunes_the_same, {of('dscp-only', 'pruned')} >= {of('baseline', 'pruned')} as dscp_prunes_no_less, true as no_false_prunes from metrics group by query_id"),
        "treatment_comparison": treated.format(f"select treatment, m.query_id, emissions, round(round((b.base - emissions) / b.base * 100, 9)::decimal(38, 9), 2)::double as reduction_pct from metrics m join (select query_id, emissions as base from metrics where treatment = 'baseline') b using (query_id) where treatment in ({four})"),
        "experiment_matrix": f"select 'u1' as dataset, algorithm, k, partitions, repetition from (values {names}) a(algorithm), (values (5), (10), (20)) k(k), (values (2), (5), (8), (10)) p(partitions), (values (1), (2)) r(repetition)",
        "suite_plan": f"select 'bangladesh-road-paper' as dataset, algorithm, 10 as k, 4 as partitions, repetition, 'bangladesh-road-queries-20' as query_set from (select unnest([{four}]) as algorithm), (values (1), (2)) r(repetition)",
        "rendered_tables": RENDERED,
        "run_monitor": "select 'q' || (event_id % 2) as query_id, count(*) as expected, count(*) filter (where event_type <> 'error') as arrived, count(distinct user_id) filter (where event_type <> 'error') as answers, round(count(*) filter (where event_type <> 'error') / count(*), 6) as ingestion, case when bool_and(event_type <> 'error') then 1e0 else 0e0 end as processing, case when not bool_and(event_type <> 'error') then count(*) filter (where event_type <> 'error') || ' of ' || count(*) || ' expected rows arrived' end as issue from events group by all",
        "synthetic_profile": f"select 'q' || (i % 2) as query_id, count(*) as n_rows, count(*) as n_objects, ({GAS_START} + min(i) * 20)::bigint as first_ms, ({GAS_START} + max(i) * 20)::bigint as last_ms, true as in_range, true as rate_held from range(1000) t(i) group by all",
        "generated_objects": "select 300::bigint as n_objects, 0::bigint as n_bad, 0::bigint as n_outside, 5::bigint as n_points, kind from (values ('uniform'), ('gaussian'), ('zipf'), ('smartphone')) t(kind)",
    }
