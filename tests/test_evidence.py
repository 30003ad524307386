"""Reports, digests, comparisons and matrices; records and gates on small tables."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from orthant.operators import bounds, rtree
from orthant.operators.instances import with_distances
from orthant.plans import engine, evidence, suites
from orthant.sources import events, raw
from orthant.sources.generators import region_objects
from orthant.streaming import live


def test_report_and_back(spark, tmp_path):
    top = spark.createDataFrame([("q0", 1, "o1", 2.5, 1.0, 3.0, 2), ("q0", 2, "o2", 0.25, 0.0, 1.0, 1)], "query_id string, rank int, object_id string, score double, lb double, ub double, n_inst int")
    metrics = spark.createDataFrame([("q0", "aes-dscp", 4, 3, 1, 0.25, 12), ("q1", "aes-dscp", 0, 0, 0, 0.0, 0)], "query_id string, treatment string, objects long, refined long, pruned long, prune_ratio double, emissions long")
    traces = spark.createDataFrame([("q0", "o1", 3, 1.0, 3.0, None, "survived"), ("q0", "o9", 1, None, 0.5, 1.0, "pruned-by-hgtp")], "query_id string, object_id string, part int, lb double, ub double, tau double, decision string")
    lines = evidence.report(top, metrics, traces).orderBy("query_id", "line_no").collect()
    noise = "26/01/01 00:00:00 WARN Something: query=q7 rank object=x score=1"
    (tmp_path / "report.txt").write_text("\n".join([noise, *[r.value for r in lines]]) + "\n")
    read = evidence.read_report(spark, str(tmp_path / "report.txt"))
    assert [tuple(r) for r in evidence.parse_top(read).orderBy("rank").collect()] == [("q0", 1, "o1", 2.5, 1.0, 3.0, 2), ("q0", 2, "o2", 0.25, 0.0, 1.0, 1)]
    assert [tuple(r) for r in evidence.parse_metrics(read).orderBy("query").collect()] == [("q0", "aes-dscp", 4, 3, 1, 0.25, 12), ("q1", "aes-dscp", 0, 0, 0, 0.0, 0)]
    assert {tuple(r) for r in evidence.parse_traces(read).collect()} == {("q0", "o1", 3, 1.0, 3.0, None, "survived"), ("q0", "o9", 1, None, 0.5, 1.0, "pruned-by-hgtp")}
    got = evidence.digests(spark, str(tmp_path / "report.txt")).first()
    data = (tmp_path / "report.txt").read_bytes()
    assert (got.file, got.bytes, got.sha256) == ("report.txt", len(data), hashlib.sha256(data).hexdigest())


def test_fairness_and_matrix(spark):
    one = {"dataset": {"sha256": "a"}, "parameters": {"k": 10, "seed": 1}}
    two = {"dataset": {"sha256": "a"}, "parameters": {"k": 20, "seed": 1}}
    assert evidence.fairness([one, one]) == {} and evidence.fairness([one, two, one]) == {"parameters.k": [10, 20, 10]}
    with pytest.raises(ValueError):
        evidence.fairness([one])
    with pytest.warns(RuntimeWarning, match="batches"):
        assert evidence.experiment_matrix(spark, ["a"], ["x", "y"], repetitions=50).agg(F.max("run")).first()[0] == 1200


def test_invariants_tell_what_is_broken(spark):
    rows = [("baseline", "q0", 0, 10), ("aes-only", "q0", 1, 12), ("dscp-only", "q0", 3, 6), ("aes-dscp", "q0", 3, 6)]
    metrics = spark.createDataFrame(rows, "treatment string, query_id string, pruned long, emissions long")
    r = evidence.ablation_invariants(metrics, spark.createDataFrame([("q0", 2)], "query_id string, false_prunes long")).first()
    assert tuple(r) == ("q0", False, True, False, True, False)
    saved = {x.treatment: x.reduction_pct for x in evidence.compare_treatments(metrics, "baseline").collect()}
    assert saved == {"baseline": 0.0, "aes-only": -20.0, "dscp-only": 40.0, "aes-dscp": 40.0}


def test_records_packed_or_not(spark):
    rows = region_objects(spark, 40, partitions=4).withColumn("query_id", F.lit("q0"))
    points = spark.createDataFrame([("q0", 30.0, 40.0)], "query_id string, q0 double, q1 double")
    inst = with_distances(rows, points, 2).cache()
    boxes = rtree.summaries(rtree.build(rows, 2, 4)[1], points, 2)
    keys = ["object_id", "instance_id", "node_part"]
    flat = {tuple(r) for r in rtree.emissions(inst, boxes, 2, False).select(*keys, "node").collect()}
    packed = {tuple(r) for r in rtree.emissions(inst, boxes, 2, True).select(*keys, F.explode("nodes")).collect()}
    counts = rtree.emission_counts(inst, boxes, 2).first()
    assert flat == packed and len(flat) == counts.baseline_emissions > counts.aes_emissions
    pairs = {tuple(r) for r in bounds.emissions(inst, False).select("instance_id", "competitor").collect()}
    assert pairs == {tuple(r) for r in bounds.emissions(inst, True).select("instance_id", F.explode("competitors")).collect()}
    inst.unpersist()


def test_gate_of_boxes(spark):
    rows = region_objects(spark, 30, partitions=2).withColumn("query_id", F.concat(F.lit("q"), (F.col("object_id") % 2).cast("string")))
    holes = rows.withColumn("mbr_hi1", F.when(F.col("object_id") != 4, F.col("mbr_hi1")))
    assert {r.query_id: r.indexed for r in engine.box_gate(holes, 2).collect()} == {"q0": False, "q1": True}
    assert not engine.box_gate(rows.drop("mbr_lo0"), 2).where("indexed").count()
    points = spark.createDataFrame([("q0", 30.0, 40.0), ("q1", 50.0, 50.0)], "query_id string, q0 double, q1 double")
    tops = [{tuple(r) for r in engine.rank_any(t, points, 2, 3)[0].select("query_id", "object_id", "score", "rank").collect()} for t in (rows, holes)]
    assert tops[0] == tops[1] and "skipped" in engine.rank_any(rows, points, 2, 3)[1].columns and "skipped" not in engine.rank_any(holes, points, 2, 3)[1].columns


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(f"{name}.csv", text)
    return str(path)


def test_pump_members_share_a_header(spark, tmp_path):
    head = ",timestamp,sensor_00,machine_status\n"
    same = archive(tmp_path / "a.zip", a=head + "0,2018-04-01 00:00:00,1,NORMAL\n1,2018-04-01 00:01:00,2,BROKEN\n", b=head + "0,2018-04-01 00:00:00,3,NORMAL\n")
    assert sorted(r.a0 for r in raw.read_pump(spark, same).collect()) == [1.0, 2.0, 3.0]
    assert [r.a0 for r in raw.read_pump(spark, same, 2).collect()] == [1.0, 2.0]
    for members in ({"a": head, "b": ",timestamp,sensor_01,machine_status\n"}, {}):
        with pytest.raises(ValueError):
            raw.read_pump(spark, archive(tmp_path / "b.zip", **members))


def test_rows_in_the_order_of_files(spark, tmp_path):
    for name, first in (("1.csv", 0), ("2.csv", 100)):
        body = "".join(f"o,z{9 - i},q{i % 2},0,UPSERT,{first + i},1,{first + i}\n" for i in range(10))
        (tmp_path / name).write_text("objectId,instanceId,queryId,eventTime,opType,queryA0,queryA1,a0\n" + body)
    rows = events.read_csv(spark, str(tmp_path), place=True)
    assert {r.query_id: r.q0 for r in events.queries_of(rows, 2, "row_place").collect()} == {"q0": 0.0, "q1": 1.0}
    assert {r.query_id: r.q0 for r in events.queries_of(rows.where("q0 >= 100"), 2).collect()} == {"q0": 108.0, "q1": 109.0}


def test_bounded_reads(spark, tmp_path):
    assert live.kafka_options("h:1", ["a", "b"], bounded=True) == {"kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "earliest", "failOnDataLoss": "true", "endingOffsets": "latest"}
    assert "endingOffsets" not in live.kafka_options("h:1", "a")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a\nb\n")
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    with pytest.warns(RuntimeWarning, match="2 events of 3"):
        assert live.snapshot(stream, str(tmp_path / "out"), expected=3).count() == 2


def test_suites(spark):
    runs = suites.plan(spark, "smartphone", "paired", repetitions=3)
    assert {(r.dataset, r.algorithm, r.query_set) for r in runs.collect()} == {("smartphone-paper", "baseline", None), ("smartphone-paper", "aes-dscp", None)} and runs.count() == 6
    with pytest.raises(ValueError, match="large"):
        suites.plan(spark, "road-full", "ablation")
    with pytest.raises(ValueError, match="setups"):
        suites.plan(spark, "smartphone", "other")


def test_rendered_tables(spark):
    rows = spark.createDataFrame([("a_1|x", 1200, 300), (None, 0, 5), ('b,"c"', None, 7)], "name string, base long, packed long")
    table = suites.reductions(rows, "name", "base", ["packed"])
    lines = lambda kind, t=table: [r.value for r in suites.rendered(t, kind, "name", "base", ["packed"]).orderBy("line_no").collect()]
    assert lines("csv") == ["name,base,packed,packed_pct", "-,0,5,", "a_1|x,1200,300,75.0", '"b,""c""",,7,']
    assert lines("markdown") == ["| name | base | packed |", "| --- | ---: | ---: |", "| - | 0 | 5 |", "| a_1\\|x | 1,200 | 300 (75.00%) |", '| b,"c" | - | 7 |']
    assert lines("latex") == ["\\begin{tabular}{lrr}", "\\hline", "name & base & packed \\\\", "\\hline", "- & 0 & 5 \\\\", "a\\_1|x & 1,200 & 300 (75.00\\%) \\\\", 'b,"c" & - & 7 \\\\', "\\hline", "\\end{tabular}"]
    assert lines("csv", table.limit(0)) == ["name,base,packed,packed_pct"]
    with pytest.raises(ValueError):
        suites.rendered(table, "pdf", "name", "base", [])
    drawn = suites.bars("a < b", {"baseline": 200, "packed": 50})
    assert drawn.count("<rect") == 2 and "a &lt; b" in drawn and "50 (-75.0%)" in drawn and suites.bars("none", {}).endswith("</svg>\n")


def test_watched_and_checked(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "query_id string")
    got = {r.query_id: tuple(r)[1:] for r in suites.watched(ids("a", "a", "b"), ids("a", "b", "c"), ids("a", "b", "d")).collect()}
    assert got["a"] == (2, 1, 1, 0.5, 0.0, "1 of 2 expected rows arrived") and got["b"] == (1, 1, 1, 1.0, 1.0, None)
    assert got["c"] == (0, 1, 0, None, None, None) and got["d"] == (0, 0, 1, None, 1.0, None)
    measures = spark.createDataFrame([("arrived", 5.0), ("answers", None)], "measure string, got double")
    held = {r.measure: r.held for r in suites.checked(measures, {"arrived": 5, "answers": 1, "jobs": 1}).collect()}
    assert held == {"arrived": True, "answers": False, "jobs": False}
    assert not suites.checked(measures, {"arrived": 1_000_005}).first().held
