"""Scans, codecs and generators on small files."""

import gzip
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from orthant.operators.instances import containment_audit, latest, probability_audit, upserts, with_distances
from orthant.sources import events, generators, raw


def test_csv_events(spark, tmp_path):
    (tmp_path / "a.csv").write_text("objectId,queryId,eventTime,opType,a0,a1\n# note\no1,q0,1000,UPSERT,0.1,?\no2,q0,2000,delete,null,0.4\no1,q1,3000,UPSERT,,0.5\n")
    got = events.read_csv(spark, str(tmp_path / "a.csv")).orderBy("event_time").collect()
    assert [(r.a0, r.a1) for r in got] == [(0.1, None), (None, 0.4), (None, 0.5)] and got[0].p == 1.0 and got[0].server_partition == -1
    assert upserts(events.read_csv(spark, str(tmp_path / "a.csv"))).count() == 2
    (tmp_path / "b.csv").write_text("OBJECTID,instanceId,probability,serverId,queryId,eventTime,opType,queryA0,queryA1,a0,a1,mbrMinX,mbrMinY,mbrMaxX,mbrMaxY\nx,x1,0.4,1,q0,0,UPSERT,0,0.5,0.1,0.9,0,0,0.2,0.5\nx,x2,0.4,1,q0,0,UPSERT,9,9,0.1,0.2,0,0,0.2,0.5\n")
    rows = events.read_csv(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in events.queries_of(rows, 2).collect()] == [("q0", 0.0, 0.5)]
    assert [r.instance_id for r in containment_audit(rows, 2).collect()] == ["x1"]
    assert probability_audit(rows.withColumn("part", F.col("server_partition"))).first().bad_mass
    (tmp_path / "q.csv").write_text("queryId,queryA0,queryA1\nq0,0,0\nq1,1,1\n")
    points = events.read_query_set(spark, str(tmp_path / "q.csv"))
    assert with_distances(events.shared_input(rows.drop("q0", "q1")), points, 2).count() == 4
    (tmp_path / "q2.csv").write_text("queryId,queryA0\nq0,0\nq0,1\n")
    with pytest.raises(ValueError):
        events.read_query_set(spark, str(tmp_path / "q2.csv"))


def test_json_codec(spark):
    rows = spark.createDataFrame([('{"objectId":"o","queryId":"q","eventTime":5,"attributes":[1.0,null,2.0],"missingMask":[false,false,true]}',)], "value string")
    r = events.decode(rows).first()
    assert (r.object_id, r.instance_id, r.op_type, r.p, r.attributes, r.missing) == ("o", "o#raw", "UPSERT", 1.0, [1.0, None, None], [False, True, True])


def test_raw_archives(spark, tmp_path):
    with gzip.open(tmp_path / "intel.txt.gz", "wt") as f:
        f.write("2004-02-28 00:59:16.02 3 1 19.9 37.0 45.0 2.6\n2004-02-28 01:00:00 4 2 20.1\nbroken\n")
    intel = raw.read_intel(spark, str(tmp_path / "intel.txt.gz"))
    assert [(r.object_id, r.a0, r.a3) for r in intel.orderBy("object_id").collect()] == [("intel-mote-1", 19.9, 2.6), ("intel-mote-2", 20.1, None)]
    with zipfile.ZipFile(tmp_path / "pump.zip", "w") as z:
        z.writestr("sensor.csv", ",timestamp,sensor_00,sensor_01,machine_status\n0,2018-04-01 00:00:00,2.4,,NORMAL\n")
    pump = raw.read_pump(spark, str(tmp_path / "pump.zip")).first()
    assert (pump.query_id, pump.a0, pump.a1) == ("pump-normal", 2.4, None)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.dat", "1 0.5 " + " ".join(map(str, range(10))) + "\n")
    with zipfile.ZipFile(tmp_path / "gas.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    gas = raw.read_gas(spark, str(tmp_path / "gas.zip"))
    assert gas.first().a9 == 9.0
    assert raw.all_raw(intel, gas).count() == 3
    record = struct.pack("<i4d", 3, 1.0, 2.0, 1.0, 5.0)
    (tmp_path / "r.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 7, len(record) // 2) + record)
    s = raw.read_shapes(spark, str(tmp_path / "r.shp")).first()
    assert (s.object_id, s.mbr_lo0, s.mbr_hi0, s.mbr_lo1, s.mbr_hi1) == (7, 0.5, 1.5, 2.0, 5.0)


def test_generators_and_registry(spark):
    assert raw.provider(" ") is raw.provider("dummy") is generators.synthetic_events
    with pytest.raises(ValueError):
        raw.provider("x")
    rows = generators.synthetic_events(spark, 200, 3, 2)
    assert rows.count() == 400 and 0.1 < rows.where("a0 is null").count() / 400 < 0.3
    for kind in ("uniform", "gaussian", "zipf"):
        got = generators.region_objects(spark, 60, kind)
        assert containment_audit(got, 2).count() == 0 and not probability_audit(got.withColumn("query_id", F.lit("q0"))).where("bad_mass or bad_parts").count()
    assert generators.query_set(spark, generators.smartphone_objects(spark, 20), 3).count() == 3


def test_latest_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("o", 1, "UPSERT"), ("o", 2, "DELETE"), ("p", 1, "DELETE"), ("p", 3, "UPSERT")], "object_id string, t int, op_type string")
    assert [r.object_id for r in latest(rows, ["object_id"], [F.desc("t")]).collect()] == ["p"]
    top = spark.createDataFrame([("q0", 1, "o", 1.5, 1.0, 2.0, 3)], "query_id string, rank int, object_id string, score double, lb double, ub double, n_inst int")
    events.write_results(top, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().score == "1.500000"
    events.archive_run(str(tmp_path / "run"), {"k": 1}, top=top)
    assert spark.read.parquet(str(tmp_path / "run/top")).count() == 1
