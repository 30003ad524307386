"""The live window as a function, as a stream, and bounded snapshots."""

import json

import numpy as np
import pytest

from orthant.sources.events import decode
from orthant.streaming import live


def test_window_rules():
    w = live.Window(100, "keep-once", None)
    w.apply("a", "a1", 1000, "UPSERT", 0.5, (0.1, 0.1))
    w.apply("a", "a2", 1000, "UPSERT", 0.5, (0.2, 0.2))
    w.apply("b", "b1", 1050, "UPSERT", 1.0, (0.3, 0.3))
    assert [(r[1], r[2], r[5]) for r in w.top(np.zeros(2), 5)] == [("a", 1.0, 2), ("b", 0.0, 1)]
    w.apply("c", "c1", 900, "UPSERT", 1.0, (0.0, 0.0))  # late: stays for this event only
    assert ("c", "c1") in w.rows
    w.apply("a", "", 1060, "DELETE", 1.0, ())
    assert set(w.rows) == {("b", "b1")}
    again = live.Window(100, "drop", w.state())
    again.apply("c", "c1", 900, "UPSERT", 1.0, (0.0, 0.0))
    assert set(again.rows) == {("b", "b1")} and again.latest == 1060


def records(*rows):
    return "\n".join(json.dumps({"objectId": o, "queryId": "q0", "eventTime": t, "opType": op, "attributes": a, "missingMask": [False] * len(a)}) for o, t, op, a in rows)


def test_ranking_in_the_plane():
    rng = np.random.default_rng(3)
    objects, p, attrs = [f"o{i}" for i in rng.integers(0, 12, 90)], rng.random(90), rng.integers(0, 6, (90, 2)) / 5
    flat = live.ranking(objects, p, attrs, np.array([0.2, 0.3]), 20)
    wide = live.ranking(objects, p, np.column_stack([attrs, np.zeros(90)]), np.array([0.2, 0.3, 0.0]), 20)
    assert [r[:2] for r in flat] == [r[:2] for r in wide] and np.allclose([r[2:] for r in flat], [r[2:] for r in wide])


def test_stream_takes_events_in_order_and_by_a_synopsis(spark, tmp_path):
    from orthant.operators import impute

    train = spark.createDataFrame([("q0", x, y) for x, y in [(0.1, 0.2), (0.15, 0.25), (0.8, 0.7), (0.9, 0.75)]], "query_id string, a0 double, a1 double")
    chosen = impute.determinants(train, 2, 2)
    buckets = impute.bucket_candidates(train, chosen, 2, 2)
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(records(("b", 4000, "DELETE", [0.0, 0.0]), ("c", 3500, "UPSERT", [0.9, 0.9]), ("b", 2000, "UPSERT", [0.2, 0.2]), ("a", 1000, "UPSERT", [0.12, None])))
    stream = live.imputed(decode(spark.readStream.format("text").load(str(source)), "value"), 2, chosen, buckets)
    out = live.live_rankings(stream, {"q0": [0.0, 0.0]}, k=3)
    writing = out.writeStream.format("memory").queryName("live_order").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    writing.awaitTermination(120)
    rows = spark.table("live_order").collect()
    last = sorted((r.rank, r.object_id, r.n_inst) for r in rows if r.event_time == 4000)
    assert last == [(1, "a", 2), (2, "c", 1)] and {r.event_time for r in rows} == {1000, 2000, 3500, 4000}


def test_stream_and_snapshot(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(records(("a", 1000, "UPSERT", [0.1, 0.1]), ("b", 2000, "UPSERT", [0.2, 0.2])))
    (source / "2.json").write_text(records(("b", 3000, "DELETE", [0.0, 0.0]), ("c", 3500, "UPSERT", [0.3, 0.3])))
    stream = decode(spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(source)), "value")
    landed = live.snapshot(stream, str(tmp_path / "land"))
    assert landed.count() == 4 == live.snapshot(stream, str(tmp_path / "land")).count()
    out = live.live_rankings(stream, {"q0": [0.0, 0.0]}, k=3)
    writing = out.writeStream.format("memory").queryName("live_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    writing.awaitTermination(120)
    rows = spark.table("live_test").collect()
    last = sorted((r.rank, r.object_id, r.score) for r in rows if r.event_time == 3500)
    assert last == [(1, "a", 1.0), (2, "c", 0.0)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        live.snapshot(decode(spark.readStream.format("text").load(str(tmp_path / "none"))), str(tmp_path / "land2"))
