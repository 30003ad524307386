"""Scores, bounds and pruning against brute force and known facts."""

import random

import pytest
from pyspark.sql import functions as F

from orthant.operators import bounds as B
from orthant.operators import impute, instances, rtree, score
from orthant.plans import engine


def brute(rows, point, dims):
    """score of each object; rows are (object, p, attrs)."""
    d = [(o, p, [abs(a - q) for a, q in zip(x, point, strict=True)]) for o, p, x in rows]
    out = {o: 0.0 for o, _, _ in rows}
    for o, p, x in d:
        for o2, p2, y in d:
            if o != o2 and all(a <= b for a, b in zip(x, y, strict=True)) and any(a < b for a, b in zip(x, y, strict=True)):
                out[o] += p * p2
    return out


def table(spark, rows, dims, parts=3):
    data = [(o, f"{o}-{i}", p, o % parts, *x) for i, (o, p, x) in enumerate(rows)]
    return spark.createDataFrame(data, "object_id int, instance_id string, p double, part int, " + ", ".join(f"a{d} double" for d in range(dims)))


def points(spark, *qs):
    return spark.createDataFrame([(f"q{i}", *map(float, q)) for i, q in enumerate(qs)], "query_id string, " + ", ".join(f"q{d} double" for d in range(len(qs[0]))))


def random_rows(seed, dims, n=40):
    rng = random.Random(seed)
    out = []
    for o in range(n):
        m = rng.randint(1, 8)
        w = [rng.random() + 0.01 for _ in range(m)]
        for k in range(m):
            x = [round(rng.random() * 8) / 8 if seed % 2 else rng.random() for _ in range(dims)]
            out.append((o, w[k] / sum(w), x))
    return out


def test_facts(spark):
    rows = [(1, 1.0, [0.1, 0.1]), (2, 0.4, [0.2, 0.2]), (2, 0.6, [0.3, 0.3]), (3, 1.0, [0.3, 0.2])]
    inst = instances.with_distances(table(spark, rows, 2), points(spark, (0, 0)), 2)
    got = {r.object_id: r.score for r in score.scores(inst, 2).collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(0.4) and got[3] == pytest.approx(0.6)


@pytest.mark.parametrize("seed,dims", [(0, 2), (1, 2), (2, 1), (3, 3), (4, 4), (5, 3)])
def test_scores_by_all_methods(spark, seed, dims):
    rows, q = random_rows(seed, dims), [0.3] * dims
    inst = instances.with_distances(table(spark, rows, dims), points(spark, q), dims)
    want = brute(rows, q, dims)
    for method in ["direct", "blocks", *(["grid"] if dims == 2 else [])]:
        got = {r.object_id: r.score for r in score.scores(inst, dims, method=method).collect()}
        assert got.keys() == want.keys() and all(got[o] == pytest.approx(want[o], abs=1e-9) for o in want), method


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bounds_hold_and_nothing_true_is_pruned(spark, seed):
    rows, q, k = random_rows(seed, 2), [0.4, 0.2], 5
    data, qs = table(spark, rows, 2), points(spark, q)
    want = brute(rows, q, 2)
    best = [o for o, _ in sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    inst = instances.with_distances(data, qs, 2)
    for r in B.partition_bounds(inst, 2).collect():
        assert r.lb - 1e-6 <= want[r.object_id] <= r.ub + 1e-6
    top, marked = engine.rank_indexed(data, qs, 2, k, fanout=3)
    for r in marked.collect():
        assert r.lb - 1e-6 <= want[r.object_id] <= r.ub + 1e-6
    assert [r.object_id for r in top.orderBy("rank").collect()] == best
    met = rtree.inspect(inst, rtree.summaries(rtree.build(data, 2, 3)[1], qs, 2), 2).where("not is_full").groupBy("object_id").count().collect()
    refs = {r.object_id: r.partial_refs for r in marked.collect() if r.partial_refs}
    assert refs == {r.object_id: r["count"] for r in met}
    coarse, _ = engine.rank_indexed(data, qs, 2, k, level=1, fanout=3)
    assert [r.object_id for r in coarse.orderBy("rank").collect()] == best
    for name in ("baseline", "aes-dscp", "improved-aes-dscp"):
        top, marked = engine.rank(data, qs, 2, k, name)
        assert [r.object_id for r in top.orderBy("rank").collect()] == best, name
        audit = B.false_prunes(marked, top).first()
        assert audit.false_prunes == 0 and audit.objects == audit.refined + audit.pruned == len(want)


def test_leaf_bounds_are_sound(spark):
    rows, q = random_rows(7, 2), [0.5, 0.5]
    data, qs = table(spark, rows, 2), points(spark, q)
    leaves, nodes = rtree.build(data, 2, 4)
    ub = rtree.leaf_upper_bounds(rtree.summaries(nodes, qs, 2), 2)
    mass = instances.object_summary(data, 2).select("object_id", "mass")
    bound = leaves.join(ub, (leaves.part == ub.part) & (leaves.leaf == ub.node)).join(mass, "object_id")
    want = brute(rows, q, 2)
    assert all(want[r.object_id] <= r.mass * r.leaf_ub + 1e-9 for r in bound.collect())


def test_treatments():
    assert engine.treatment(" FULL ").name == "aes-dscp" and engine.treatment("hgtp").improved and len(engine.TREATMENTS) == 8
    assert [engine.treatment(x).name for x in ("AES+DHCP", "aes_dscp", "improved-full", "improved-dscp", "improved_aes")] == ["aes-dscp", "aes-dscp", "improved-aes-dscp", "improved-dscp-only", "improved-aes-only"]
    with pytest.raises(ValueError):
        engine.treatment("other")


def test_deletes_are_no_instances(spark):
    rows = spark.createDataFrame([("o", "i", "UPSERT", 1.0, 0.2, None), ("o", "j", "DELETE", 1.0, None, 0.4)], "object_id string, instance_id string, op_type string, p double, a0 double, a1 double")
    rules = impute.rule_candidates({}, 2)
    assert sorted(r.instance_id for r in impute.expand(rows, rules).collect()) == ["i#r0", "i#r1"]
    kept = {r.instance_id: r for r in impute.with_deletes(impute.expand(rows, rules), rows, 2).collect()}
    assert set(kept) == {"i#r0", "i#r1", "j"} and (kept["j"].object_id, kept["j"].op_type, kept["j"].p, kept["j"].a1) == ("o", "DELETE", None, None)


def test_declared_boxes_choose_the_indexed_plan(spark):
    data, qs = table(spark, random_rows(4, 2), 2), points(spark, [0.3, 0.3])
    boxed = data.withColumns({f"mbr_{s}{d}": F.lit(0.0) for s in ("lo", "hi") for d in range(2)})
    assert not engine.indexed(data, 2) and engine.indexed(boxed, 2)
    answers = [[r.object_id for r in engine.rank_any(t, qs, 2, 4, a)[0].orderBy("rank").collect()] for t, a in ((data, "aes-dscp"), (boxed, "aes-dscp"), (boxed, "hgtp"))]
    assert answers[0] == answers[1] == answers[2]


def test_two_point_rules(spark):
    rows = spark.createDataFrame([("o", "i", 0.2, 3, 0.2, None)], "object_id string, instance_id string, p double, part int, a0 double, a1 double")
    got = impute.expand(rows, impute.rule_candidates({1: (0.1, 0.9, 0.7)}, 2)).orderBy("instance_id").collect()
    assert [(r.instance_id, round(r.p, 9), r.a1, r.part) for r in got] == [("i#r0", 0.14, 0.1, 3), ("i#r1", 0.06, 0.9, 3)]
    both = impute.expand(rows.withColumn("a0", F.lit(float("nan"))), impute.rule_candidates({}, 2)).orderBy("instance_id").collect()
    assert [(r.a0, r.a1) for r in both] == [(0.25, 0.25), (0.25, 0.75), (0.75, 0.25), (0.75, 0.75)] and sum(r.p for r in both) == pytest.approx(0.2)


def test_synopsis(spark):
    rows = spark.createDataFrame([("q0", str(i), str(i), 1.0, 0, x, y) for i, (x, y) in enumerate([(0.1, 0.2), (0.15, 0.25), (0.8, 0.7), (0.9, 0.75), (0.12, None)])], "query_id string, object_id string, instance_id string, p double, part int, a0 double, a1 double")
    chosen = impute.determinants(rows, 2, 2)
    buckets = impute.bucket_candidates(rows, chosen, 2, 2)
    got = impute.impute(rows, chosen, buckets, 2, 2).where("object_id = '4'").collect()
    assert len(got) == 2 and all(r.a1 < 0.5 for r in got) and sum(r.p for r in got) == pytest.approx(1)


def test_audits_and_emissions(spark):
    rows = [(1, 0.4, [0.1, 0.1]), (1, 0.4, [0.2, 0.2]), (4, 1.0, [0.3, 0.3])]
    inst = instances.with_distances(table(spark, rows, 2), points(spark, (0, 0)), 2)
    assert [r.object_id for r in instances.probability_audit(inst).where("bad_mass").collect()] == [1]
    marked = B.partition_bounds(inst, 2).withColumn("survives", F.lit(True))
    r = B.emission_counts(inst, marked).first()
    assert (r.baseline_emissions, r.aes_emissions) == (3, 3) == (B.emissions(inst, False).count(), B.emissions(inst, True).count())


def test_empty_input(spark):
    inst = instances.with_distances(table(spark, [], 2), points(spark, (0, 0)), 2)
    assert score.scores(inst, 2).count() == 0 and B.pruned(B.partition_bounds(inst, 2), 3).count() == 0
