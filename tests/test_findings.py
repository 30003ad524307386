"""Ways that spare rows of pairs give the same as those with them."""

import random

import numpy as np
from pyspark.sql import functions as F

from orthant.operators import bounds as B
from orthant.operators import plane, rtree, score, space
from orthant.operators.instances import with_distances
from orthant.plans import engine, surface
from orthant.storage import materialize, shared_dir

FOLDER = "/root/testdata/sf0.001"


def made(spark, seed=3, n=30, parts=3):
    """Objects with coordinates that often meet edges of boxes; one instance has two rows."""
    rng, rows = random.Random(seed), []
    for o in range(n):
        m = rng.randint(1, 6)
        rows += [(o, f"{o}-{i}", 1 / m, o % parts, rng.randrange(9) / 8, rng.randrange(9) / 8) for i in range(m)]
    rows.append((0, "0-0", 0.5, 0, 0.125, 0.875))
    data = spark.createDataFrame(rows, "object_id long, instance_id string, p double, part int, a0 double, a1 double")
    points = spark.createDataFrame([("q0", 0.25, 0.5), ("q1", 0.0, 0.0)], "query_id string, q0 double, q1 double")
    return data, points, with_distances(data, points, 2), rtree.summaries(rtree.build(data, 2, 3)[1], points, 2)


def close(a, b):
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (a, b.select(a.columns)))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(abs(v - w) < 1e-9 if isinstance(v, float) else v == w for v, w in zip(x, y, strict=True)), (x, y)


def test_standing_points():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 8, 64, 100):
        x, y, w = rng.integers(0, 6, n) / 5, rng.integers(0, 6, n) / 5, rng.random(n)
        ax, ay = rng.integers(-1, 8, 200) / 5, rng.integers(-1, 8, 200) / 5
        want = [w[(x >= a) & (y >= b) & ((x > a) | (y > b))].sum() for a, b in zip(ax, ay, strict=True)]
        got = plane.Standing(x, y, w + 1j).dominated(ax, ay)
        assert np.allclose(got.real, want) and np.array_equal(got.imag > 0.5, np.array(want) > 0)


def test_references_within_tasks(spark, monkeypatch):
    """no row for an instance and a corner of a box leaves a task; strips give the same."""
    _, _, inst, boxes = made(spark)
    with monkeypatch.context() as m:
        m.setattr(plane, "masses", None)
        masses, counts = rtree.remote_masses(inst, boxes, 2), rtree.emission_counts(inst, boxes, 2)
        masses, counts = materialize(masses, folder := shared_dir(spark), "m"), materialize(counts, folder, "c")
    monkeypatch.setattr(rtree, "MAX_SENT_NODES", 1)
    close(masses, rtree.remote_masses(inst, boxes, 2))
    close(counts, rtree.emission_counts(inst, boxes, 2))


def test_records_without_joined_pairs(spark, monkeypatch):
    """instances of one row get their arrays without a join; the records are the same."""
    _, _, inst, boxes = made(spark)
    plain = inst.where("instance_id <> '0-0'")
    with monkeypatch.context() as m:
        m.setattr(rtree, "inspect", None)
        materialize(rtree.emissions(plain, boxes, 2, True), shared_dir(spark), "r")
    for packed in (True, False):
        got = rtree.emissions(inst, boxes, 2, packed)
        with monkeypatch.context() as m:
            m.setattr(rtree, "MAX_SENT_NODES", 1)
            close(got, rtree.emissions(inst, boxes, 2, packed))


def test_own_shares_within_tasks(spark, monkeypatch):
    """own shares of small objects take no strips and no levels, in any number of dimensions; large ones do."""
    data, _, _, _ = made(spark)
    inst = data.select(F.lit("q0").alias("query_id"), "object_id", "part", "p", *[F.expr(e).alias(f"d{d}") for d, e in enumerate(("a0", "a1", "(a0 * 8 + object_id) % 3", "a1 % 0.5"))])
    for dims in (1, 2, 3):
        with monkeypatch.context() as m:
            m.setattr(score, "_masses", None)
            within = score.own_shares(inst, dims)
        with monkeypatch.context() as m:
            m.setattr(score, "OWN_MAX", 3)
            mixed = score.own_shares(inst, dims)
        monkeypatch.setattr(score, "OWN_ROWS", 7)
        close(within, score.own_shares(inst, dims))
        close(within, mixed)
    group, rng = np.sort(np.arange(700) % 2), np.random.default_rng(5)
    x, y, p = rng.integers(0, 9, 700), rng.integers(0, 9, 700), rng.random(700)
    order = np.lexsort((y, x, group))
    x, y, p = x[order] / 8, y[order] / 8, p[order]
    want = [p[(group == group[i]) & (x >= x[i]) & (y >= y[i]) & ((x > x[i]) | (y > y[i]))].sum() for i in range(700)]
    assert np.allclose(score.within_groups(group, [x, y], p), want) and np.allclose(score.within_groups(group, [x, y, np.zeros(700)], p), want)


def test_traces_score_nothing(spark, monkeypatch):
    """F2: the decisions need no scores of survivors."""
    monkeypatch.setattr(score, "scores", None)
    assert surface.indexed_traces(spark, FOLDER).count() == 50


def test_treatments_share(spark, monkeypatch):
    """bounds are taken once for all treatments, and scores of all objects once."""
    data, points, _, _ = made(spark)
    ready, calls = engine.Prepared(data, points, 2, 3, "grid"), {"bounds": 0, "scores": 0}

    def counted(name, f):
        def run(*a, **b):
            calls[name] += 1
            return f(*a, **b)

        return run

    monkeypatch.setattr(B, "partition_bounds", counted("bounds", B.partition_bounds))
    monkeypatch.setattr(score, "scores", counted("scores", score.scores))
    tops = [sorted(tuple(r) for r in ready.top(how).select("query_id", "rank", "object_id", "score").collect()) for how in engine.TREATMENTS.values()]
    assert all(t == tops[0] for t in tops) and calls == {"bounds": 1, "scores": 1}
    alone = engine.rank(data, points, 2, 3, "hgtp", method="grid")[0]
    assert sorted(tuple(r) for r in alone.select("query_id", "rank", "object_id", "score").collect()) == tops[0]


def test_level_cost_has_the_root(spark):
    """F8: whatever their number, all levels are there, up to one node for each part."""
    data, points, _, _ = made(spark, n=90)
    boxes = rtree.summaries(rtree.build(data, 2, 2)[1], points, 2)
    got = {r.level: r.nodes for r in rtree.export_level_cost(with_distances(data, points, 2), boxes, 2).where("query_id = 'q0'").collect()}
    assert sorted(got) == list(range(len(got))) and len(got) > 4 and got[max(got)] == 3


def test_dominated_sums_in_space(monkeypatch):
    """sums in memory, with and without strict coordinates, by cells and by halves, over several chunks."""
    rng = np.random.default_rng(6)
    for many in ((6, 7, 8), (2, 3, 90), (50, 60, 70)):
        points = np.unique(np.column_stack([rng.integers(0, m, 300) for m in many]), axis=0) / 8
        at, w = list(points[rng.permutation(len(points))].T), rng.random(len(points))
        for strict in ((False,) * 3, (True, False, False), (True, True, False), (False, True, False)):
            wins = np.all([(x[None] > x[:, None]) if s else (x[None] >= x[:, None]) for x, s in zip(at, strict, strict=True)], axis=0)
            np.fill_diagonal(wins, False)
            for dense in (1, 16_384):
                monkeypatch.setattr(space, "DENSE", dense)
                assert np.allclose(space.dominated_sums(at, strict, w), wins @ w), (many, strict, dense)


def test_space_takes_one_row_for_a_point(spark, monkeypatch):
    """no table has more rows than there are points, whole groups, strips and slices of them give the same."""
    monkeypatch.setattr(score, "PARTITION_POINTS", 60)
    monkeypatch.setattr(space, "SLICE_ROWS", 150)
    monkeypatch.setattr(plane, "masses", None)
    rng, written = random.Random(8), []
    rows = [("q0" if i % 12 else "q1", rng.randrange(30), i % 2, rng.random(), *(rng.randrange(m) / 8 for m in (4, 300, 9))) for i in range(600)]
    inst = spark.createDataFrame(rows, "query_id string, object_id long, part int, p double, d0 double, d1 double, d2 double")

    def counted(df, folder, name):
        written.append((name, (out := materialize(df, folder, name)).count()))
        return out

    monkeypatch.setattr(space, "materialize", counted)
    monkeypatch.setattr(score, "materialize", counted)
    got = materialize(score.scores(inst, 3, method="grid"), shared_dir(spark), "scores")
    close(score.scores(inst, 3, method="direct"), got)
    by_turn = lambda start: sum(n for name, n in written if name.startswith(start))
    assert max(n for _, n in written) <= 600 and by_turn("points-") >= by_turn("space-0-") == by_turn("space-1-") == by_turn("space-2-") > 0 < by_turn("space-within")


def test_instances_are_made_once(spark):
    """query points are sent to the instances; no product of partitions, which makes the instances anew for each."""
    data, points, _, _ = made(spark)
    plan = with_distances(data, points, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
