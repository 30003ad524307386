"""The queries leave no row or component out, and a large group is no single task's."""

import random

import numpy as np

from orthant.operators import plane, score
from orthant.operators.ranks import numbered
from orthant.plans import oracles, queries
from orthant.storage import shared_dir

FOLDER = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    n, objects = items.count(), items.select("l_partkey").distinct().count()
    run = lambda name: queries.queries()[name](spark, FOLDER)
    assert run("csv_profile").first().n_rows == n
    audit = run("probability_audit").collect()
    assert len(audit) == 2 * objects and not any(r.bad_mass or r.bad_parts for r in audit)
    assert sum(r.n_inst for r in run("ptd_score_all_objects").collect()) == 2 * n
    vectors = [(r.label, r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    sizes = {k: sum(v[0] == k for v in vectors) for k in {v[0] for v in vectors}}
    mine = dict.fromkeys(sizes, 0.0)
    for k, _, x in vectors:
        for k2, _, y in vectors:
            if k != k2 and all(abs(a) <= abs(b) for a, b in zip(x, y, strict=True)) and x != y:
                mine[k] += 1 / sizes[k] / sizes[k2]
    got = {r.object_id: r.score for r in run("ptd_embedding_topk").collect()}
    assert got == {k: round(mine[k], 6) for k in got} and len(got) == min(10, len(sizes))
    assert set(queries.queries()) == set(oracles.oracle_sql())


def test_later_and_higher():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 6, 17, 64, 201):
        y, w = rng.permutation(n), rng.random(n)
        want = [w[i + 1 :][y[i + 1 :] > y[i]].sum() for i in range(n)]
        assert np.allclose(plane.later_and_higher(y, [w])[0], want)
    group, x, y, w = rng.integers(0, 3, 80), rng.integers(0, 4, 80), rng.integers(0, 4, 80), rng.random(80)
    want = [sum(w[j] for j in range(80) if group[j] == group[i] and x[i] <= x[j] and y[i] <= y[j] and (x[i], y[i]) != (x[j], y[j])) for i in range(80)]
    assert np.allclose(plane.dominated_sums(group, x, y, w), want)


def test_strips_cells_and_levels(spark, monkeypatch):
    """Small strips, so that one query, one object and one point of many instances lie in several of them."""
    monkeypatch.setattr(plane, "STRIP_POINTS", 40)
    monkeypatch.setattr(score, "PARTITION_POINTS", 60)
    rng = random.Random(2)
    rows = [("q0" if i % 3 else "q1", 7 if i % 3 == 1 else rng.randrange(25), f"i{i}", i % 2, rng.random(), *([0.5] * 3 if i % 3 == 2 else [rng.randrange(12) / 8 for _ in range(3)])) for i in range(700)]
    inst = spark.createDataFrame(rows, "query_id string, object_id long, instance_id string, part int, p double, d0 double, d1 double, d2 double")
    for dims in (1, 2, 3):
        want, got = ({(r.query_id, r.object_id): r.score for r in score.scores(inst, dims, method=m).collect()} for m in ("direct", "grid"))
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want), dims


def test_numbered(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", (i * 7919) % 500) for i in range(500)], "k string, v long").repartition(7)
    got = numbered(rows, ["k"], ["v"], shared_dir(spark), "test").collect()
    for k in "ab":
        assert [r.n for r in sorted((r for r in got if r.k == k), key=lambda r: r.v)] == list(range(1, sum(r.k == k for r in got) + 1))
