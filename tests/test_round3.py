"""Findings of round 3: whole results by ways whose cost follows the input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith.operators import forward, inversion, locate, runs


def _boxes(spark, variants):
    rows = [(n, g, 100.0 * g, 0.0, -300.0 + s, 50.0) for n, s in enumerate(variants) for g in range(3)]
    return forward.box_facets(spark.createDataFrame(rows, "variant int, group_id int, cx double, cy double, cz double, half double"))


def test_f1_points_are_not_repeated_for_the_variants_of_a_model(spark):
    rng = np.random.default_rng(1)
    at = np.c_[rng.uniform(-200, 400, 400), rng.uniform(-80, 80, 400), rng.uniform(-400, -200, 400)]
    points = spark.createDataFrame(pd.DataFrame({"obs_id": np.arange(400), **dict(zip("xyz", at.T)), "own": np.arange(400) % 7}))
    got = locate.holders(points, _boxes(spark, [0.0, 40.0]), ["variant"], ["own"]).toPandas()
    want = set()
    for n, s in enumerate([0.0, 40.0]):
        for i, (x, y, z) in enumerate(at):
            inside = [k for k in range(3) if abs(x - 100 * k) <= 50 and abs(y) <= 50 and abs(z + 300 - s) <= 50]
            if inside:
                want.add((i, i % 7, n, inside[0]))
    assert {tuple(int(v) for v in r) for r in got[["obs_id", "own", "variant", "group_id"]].to_numpy()} == want
    # a mesh that is not closed keeps its rays from below its x
    wall = _boxes(spark, [0.0]).filter("group_id = 0 AND t_id >= 10").drop("variant")
    far = spark.createDataFrame([(1, -900.0, 3.0, -300.0), (2, 900.0, 3.0, -300.0)], "obs_id int, x double, y double, z double")
    assert [r.obs_id for r in locate.holders(far, wall).collect()] == [1]


def test_f1_gradient_counts_intervals_inside_and_outside(spark):
    rows = [("a", 0.0, 0.0, 335.0, 345.0, 0), ("b", 0.0, 0.0, 335.0, 345.0, 1), ("c", 900.0, 0.0, 10.0, 14.0, -1), ("d", 900.0, 0.0, 10.0, 14.0, 2), ("e", 0.0, 0.0, 335.0, 345.0, None)]
    cons = spark.createDataFrame(rows, "obs_id string, x double, y double, z_top double, z_bottom double, litho_group_id int")
    box = spark.createDataFrame([(0, 0.0, 0.0, -300.0, 50.0)], "group_id int, cx double, cy double, cz double, half double")
    assert runs.constraint_penalty(cons, forward.box_facets(box)).first().penalty == 100.0 + 16.0

    def moved(moves):
        return forward.box_facets(box.crossJoin(moves).withColumn("cz", F.col("cz") + F.col("delta")).select("group_id", "variant", "cx", "cy", "cz", "half"))

    # up by 20: a leaves its group, b is outside (still wrong); down: a right, b wrong
    got = runs.constraint_gradient(cons, moved, spark.createDataFrame([(7,)], "dof int"), 20.0).first()
    assert (got.dof, got.gradient) == (7, pytest.approx((216.0 - 116.0) / 40.0))


@pytest.mark.parametrize("kind", ["gravity", "tmi", "tmi_ascoded", "surface"])
def test_f3_blocks_and_broadcast_agree_with_the_column_kernels(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    at = np.c_[np.arange(40), rng.uniform(-200, 400, (40, 3))]
    obs = spark.createDataFrame(pd.DataFrame(at, columns=["obs_id", *"xyz"]).astype({"obs_id": int}))
    facets = _boxes(spark, [0.0, 40.0]).withColumns({"m_x": F.lit(0.3), "m_y": F.col("group_id") + 0.1, "m_z": F.lit(-0.8)})
    f = (0.4, 0.1, -0.9) if kind.startswith("tmi") else None
    unit = tuple(F.lit(x) for x in f) if f else None
    terms = forward.facet_parts(forward.pairs(obs, facets)).select("obs_id", "group_id", (forward._column_kernel(kind, unit) * 2.0).alias("t"))
    want = terms.groupBy("obs_id", "group_id").agg(F.sum("t")).orderBy("obs_id", "group_id").toPandas().to_numpy()
    for most in (1000, 10):
        monkeypatch.setattr(forward, "BROADCAST_FACETS", most)
        monkeypatch.setattr(forward, "_FACET_BLOCK", 7)
        monkeypatch.setattr(forward, "_OBS_BLOCK", 16)
        got = forward.forward(obs, facets, kind, F.lit(2.0), ["group_id"], f)
        if most == 10:
            assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "atan2" not in got._jdf.queryExecution().toString().lower()
        np.testing.assert_allclose(got.orderBy("obs_id", "group_id").toPandas().to_numpy(), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kind", ["gravity", "tmi"])
@pytest.mark.parametrize("most", [1000, 5])
def test_f2_f4_gradient_shuffles_no_pairs(spark, monkeypatch, kind, most):
    monkeypatch.setattr(forward, "BROADCAST_FACETS", most)
    obs = spark.createDataFrame([(1, 15.0, 5.0, 0.0), (2, -40.0, 80.0, 10.0)], "obs_id int, x double, y double, z double")
    facets = _boxes(spark, [0.0]).withColumns({"m_x": F.lit(0.3), "m_y": F.lit(0.1), "m_z": F.lit(-0.8)})
    f = (0.4, 0.1, -0.9) if kind == "tmi" else None
    got = forward.facet_gradient(obs, facets, 1e-3, kind, f).cache()
    if most == 1000:
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert "__move" not in got._jdf.queryExecution().toString()
    one = facets.filter("group_id = 2 AND t_id = 1").withColumn("pz", F.explode(F.array(F.col("pz"), F.col("pz") + 1e-3)))
    unit = tuple(F.lit(x) for x in f) if f else None
    v = {(r.obs_id, r.pz): r.v for r in forward.facet_parts(forward.pairs(obs, one)).select("obs_id", "pz", forward._column_kernel(kind, unit).alias("v")).collect()}
    assert got.count() == 2 * 36
    for r in got.filter("group_id = 2 AND t_id = 1").collect():
        low, high = sorted(z for o, z in v if o == r.obs_id)
        assert r.d_pz == pytest.approx((v[r.obs_id, high] - v[r.obs_id, low]) / 1e-3, rel=1e-6, abs=1e-9)


def test_f5_data_of_one_place_share_a_row_of_the_matrix(spark):
    k = np.arange(60)
    stations = spark.createDataFrame(pd.DataFrame({"i": k, "x": (k * 7 % 5) * 60.0, "y": (k % 2) * 40.0, "z": 0.0 * k}))
    cells = spark.createDataFrame([(j, 50.0 * j, 20.0, -80.0, 25.0, 25.0, 30.0) for j in range(9)], "j long, cx double, cy double, cz double, hx double, hy double, hz double")
    names = ["cx", "cy", "cz", "hx", "hy", "hz"]
    made = inversion.Sensitivity(stations, cells, inversion.prism_gravity, ["x", "y", "z"], names)
    full = inversion.prism_gravity(stations.orderBy("i").toPandas()[["x", "y", "z"]].to_numpy(float), cells.orderBy("j").toPandas()[names].to_numpy(float))
    assert made.blocks.agg(F.sum("height")).first()[0] == 10
    np.testing.assert_allclose(made.dot(np.arange(9.0)), full @ np.arange(9.0), rtol=1e-12)
    np.testing.assert_allclose(made.back(k * 1.0), (k * 1.0) @ full, rtol=1e-12)
    made.release()


def test_f6_idw_takes_samples_of_one_place_together(spark):
    rng = np.random.default_rng(6)
    q, s = rng.uniform(0, 100, (50, 2)), np.repeat(rng.uniform(0, 100, (30, 2)), 4, axis=0)
    s[0], z = q[0], rng.standard_normal(120)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(50, None, 1.0)], "obs_id int, x double, y double")
    samples = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(s, z)] + [(5.0, 5.0, None), (None, 5.0, 7.0)], "sx double, sy double, sz double")
    got = locate.idw(points, samples)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r.obs_id: r.z for r in got.collect()}
    for i, p in enumerate(q):
        w = 1 / np.maximum(((s - p) ** 2).sum(axis=1), 1.0)
        assert got[i] == pytest.approx((w @ z + 7.0) / (w.sum() + 1 / max(((p - 5) ** 2).sum(), 1.0) + 1.0), rel=1e-9)
    assert got[50] == pytest.approx((z.sum() + 7.0) / 122)


def test_f8_to_f10_f15_neighbours_of_few_places_need_no_tree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    t, q = np.round(rng.uniform(0, 4, (300, 2))), np.c_[rng.uniform(0, 4, 80), rng.uniform(0, 1e6, 80)]
    q[:30] = np.round(q[:30])
    targets = spark.createDataFrame(pd.DataFrame({"target_id": np.arange(300)[::-1].copy(), "x": t[:, 0], "y": t[:, 1]}))
    points = spark.createDataFrame(pd.DataFrame({"obs_id": np.arange(80), "x": q[:, 0], "y": q[:, 1]}))
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 20)
    monkeypatch.setattr(locate, "_nearest_by_cells", lambda *a: pytest.fail("the tree was asked"))
    for k in (1, 4):
        got = {(r.obs_id, r["rank"]): (r.target_id, r.d2) for r in locate.nearest(points, targets, k, "xy").collect()}
        for i, p in enumerate(q):
            d2 = (t[:, 0] - p[0]) ** 2 + (t[:, 1] - p[1]) ** 2
            best = sorted(zip(d2, 299 - np.arange(300)))[:k]
            assert [got[i, n + 1] for n in range(k)] == [(b, a) for a, b in best]
