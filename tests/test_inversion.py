"""Inversions of meshed models: wiring, gradients, the loop's log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.operators import forward as fw
from terralith.operators import runs
from terralith.operators.meshfield import MeshField, Misfit, vertex_dofs

TETRA = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]


def two_bodies(spark, lift=0.0):
    """Two tetrahedra that share the edge of vertices 0 and 1; tops may move."""
    a = [(0.0, 0.0, -300.0), (300.0, 0.0, -300.0), (100.0, 250.0, -300.0), (120.0, 90.0, -80.0 + lift)]
    b = [(0.0, 0.0, -300.0), (100.0, -250.0, -300.0), (300.0, 0.0, -300.0), (120.0, -90.0, -100.0 + lift)]
    free = ["Z_ONLY", "FIXED", "FIXED", "XYZ_FREE"], ["Z_ONLY", "FIXED", "FIXED", "XYZ_FREE"]
    rows = [(m, i, *p, free[m][i]) for m, ps in enumerate((a, b)) for i, p in enumerate(ps)]
    vertices = spark.createDataFrame(rows, "mesh_id int, v_id long, x double, y double, z double, freedom string")
    triangles = spark.createDataFrame([(m, t, *v) for m in (0, 1) for t, v in enumerate(TETRA)], "mesh_id int, t_id long, v0 long, v1 long, v2 long")
    return vertices, triangles


def stations(spark):
    return spark.createDataFrame([(5 * i, -200.0 + 100 * (i % 6), -200.0 + 100 * (i // 6), 0.0) for i in range(36)], "obs_id long, x double, y double, z double")


DENSITY = {0: 0.4, 1: 0.7}


def test_coincident_vertices_share_a_degree_of_freedom(spark):
    rows = vertex_dofs(two_bodies(spark)[0]).collect()
    at = {(r.mesh_id, r.v_id, r.axis): r.dof for r in rows}
    assert len(at) == 8 and len(set(at.values())) == 7
    assert at[0, 0, "z"] == at[1, 0, "z"] and sorted(set(at.values())) == list(range(7))


def test_response_is_the_forward_model(spark):
    vertices, triangles = two_bodies(spark)
    field = MeshField.build(vertices, triangles, stations(spark))
    moved = field.start + np.linspace(1, 5, len(field.start))
    facets = fw.mesh_facets(field.vertices(vertices, moved).select("mesh_id", "v_id", "x", "y", "z"), triangles, ["mesh_id"]).withColumn("density", F.when(F.col("mesh_id") == 0, 0.4).otherwise(0.7))
    want = {r.obs_id: r.response for r in fw.gravity(stations(spark), facets).collect()}
    assert field.response(moved, DENSITY) == pytest.approx([want[i] for i in field.obs_id])
    units = field.units(moved).groupBy("obs_id").agg(F.sum(F.col("u") * F.when(F.col("group_id") == 0, 0.4).otherwise(0.7)).alias("r")).collect()
    assert {r.obs_id: r.r for r in units} == pytest.approx(want)
    field.release()


def test_gradient_is_the_chain_rule(spark):
    vertices, triangles = two_bodies(spark)
    field = MeshField.build(vertices, triangles, stations(spark))
    observed = field.response(field.start + 3.0, DENSITY)
    misfit = Misfit(field, observed, np.full(36, 0.05), DENSITY)
    x = np.linspace(-0.3, 0.4, len(field.start))
    got = misfit.gradient(x)
    for k in range(len(x)):
        h = np.zeros(len(x))
        h[k] = 1e-3
        assert got[k] == pytest.approx((misfit.value(x + h) - misfit.value(x - h)) / 2e-3, rel=1e-3, abs=1e-6)


def data(spark):
    vertices, triangles = two_bodies(spark)
    field = MeshField.build(vertices, triangles, stations(spark))
    value = field.response(field.start, DENSITY)
    rows = [(int(i), *map(float, p), float(v), 0.005) for i, p, v in zip(field.obs_id, field.stations, value)]
    return spark.createDataFrame(rows, "obs_id long, x double, y double, z double, value double, std double")


def test_misfit_falls_and_every_phase_is_accepted(spark):
    vertices, triangles = two_bodies(spark, 12.0)
    vertices = vertices.withColumn("freedom", F.when(F.col("freedom") == "XYZ_FREE", "Z_ONLY").otherwise("FIXED"))
    rows = data(spark)
    done = runs.invert_mesh(vertices, triangles, rows, dict.fromkeys((0, 1), 0.5), 0.0, 2.0, 60.0, most=8, interval=4, margin_gate=lambda moved: moved.filter("z > 0").isEmpty())
    observed = np.array([r.value for r in rows.orderBy("obs_id").collect()])
    misfit = lambda x, density: float(np.square(done.field.response(x, density) - observed).sum())
    assert misfit(done.parameters, done.density) < 0.03 * misfit(done.field.start, dict.fromkeys((0, 1), 0.5))
    assert all(r["accepted"] and r["halved"] == 0 for r in done.log)


def test_steps_that_break_the_model_are_halved_or_dropped(spark):
    vertices, triangles = two_bodies(spark, 12.0)
    vertices = vertices.withColumn("freedom", F.when(F.col("freedom") == "XYZ_FREE", "Z_ONLY").otherwise("FIXED"))
    start = {r.v_id + 10 * r.mesh_id: r.z for r in vertices.collect()}
    run = lambda most: runs.invert_mesh(vertices, triangles, data(spark), DENSITY, 0.5, 0.5, 60.0, most=6, interval=6, margin_gate=lambda moved: max(abs(r.z - start[r.v_id + 10 * r.mesh_id]) for r in moved.collect()) <= most)
    half = run(5.0)
    assert half.log[0]["accepted"] and half.log[0]["halved"] >= 1
    assert np.abs(half.parameters - half.field.start).max() <= 5.0
    none = run(1e-9)
    assert not none.log[0]["accepted"] and none.log[0]["halved"] == 6
    assert none.parameters == pytest.approx(none.field.start)


def test_sensitivity_products_are_the_matrix(spark, monkeypatch):
    from terralith.operators import inversion as inv

    monkeypatch.setattr(inv, "BLOCK_BYTES", 8 * 7 * 7)
    rng = np.random.default_rng(2)
    o, c = rng.uniform(-100, 100, (23, 3)), np.hstack([rng.uniform(-100, 100, (17, 2)), rng.uniform(-90, -50, (17, 1)), rng.uniform(5, 20, (17, 3))])
    names = ["cx", "cy", "cz", "hx", "hy", "hz"]
    stations = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(o)], "i long, x double, y double, z double")
    cells = spark.createDataFrame([(j, *map(float, r)) for j, r in enumerate(c)], "j long, cx double, cy double, cz double, hx double, hy double, hz double")
    dense = inv.prism_gravity(o, c)
    made = inv.Sensitivity(stations, cells, inv.prism_gravity, ["x", "y", "z"], names)
    v, w = rng.standard_normal(17), rng.standard_normal(23)
    assert made.dot(v) == pytest.approx(dense @ v) and made.back(w) == pytest.approx(w @ dense)
    made.release()
    facets = fw.box_facets(cells.withColumnsRenamed({"j": "group_id"}))
    want = {(r.obs_id, r.group_id): r.response for r in fw.gravity(stations.withColumnRenamed("i", "obs_id"), facets, ["group_id"], density=None).collect()}
    assert all(want[i, j] == pytest.approx(dense[i, j], rel=1e-6, abs=1e-9) for i in range(23) for j in range(17))


def test_matrix_free_solution_is_the_dense_one():
    from terralith.operators import inversion as inv

    rng = np.random.default_rng(3)
    a, std, weight = rng.standard_normal((40, 12)), np.full(40, 0.1), rng.uniform(0.5, 2, 12)
    data = a @ rng.standard_normal(12)
    m, log = inv.sparse_inversion(lambda v: a @ v, lambda r: r @ a, data, std, weight, -1e9, 1e9, norm=2.0, rounds=1, inner=60)
    dense = np.linalg.solve(a.T @ a / 0.01 + log[0]["beta"] * np.diag(weight**2), a.T @ data / 0.01)
    assert m == pytest.approx(dense, rel=1e-6)
    inside, _ = inv.sparse_inversion(lambda v: a @ v, lambda r: r @ a, data, std, weight, 0.0, 0.5, rounds=8, inner=20)
    assert inside.min() >= 0 and inside.max() <= 5.0
    few = np.zeros(12)
    few[[2, 7]] = 1.0
    m, _ = inv.sparse_inversion(lambda v: a @ v, lambda r: r @ a, a @ few, std, weight, -2.0, 2.0, norm=0.5, rounds=12, inner=40, target=0.05)
    assert set(np.flatnonzero(np.abs(m) > 0.1)) == {2, 7}
