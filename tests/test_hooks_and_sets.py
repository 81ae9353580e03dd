"""Hooks, export sets and readers in ranges: refusals and retries."""

import os

import numpy as np
import pytest

from terralith.operators import hooks
from terralith.operators import inversion as inv
from terralith.sources import grids, write
from terralith.sources import text as t


def test_built_in_hooks_stay(spark):
    with pytest.raises(ValueError, match="built-in"):
        hooks.register("regulariser", "reference", lambda m: m)
    with pytest.raises(ValueError, match="no optimiser"):
        hooks.minimise("nothing", None, None, np.zeros(1), np.zeros(1), np.ones(1))
    with pytest.raises(ValueError, match="no hook"):
        hooks.register("kernel", "x", lambda m: m)
    empty = spark.createDataFrame([], "dof_id long, p double, p0 double")
    assert [tuple(r) for r in hooks.penalties(empty, {"reference": 2.0}).collect()] == [("reference", 0.0)]


def test_newton_and_bounded_agree():
    a, c = np.diag([1.0, 4.0, 9.0]), np.array([1.0, -8.0, 3.0])
    value, gradient = (lambda x: float(0.5 * x @ a @ x - c @ x)), (lambda x: a @ x - c)
    for name in ("bounded", "newton_cg"):
        assert hooks.minimise(name, value, gradient, np.zeros(3), np.full(3, -5.0), np.full(3, 5.0)) == pytest.approx(np.linalg.solve(a, c), abs=1e-4)


def test_gradients_of_several_points_in_one_job(spark):
    rng = np.random.default_rng(1)
    u, d = rng.standard_normal((9, 3)), rng.standard_normal(9)
    units = spark.createDataFrame([(i, j, float(u[i, j])) for i in range(9) for j in range(3)], "obs_id long, group_id int, u double")
    data = spark.createDataFrame([(i, float(d[i]), 0.5) for i in range(9)], "obs_id long, value double, std double")
    points = [rng.standard_normal(3) for _ in range(3)]
    values, slopes = inv.misfit_gradients(units, data, [0, 1, 2], points)
    for p, f, g in zip(points, values, slopes):
        r = u @ p - d
        assert f == pytest.approx(2 * r @ r) and g == pytest.approx(4 * u.T @ r)


def model(spark, lift):
    v = spark.createDataFrame([(g, i, float(i), 0.0, g + lift) for g in (1, 2) for i in range(3)], "group_id int, v_id long, x double, y double, z double")
    f = spark.createDataFrame([(g, 0, 0, 1, 2) for g in (1, 2)], "group_id int, t_id long, v0 long, v1 long, v2 long")
    p = spark.createDataFrame([(1, "a b", 2.5, 0.01), (2, "c", 2.75, 0.0)], "group_id int, name string, density double, susceptibility double")
    return write.export_lines(v, f, p)


def test_export_set_is_in_order_and_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "set")
    for lift in (0.0, 5.0):
        write.export_set(model(spark, lift), path)
    files = {name: [open(os.path.join(path, name, x)).read().splitlines() for x in sorted(os.listdir(os.path.join(path, name))) if x.startswith("part")] for name in os.listdir(path) if name.startswith("file=")}
    assert all(len(parts) == 1 for parts in files.values()) and len(files) == 6
    assert files["file=volume_group_1.ts"][0] == ["GOCAD TSurf 1", "HEADER {", "name:a_b", "*density:2.500000", "*susceptibility:0.010000", "}", "TFACE",
                                                  *[f"VRTX {i + 1} {i}.000 0.000 6.000" for i in range(3)], "TRGL 1 2 3", "END"]
    assert [x for x in os.listdir(tmp_path) if "writing" in x] == []
    listed = dict(line.rsplit(",", 2)[:2] for line in files["file=manifest.csv"][0])
    assert listed["volume_group_1.ts"] == "12" and listed["starting_model.csv"] == "3"


def test_label_grid_in_ranges(spark, tmp_path):
    labels = np.arange(60, dtype="<i4") - 7
    path = tmp_path / "g.bin"
    path.write_bytes(b"5 4 3 extra\n" + labels.tobytes())
    df = grids.read_label_grid(spark, str(path), 28)
    assert df.rdd.getNumPartitions() == 9
    assert [tuple(r) for r in df.orderBy("iz", "iy", "ix").collect()] == [(i % 5, i // 5 % 4, i // 20, i - 7) for i in range(60)]
    path.write_bytes(b"5 4 4\n" + labels.tobytes())
    with pytest.raises(Exception, match="labels and dimensions differ"):
        grids.read_label_grid(spark, str(path)).count()


def test_strict_model_lines_refuse(spark):
    lines = lambda *x: spark.createDataFrame([(i + 1, line) for i, line in enumerate(x)], "line_no long, line string")
    got = t.strict_model_lines(lines("2 1", "2 0.5", "", "1.5 2.5 3.5"))
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(0, 0.5), (1, 1.5), (2, 2.5), (3, 3.5)]
    with pytest.raises(ValueError, match="differ"):
        t.strict_model_lines(lines("2 1 2", "1 2 3"))
    with pytest.raises(ValueError, match="first"):
        t.strict_model_lines(lines("2 x 2", "1 2 3 4"))
