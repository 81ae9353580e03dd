"""Findings F12, F13, F14, F16, F21 and F22 of round 3: steps that grow no faster than their tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _nearest(points, targets):
    d2 = ((points[:, None] - targets[None]) ** 2).sum(-1)
    return d2.argmin(axis=1), d2.min(axis=1)


def test_f12_a_misfit_is_one_sum_without_a_join(spark, monkeypatch):
    from terralith.operators import forward
    from terralith.plans import optimise

    plans, made = [], forward.gravity

    def gravity(*args, **kw):
        out = made(*args, **kw)
        plans.append((kw.get("keep"), out.columns, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(optimise.fw, "gravity", gravity)
    got = optimise.depth_inversion(spark, SF).collect()
    assert all(keep for keep, _, _ in plans) and not any("Join" in p for _, _, p in plans[1:])
    assert got[-1].objective < got[0].objective and abs(got[0].shift) < 0.3


def test_f12_columns_kept_beside_the_response_are_the_observations_own(spark, monkeypatch):
    from terralith.operators import forward as fw

    obs = spark.createDataFrame([(i, i * 10.0, i * 7.0, 0.0, i * 1.5) for i in range(20)], "obs_id long, x double, y double, z double, value double")
    boxes = spark.createDataFrame([(g, 50.0 * g, 20.0, -200.0, 30.0, 2.5) for g in range(3)], "group_id int, cx double, cy double, cz double, half double, density double")
    plain = {(r.obs_id, r.group_id): r.response for r in fw.gravity(obs, fw.box_facets(boxes), ["group_id"]).collect()}
    for block in (fw.BROADCAST_FACETS, 4):
        monkeypatch.setattr(fw, "BROADCAST_FACETS", block)
        rows = fw.gravity(obs, fw.box_facets(boxes), ["group_id"], keep=["value", "x"]).collect()
        assert len(rows) == 60 and all(r.value == r.obs_id * 1.5 and r.x == r.obs_id * 10.0 for r in rows)
        assert all(abs(r.response - plain[r.obs_id, r.group_id]) <= 1e-12 for r in rows)


def test_f13_points_on_targets_are_not_searched(spark, monkeypatch):
    from terralith.operators import locate

    rng = np.random.default_rng(5)
    targets = np.unique(rng.integers(0, 60, (900, 2)), axis=0).astype(float)
    points = np.vstack([targets[::2], rng.uniform(-9, 70, (40, 2)), targets[:5]])
    frame = lambda a, n: spark.createDataFrame(pd.DataFrame({n: np.arange(len(a)), "x": a[:, 0], "y": a[:, 1]}))
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 16)
    monkeypatch.setattr(locate, "PLACES", 1)
    searched, tree = [], locate.descend
    monkeypatch.setattr(locate, "descend", lambda places, *a: searched.append(places.count()) or tree(places, *a))
    want, d2 = _nearest(points, targets)
    got = {r.obs_id: r for r in locate.nearest(frame(points, "obs_id"), frame(targets, "target_id"), 1, "xy").collect()}
    assert searched == [40] and len(got) == len(points)
    assert all(got[i].target_id == want[i] and abs(got[i].d2 - d2[i]) < 1e-9 and got[i].rank == 1 for i in range(len(points)))
    on = frame(targets[:50], "obs_id")
    assert sorted(r.target_id for r in locate.nearest(on, frame(targets, "target_id"), 1, "xy").collect()) == list(range(50)) and searched == [40]


def test_f13_f22_items_that_no_place_keeps_leave_the_tree(spark, monkeypatch):
    from terralith.operators import locate

    rng = np.random.default_rng(6)
    targets, points = rng.uniform(0, 1000, (3000, 2)), rng.uniform(0, 30, (20, 2))
    frame = lambda a, n: spark.createDataFrame(pd.DataFrame({n: np.arange(len(a)), "x": a[:, 0], "y": a[:, 1]}))
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 16)
    monkeypatch.setattr(locate, "PLACES", 1)
    sizes, store = [], locate.stored_at

    def stored_at(df):
        out = store(df)
        if {"target_id", "ux"} <= set(df.columns):
            sizes.append(out[0].count())
        return out

    monkeypatch.setattr(locate, "stored_at", stored_at)
    want, _ = _nearest(points, targets)
    got = {r.obs_id: r.target_id for r in locate.nearest(frame(points, "obs_id"), frame(targets, "target_id"), 1, "xy").collect()}
    assert got == dict(enumerate(want)) and sizes[0] < 1000


def _surfaces_by_hand(cells):
    """Vertices and triangles of (group, x, y, z) cells, straight from the table of triangles."""
    from terralith.operators import isosurface as iso

    table = {}
    for mask, number, *ends in iso.triangles_by_mask():
        table.setdefault(mask, []).append(ends)
    faces, corners = [], iso._CORNERS
    for g in sorted({c[0] for c in cells}):
        own = {c[1:] for c in cells if c[0] == g}
        for c in sorted({tuple(p - s for p, s in zip(o, k)) for o in own for k in corners}):
            mask = sum(1 << i for i, k in enumerate(corners) if tuple(a + s for a, s in zip(c, k)) in own)
            place = lambda a, b: (g, *[2 * x + i + j for x, i, j in zip(c, corners[a], corners[b])])  # noqa: E731, B023
            faces += [(g, place(*e[:2]), place(*e[4:]), place(*e[2:4])) for e in table.get(mask, [])]
    ids = {p: i for i, p in enumerate(sorted({p for f in faces for p in f[1:]}))}
    return {(i, p[0], *[x / 2 + 0.5 for x in p[1:3]], -p[3] / 2 - 0.5) for p, i in ids.items()}, [(i, f[0], *[ids[p] for p in f[1:]]) for i, f in enumerate(faces)]


def test_f14_f21_surfaces_of_blocks_are_those_of_the_whole(spark):
    from terralith.operators import isosurface as iso

    rng = np.random.default_rng(8)
    cells = {(int(g), int(x), int(y), int(z)) for g, x, y, z in zip(rng.integers(0, 3, 900), rng.integers(-3, 19, 900), rng.integers(13, 19, 900), rng.integers(60, 68, 900))}
    cells |= {(1, 15, 15, 63), (1, 16, 16, 64), (2, -17, -33, -129), (2, -16, -32, -128)}
    rows = spark.createDataFrame([*cells, *list(cells)[:20], (1, None, 3, 3)], "label int, ix int, iy int, iz int")
    vertices, triangles = iso.surfaces(rows)
    for df in (vertices, triangles):  # nothing of a vertex or triangle is shuffled: only blocks are dealt
        assert "Join" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Sort" not in plan
    want_v, want_t = _surfaces_by_hand(cells)
    assert {(r.v_id, r.label, r.x, r.y, r.z) for r in vertices.collect()} == want_v and vertices.count() == len(want_v)
    assert sorted((r.t_id, r.label, r.v0, r.v1, r.v2) for r in triangles.collect()) == want_t
    assert iso.open_edges(triangles).count() == 0
    assert {r.label: r.n_open_edges for r in iso.open_edges(triangles.filter("t_id <> 0")).collect()} == {0: 3}


def test_f16_no_task_numbers_all_lines_of_a_file(spark):
    from terralith.plans import formats
    from terralith.sources import text

    rows = [(p, n, s) for p in ("a", "b") for n, s in enumerate(["GOCAD TSurf 1", "VRTX 5 0 0 0", "PVRTX 7 1 0 0", "VRTX 6 0 1 0", None, "TRGL 5 7 6", "END", "VRTX 9 1 1 1", "END", "TRGL 5 6 7"], 1)] + [("c", 1, "VRTX 1 0 0 0")]
    v, t = text.tsurf(spark.createDataFrame(rows, "path string, line_no int, line string"))
    assert sorted((r.path, r.v_id, r.x, r.y) for r in v.collect()) == sorted([*[(p, *r) for p in "ab" for r in ((0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0))], ("c", 0, 0.0, 0.0)])
    assert sorted(t.collect()) == [("a", 0, 0, 1, 2), ("b", 0, 0, 1, 2)]
    plan = formats.tsurf_round_trip(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "[path" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_f22_points_of_one_place_are_one(spark, monkeypatch):
    from terralith.operators import control as ct

    monkeypatch.setattr(ct, "FEW_FACETS", 0)
    seen, tree = [], ct.descend
    monkeypatch.setattr(ct, "descend", lambda places, *a: seen.append(places.count()) or tree(places, *a))
    facets = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 9.0, 9.0, 0.0)], "t_id int, " + ", ".join(f"{c}{a} double" for c in "pqr" for a in "xyz"))
    rows = [(i, 20.0 + i % 2, 0.0, 3.0 if i % 2 else -3.0) for i in range(40)] + [(40, 5.0, 1.0, 2.0), (41, 5.0, 1.0, 2.0)]
    got = {r.obs_id: r.side for r in ct.side(spark.createDataFrame(rows, "obs_id int, x double, y double, z double"), facets).collect()}
    assert got == {**{i: 1 if i % 2 else -1 for i in range(40)}, 40: 1, 41: 1} and seen == [2]
