"""Analytic and metamorphic checks of the field kernels and solvers."""

from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators import clustering, forward, graph, inversion, locate, mesh, model, sampling, voxel
from terralith.sources import text as t


def box(spark, z=-100.0, half=10.0, density=1.0, susceptibility=0.01):
    return forward.box_facets(spark.createDataFrame([(1, 0.0, 0.0, z, half, density, susceptibility)], "group_id int, cx double, cy double, cz double, half double, density double, susceptibility double"))


def obs(spark, *points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "obs_id int, x double, y double, z double")


def test_far_box_is_a_point_mass(spark):
    points = [(0, 0, 200), (300, 100, 50), (-400, 10, 0)]
    got = {r.obs_id: r.response for r in forward.gravity(obs(spark, *points), box(spark)).collect()}
    for i, (x, y, z) in enumerate(points):
        dz = z + 100
        want = g.G_MGAL * 20.0**3 * dz / (x * x + y * y + dz * dz) ** 1.5
        assert got[i] == pytest.approx(want, rel=2e-3)


def test_far_box_is_a_dipole(spark):
    inc, dec, field = -66.0, 5.0, 58000.0
    points = [(400, 0, 0), (0, 500, 100), (-300, 300, 200)]
    rows = {r.obs_id: r.response for r in forward.total_field(obs(spark, *points), box(spark), inc, dec, field).collect()}
    i, d = np.radians(inc), np.radians(dec)
    f = np.array([np.cos(i) * np.cos(d), np.cos(i) * np.sin(d), -np.sin(i)])
    moment = 0.01 * field / 100.0 * 20.0**3
    for k, p in enumerate(points):
        r = np.array(p, float) - np.array([0, 0, -100.0])
        n = np.linalg.norm(r)
        want = 100.0 / (4 * pi) * moment * (3 * (f @ r) ** 2 / n**2 - f @ f) / n**3
        assert rows[k] == pytest.approx(want, rel=1e-2)


def test_solid_angles_and_superposition(spark):
    o = obs(spark, (0, 0, -100), (0, 0, 0), (3, 2, -95))
    got = {r.obs_id: r.response for r in forward.solid_angles(o, box(spark)).collect()}
    assert abs(got[0]) == pytest.approx(4 * pi) and got[1] == pytest.approx(0, abs=1e-9) and abs(got[2]) == pytest.approx(4 * pi)
    one, two = box(spark), box(spark, z=-150.0)
    single = {r.obs_id: r.response for r in forward.gravity(o, one.unionByName(two)).collect()}
    parts = [{r.obs_id: r.response for r in forward.gravity(o, x).collect()} for x in (one, two)]
    assert all(single[k] == pytest.approx(parts[0][k] + parts[1][k]) for k in (1,))
    blocked = {r.obs_id: r.n for r in forward.pairs(o, one, block=5).groupBy("obs_id").agg(F.count("*").alias("n")).collect()}
    assert set(blocked.values()) == {12}
    assert forward.mesh_volume(one, ["group_id"]).first().volume == pytest.approx(8000.0)


def test_singular_places_are_finite(spark):
    o = obs(spark, (10, 10, -90), (0, 0, -90), (10, 0, -100))
    rows = forward.gravity(o, box(spark)).collect()
    assert all(np.isfinite(r.response) for r in rows)
    grads = forward.facet_gradient(obs(spark, (0, 0, 0)), box(spark)).collect()
    assert len(grads) == 12 and all(np.isfinite(r.d_px) for r in grads)


def test_bounded_solvers():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((40, 5))
    a, x = u.T @ u, np.array([0.1, 0.9, 0.5, 0.3, 0.7])
    lo, hi = np.zeros(5), np.ones(5)
    assert np.allclose(inversion.bounded_least_squares(a, a @ x, np.full(5, 0.5), lo, hi), x, atol=1e-6)
    value, grad = lambda p: 0.5 * (p - x) @ a @ (p - x), lambda p: a @ (p - x)
    assert np.allclose(inversion.Bounded(value, grad, lo, hi, rounds=100).minimise(np.full(5, 0.5)), x, atol=1e-4)
    assert np.allclose(inversion.newton_cg(value, grad, np.full(5, 0.5), lo, hi), x, atol=1e-4)
    tight = inversion.Bounded(value, grad, lo, np.full(5, 0.6), rounds=100).minimise(np.full(5, 0.5))
    assert tight.max() <= 0.6
    assert inversion.largest_eigenvalue(a) == pytest.approx(np.linalg.eigvalsh(a).max(), rel=1e-4)


def test_mixture_finds_two_blobs(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.1, 300), rng.normal(5, 0.1, 100)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "cell_id int, density double")
    out = {r.label: r.n for r in clustering.mixture_labels(df, ["density"], 2).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert out == {1: 300, 2: 100}


def test_voxel_cleanup_and_components(spark):
    cells = [(x + 10 * y, x, y, 0, 1 if x < 5 else 2) for x in range(10) for y in range(10)]
    cells = [(c, x, y, z, 3 if (x, y) == (2, 2) else lab) for c, x, y, z, lab in cells]
    df = spark.createDataFrame(cells, "cell_id int, ix int, iy int, iz int, label int")
    clean = voxel.clean_fragments(df, 3)
    assert {r.label: r.n for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 50, 2: 50}
    assert voxel.cell_components(df).select("root").distinct().count() == 3


def test_long_chain_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    nodes = spark.range(n + 2).withColumnRenamed("id", "node")
    assert {r.root for r in graph.components(nodes, edges).collect()} == {0, n + 1}


def test_loops_order_and_sampling(spark):
    tri = mesh.grid_triangles(spark.range(16).select(F.col("id").alias("v_id")), 4).withColumn("mesh_id", F.lit(7))
    loop = model.boundary_loops(mesh.boundary_edges(tri, ["mesh_id"])).orderBy("ord").collect()
    assert len(loop) == 12 and len({r.loop for r in loop}) == 1 and loop[0].v_id == 0
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, 2.4, 0.0, 0.0)], "p_id long, x double, y double, z double")
    assert [r.p_id for r in sampling.farthest_points(pts, 3).orderBy("ord").collect()] == [0, 2, 3]
    s = spark.createDataFrame([(0, 1, 0.0, 0.0, -10.0), (1, 1, 0.0, 0.0, -9.0)], "surface_id int, v_id long, x double, y double, z double")
    z = {r.surface_id: r.z for r in model.enforce_order(s, [0, 1], 2.0).collect()}
    assert z[0] - z[1] >= 2.0


def test_nearest_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(50)], "obs_id int, x double, y double")
    b = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(2500)], "target_id int, x double, y double")
    one = sorted(map(tuple, locate.nearest(a, b, 3, "xy").collect()))
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 10)
    assert sorted(map(tuple, locate.nearest(a, b, 3, "xy").collect())) == one and len(one) == 150


def test_readers(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nf 1 2 3\n")
    v, tri = t.load_mesh(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and tri.first()["v2"] == 2
    (tmp_path / "l.bin").write_bytes(b"2 1 1\n" + np.array([4, 5], "<i4").tobytes())
    assert [(r.ix, r.label) for r in t.label_grid(spark, str(tmp_path / "l.bin")).orderBy("ix").collect()] == [(0, 4), (1, 5)]
    ts = "GOCAD TSurf 1\nTFACE\nVRTX 5 0 0 0\nPVRTX 7 1 0 0\nVRTX 9 0 1 0\nTRGL 5 7 9\nEND\nTRGL 9 9 9\n"
    lines = t.number_lines(spark.createDataFrame([("a.ts", ts)], "path string, text string"))
    assert [tuple(r)[2:] for r in t.tsurf(lines)[1].collect()] == [(0, 1, 2)]
    with pytest.raises(ValueError):
        t.gates(t.number_lines(spark.createDataFrame([("g", "cluster_name,x\n")], "path string, text string")))
    mesh_text = "2 3 4\n0 0 100\n2*50\n3*25\n4*10\n"
    r = t.tensor_mesh(t.number_lines(spark.createDataFrame([("m", mesh_text)], "path string, text string"))).first()
    assert (r.nx, r.z0, r.dx, r.dz) == (2, 100.0, 50.0, 10.0)


def _facets(spark, corners):
    from terralith.operators.forward import CORNERS

    return spark.createDataFrame([(i, *map(float, np.ravel(c))) for i, c in enumerate(corners)], "t_id int, " + ", ".join(f"{c} double" for c in CORNERS))


def test_cells_join_like_a_nested_loop(spark):
    from terralith.operators.cells import with_boxes

    rng = np.random.default_rng(3)
    pts = [(i, *map(float, rng.uniform(-50, 50, 2))) for i in range(400)] + [(400, 0.0, 0.0), (401, 8.0, -8.0)]
    lows, sizes = rng.uniform(-60, 50, (300, 2)), 2.0 ** rng.integers(-4, 6, (300, 2))
    boxes = [(i, *map(float, (a[0], a[0] + s[0], a[1], a[1] + s[1]))) for i, (a, s) in enumerate(zip(lows, sizes))]
    boxes += [(300, 0.0, 0.0, 0.0, 0.0), (301, 0.0, 8.0, -8.0, 0.0), (302, None, 1.0, 0.0, 1.0), (303, float("nan"), 1.0, 0.0, 1.0)]
    p = spark.createDataFrame(pts, "p long, x double, y double")
    b = spark.createDataFrame(boxes, "b long, lx double, hx double, ly double, hy double")
    got = with_boxes(p, [p["x"], p["y"]], b, [(b["lx"], b["hx"]), (b["ly"], b["hy"])]).select("p", "b").collect()
    want = {(q[0], c[0]) for q in pts for c in boxes[:302] if c[1] <= q[1] <= c[2] and c[3] <= q[2] <= c[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = with_boxes(p, [p["x"], p["y"]], b.filter("b > 999"), [(b["lx"], b["hx"]), (b["ly"], b["hy"])])
    assert none.count() == 0


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_cells_is_exact(spark, monkeypatch, k):
    from pyspark.sql import functions as F

    from terralith.operators import locate

    rng = np.random.default_rng(5)
    targets = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(500, 3, (100, 2)), np.repeat([[10.0, 10.0]], 5, 0)])
    points = np.concatenate([rng.uniform(-20, 600, (200, 2)), targets[:20], [[-5000.0, 7000.0]]])
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(targets)], "target_id long, x double, y double")
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "obs_id long, x double, y double")
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 10)
    got = {}
    for r in locate.nearest(p, t, k, "xy").collect():
        got.setdefault(r.obs_id, []).append((r["rank"], r.target_id))
    for i, q in enumerate(points):
        d2 = (targets[:, 0] - q[0]) ** 2 + (targets[:, 1] - q[1]) ** 2
        want = sorted(range(len(targets)), key=lambda j: (d2[j], j))[:k]
        assert [j for _, j in sorted(got[i])] == want
    assert locate.nearest(p, t.filter(F.col("target_id") < 0), k, "xy").count() == 0


def test_side_of_the_nearest_triangle(spark):
    from terralith.operators.control import side

    rng = np.random.default_rng(9)
    tri = [[(0, 0, 0), (10, 0, 2), (0, 10, 1)], [(10, 0, 2), (10, 10, 5), (0, 10, 1)], [(20, 0, 0), (20, 5, 0), (20, 0, 5)]]
    points = rng.uniform(-15, 30, (200, 3))
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)], "obs_id long, x double, y double, z double")
    got = {r.obs_id: r.side for r in side(df, _facets(spark, tri)).collect()}

    def sign(q):
        best = None
        for c in tri:
            a, b, d = (np.array(v, float) for v in c)
            n = np.cross(b - a, d - a)
            n /= np.linalg.norm(n)
            flat = np.array([[b[0] - a[0], d[0] - a[0]], [b[1] - a[1], d[1] - a[1]]])
            if abs(np.linalg.det(flat)) > 1e-30:
                u, v = np.linalg.solve(flat, q[:2] - a[:2])
                if u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9:
                    return int(np.sign((q - a) @ n))
        for c in tri:
            a, b, d = (np.array(v, float) for v in c)
            n = np.cross(b - a, d - a)
            n /= np.linalg.norm(n)
            (u, v), *_ = np.linalg.lstsq(np.stack([b - a, d - a], 1), q - a, rcond=None)
            u, v = max(u, 0), max(v, 0)
            u, v = (u, v) if u + v <= 1 else (u / (u + v), v / (u + v))
            foot = a + u * (b - a) + v * (d - a)
            far = float((q - foot) @ (q - foot))
            if best is None or far < best[0] - 1e-12:
                best = (far, int(np.sign((q - foot) @ n)) if abs((q - foot) @ n) > 1e-9 else 0)
        return best[1]

    assert all(got[i] == sign(q) for i, q in enumerate(points))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i + 1} {'x' * (i % 40)}\r\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = t.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5003
    for r in rows:
        name, i = r.line.split()[:2]
        assert r.path.endswith(name) and r.line_no == int(i)


def test_label_grid_round_trip(spark, tmp_path):
    from terralith.sources import write as w

    rng = np.random.default_rng(2)
    want = rng.integers(0, 9, (4, 3, 5)).astype("<i4")  # z, y, x
    cells = spark.createDataFrame([(x, y, z, int(want[z, y, x])) for z in range(4) for y in range(3) for x in range(5) if (x, y, z) != (2, 1, 3)], "ix int, iy int, iz int, label int")
    want[3, 1, 2] = -1
    w.write_label_grid(cells, (5, 3, 4), str(tmp_path / "g.bin"))
    assert (tmp_path / "g.bin").read_bytes() == b"5 3 4\n" + want.tobytes()


def test_magnetic_gradient_sums_to_a_shift(spark):
    """Moving all corners of a body by dz changes the field like moving the station by -dz."""
    m = (0.2, -0.3, -0.9)
    facets = box(spark).withColumns({f"m_{a}": F.lit(v) for a, v in zip("xyz", m)})
    rows = forward.facet_gradient(obs(spark, (15, 5, 0)), facets, 1e-3, "tmi", m).agg(F.sum(F.col("d_pz") + F.col("d_qz") + F.col("d_rz")).alias("s")).first()
    at = lambda z: forward.forward(obs(spark, (15, 5, z)), facets, "tmi", F.lit(1.0), field=m).first().response
    assert rows.s == pytest.approx(-(at(0.01) - at(-0.01)) / 0.02, rel=2e-3)


def test_kernels_by_name(spark):
    forward.register_kernel("test_height", lambda: F.col("h"))
    both = forward.facet_parts(forward.pairs(obs(spark, (0, 0, 0)), box(spark))).agg(F.sum("h").alias("s")).first().s
    assert forward.forward(obs(spark, (0, 0, 0)), box(spark), "test_height", F.lit(1.0)).first().response == pytest.approx(both)
    for wrong in ("gravity", "tmi"):
        with pytest.raises(ValueError):
            forward.register_kernel(wrong, lambda: F.lit(0.0))
    with pytest.raises(ValueError):
        forward.forward(obs(spark, (0, 0, 0)), box(spark), "nothing", F.lit(1.0))


def test_steps_at_an_active_bound_go_downhill():
    """The projected step of this direction climbs at full length; it must be halved or refused."""
    opt = inversion.Bounded(lambda x: float(x[0] + 10 * x[1]), lambda x: np.array([1.0, 10.0]), np.array([0.0, 0.0]), np.array([1.0, 1.0]))
    x, g_ = np.array([0.0, 0.5]), np.array([1.0, 10.0])
    length, new, got = opt.step(x, 5.0, g_, np.array([-100.0, 0.5]))
    assert length == 0.0 and got == 5.0 and (new == x).all()
    down = opt.minimise(np.array([0.9, 0.9]))
    assert np.allclose(down, 0)


def test_alternating_loop_halves_and_reverts():
    from terralith.operators.runs import Alternating

    loop = Alternating(lambda p, q, n: (p + 8.0, 1, False), lambda p: p[0] <= 2.5, None, most=3, interval=1, retries=5)
    p, _ = loop.run(np.array([0.0]), {})
    assert p[0] == pytest.approx(2.5) and [r["halved"] for r in loop.log[:2]] == [2, 4]
    stuck = Alternating(lambda p, q, n: (p + 1000.0, 1, False), lambda p: p[0] <= 0, None, most=2)
    p, _ = stuck.run(np.array([0.0]), {})
    assert p[0] == 0 and not any(r["accepted"] for r in stuck.log) and len(stuck.log) == 6
    only = Alternating(None, lambda p: True, lambda p, q: {1: 2.0}, most=5)
    assert only.run(np.array([0.0]), {1: 0.0})[1] == {1: 2.0} and len(only.log) == 1


def test_property_solves_fit_their_data(spark):
    from terralith.operators import runs

    b = spark.createDataFrame([(1, -200.0, 0.0, -150.0, 80.0), (2, 200.0, 50.0, -250.0, 80.0)], "group_id int, cx double, cy double, cz double, half double")
    stations = runs.observation_grid(spark, 6, 500.0, 200.0)
    units = runs.unit_magnetics(stations, forward.box_facets(b), -60.0, 10.0, 50000.0, "fixed_vector")
    truth = {(1, "chi"): 0.03, (1, "m"): 0.0, (2, "chi"): 0.01, (2, "m"): 0.0}
    rows = spark.createDataFrame([(g, p, v) for (g, p), v in truth.items()], "group_id int, part string, v double")
    data = units.join(rows, ["group_id", "part"]).groupBy("obs_id").agg(F.sum(F.col("u") * F.col("v")).alias("value")).withColumn("std", F.lit(1.0))
    found = runs.solve_properties(units, data, {"chi": 0.02, "m": 0.0}, {"chi": 0.0, "m": -5.0}, {"chi": 1.0, "m": 5.0}, damping=1e-6)
    got = spark.createDataFrame([(g, p, v) for (g, p), v in found.items()], "group_id int, part string, v double")
    fit = units.join(got, ["group_id", "part"]).groupBy("obs_id").agg(F.sum(F.col("u") * F.col("v")).alias("p")).join(data, "obs_id")
    worst, top = fit.agg(F.max(F.abs(F.col("p") - F.col("value"))), F.max(F.abs("value"))).first()
    assert worst < 0.01 * top
    assert all(0 <= v <= 1 for (_, p), v in found.items() if p == "chi")


def test_nearest_cluster_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(60)], "cell_id int, density double, susceptibility double")
    c = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(40)] + [(40, 0.0, 0.0)], "cluster_id int, density double, susceptibility double")
    one = [sorted(map(tuple, clustering.nearest_cluster(rows, c, ["cell_id"], w).collect())) for w in (None, 2.0)]
    monkeypatch.setattr(clustering, "BROADCAST_CLUSTERS", 9)
    assert [sorted(map(tuple, clustering.nearest_cluster(rows, c, ["cell_id"], w).collect())) for w in (None, 2.0)] == one


def test_surface_of_a_ball_is_closed(spark):
    from terralith.operators import isosurface as iso

    r = 6
    ball = [(7, x, y, z) for x in range(-r, r + 1) for y in range(-r, r + 1) for z in range(-r, r + 1) if x * x + y * y + z * z <= r * r]
    cells = spark.createDataFrame([*ball, ball[0], (8, 40, 0, 0)], "label int, ix int, iy int, iz int")
    v, t = iso.surfaces(cells, (10.0, 20.0, 30.0), (2.0, 2.0, 2.0))
    at = {q.v_id: np.array([q.x, q.y, q.z]) for q in v.collect()}
    faces = {k: [(q.v0, q.v1, q.v2) for q in t.collect() if q.label == k] for k in (7, 8)}
    for k, cells_of in ((7, len(ball)), (8, 1)):
        directed = [(f[i], f[(i + 1) % 3]) for f in faces[k] for i in range(3)]
        assert len(set(directed)) == len(directed) and all((b, a) in set(directed) for a, b in directed)
        used = {i for f in faces[k] for i in f}
        assert len(used) - len(directed) // 2 + len(faces[k]) == 2
        volume = sum(at[a] @ np.cross(at[b], at[c]) for a, b, c in faces[k]) / 6
        assert 0.3 * 8 * cells_of < volume < 1.1 * 8 * cells_of
    single = np.array([at[i] for f in faces[8] for i in f])
    assert np.allclose(single.mean(0), [10 + 81, 21, 29], atol=0.2)
    lines = iso.surface_lines(v, t, spark.createDataFrame([(7, 2.5, 0.01), (8, 2.7, 0.02)], "label int, density double, susceptibility double")).filter("label = 8").orderBy("part", "ord").collect()
    assert lines[0].line == "# Lithology group 8" and lines[1].line == "# density_mean=2.700000 g/cc  susc_mean=0.020000 SI"
    assert lines[2].line == f"# vertices=14 faces={len(faces[8])}" and lines[3].line.startswith("v ") and lines[17].line.startswith("f ")
    assert {int(i) for q in lines if q.line.startswith("f ") for i in q.line.split()[1:]} == set(range(1, 15))


def test_autocorrelation_over_ranges(spark, monkeypatch):
    from terralith.operators import residual

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.normal())) for i in range(300)], "obs_id long, x double, y double, r double")
    one = residual.durbin_watson(rows).first()
    monkeypatch.setattr(residual, "WINDOW_ROWS", 10)
    two = residual.durbin_watson(rows).first()
    assert two.n == one.n == 300 and two.dw_x == pytest.approx(one.dw_x) and two.dw_y == pytest.approx(one.dw_y)
