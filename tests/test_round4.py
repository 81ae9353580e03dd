"""Findings of round 4: whole results by ways whose cost follows the input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith.operators import faraway
from terralith.operators import forward as fw
from terralith.operators import inversion
from terralith.operators.meshfield import MeshField


def test_f1_a_meshed_field_takes_more_stations_than_a_tile(spark):
    tetra = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]
    at = np.array([(0.0, 0.0, -300.0), (300.0, 0.0, -300.0), (100.0, 250.0, -300.0), (120.0, 90.0, -80.0)])
    vertices = spark.createDataFrame([(0, i, *map(float, p), "XYZ_FREE") for i, p in enumerate(at)], "mesh_id int, v_id long, x double, y double, z double, freedom string")
    triangles = spark.createDataFrame([(0, t, *v) for t, v in enumerate(tetra)], "mesh_id int, t_id long, v0 long, v1 long, v2 long")
    o = np.c_[np.random.default_rng(1).uniform(-400, 400, (9000, 2)), np.zeros(9000)]
    field = MeshField.build(vertices, triangles, spark.createDataFrame(pd.DataFrame({"obs_id": np.arange(9000), **dict(zip("xyz", o.T))})))
    corner = at[np.array(tetra)]
    want = fw.summed("gravity", o, corner, None, None, np.full((4, 1), fw.g.G_MGAL))[:, 0]
    assert field.response(field.start, {0: 2.0}) == pytest.approx(2.0 * want)
    assert field.units(field.start).orderBy("obs_id").toPandas()["u"].to_numpy() == pytest.approx(want)
    weights = np.linspace(-1, 1, 9000)
    got = field.pulled_back(field.start, {0: 2.0}, weights)
    for k in (0, 5, 11):
        h = np.zeros(12)
        h[k] = 1e-2
        assert got[k] == pytest.approx(weights @ (field.response(field.start + h, {0: 2.0}) - field.response(field.start - h, {0: 2.0})) / 2e-2, rel=1e-3, abs=1e-5)
    field.release()


def _column(n, top):
    """Stations on a grid of 60 m and cells of layers of 100, the first at depth ``top``."""
    k, j = np.arange(400), np.arange(n)
    o = np.c_[(k % 20 - 9.5) * 60.0, (k // 20 - 9.5) * 60.0, np.zeros(400)]
    c = np.c_[(j % 10 - 4.5) * 200.0, (j // 10 % 10 - 4.5) * 200.0, -top - (j // 100) * 100.0, np.tile([100.0, 100.0, 50.0], (n, 1))]
    return o, c


def test_f2_far_prisms_keep_their_digits():
    o, c = _column(300, 250_000.0)
    places, weights = np.polynomial.legendre.leggauss(9)
    want = np.zeros((len(o), len(c)))
    for x, u in zip(places, weights):
        for y, v in zip(places, weights):
            for z, w in zip(places, weights):
                d = c[None, :, :3] + np.array([x, y, z]) * c[None, :, 3:] - o[:, None]
                want -= u * v * w * d[..., 2] / (d * d).sum(-1) ** 1.5
    want *= fw.g.G_MGAL * 100.0 * 100.0 * 50.0
    np.testing.assert_allclose(inversion.prism_gravity(o, c), want, rtol=1e-12)
    # every number of points, against the corners where these still have digits
    o, c = _column(4000, 100.0)
    np.testing.assert_allclose(inversion.prism_gravity(o, c), inversion._corner_gravity(o, c), rtol=1e-9)


def test_f2_blocks_of_far_cells_are_thin(spark):
    o, c = _column(2000, 20_000.0)
    names = ["cx", "cy", "cz", "hx", "hy", "hz"]
    stations = spark.createDataFrame(pd.DataFrame({"i": np.arange(400), **dict(zip("xyz", o.T))}))
    cells = spark.createDataFrame(pd.DataFrame({"j": np.arange(2000), **dict(zip(names, c.T))}))
    made = inversion.Sensitivity(stations, cells, inversion.prism_gravity, ["x", "y", "z"], names)
    full, rng = inversion.prism_gravity(o, c), np.random.default_rng(4)
    v, w = rng.standard_normal(2000), rng.standard_normal(400)
    assert made.blocks.agg(F.sum(F.length("values"))).first()[0] < full.nbytes / 4
    np.testing.assert_allclose(made.dot(v), full @ v, rtol=0, atol=1e-12 * np.linalg.norm(full) * np.linalg.norm(v))
    np.testing.assert_allclose(made.back(w), w @ full, rtol=0, atol=1e-12 * np.linalg.norm(full) * np.linalg.norm(w))
    made.release()


def test_f2_cells_without_size_are_blocks_of_nothing(spark):
    o, c = _column(50, 500.0)
    c[:, 3:] = 0.0
    names = ["cx", "cy", "cz", "hx", "hy", "hz"]
    stations = spark.createDataFrame(pd.DataFrame({"i": np.arange(400), **dict(zip("xyz", o.T))}))
    made = inversion.Sensitivity(stations, spark.createDataFrame(pd.DataFrame({"j": np.arange(50), **dict(zip(names, c.T))})), lambda a, b: np.zeros((len(a), len(b))), ["x", "y", "z"], names)
    assert made.blocks.agg(F.sum("rank")).first()[0] == 0
    assert made.dot(np.ones(50)).tolist() == [0.0] * 400 and made.back(np.ones(400)).tolist() == [0.0] * 50
    made.release()


def test_f2_a_block_is_thin_only_within_the_bound():
    rng = np.random.default_rng(5)
    assert inversion.thin(rng.standard_normal((200, 200))) is None
    a = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 200))
    left, right = inversion.thin(a)
    assert left.shape == (200, 5) and np.linalg.norm(left @ right - a) <= 1e-13 * np.linalg.norm(a)
    # a part a hundred times the bound stays
    faint = a + 1e-11 * np.linalg.norm(a) * np.eye(200) / np.sqrt(200)
    two = inversion.thin(faint)
    assert two is None or np.linalg.norm(two[0] @ two[1] - faint) <= 1e-13 * np.linalg.norm(faint)
    assert np.linalg.norm(np.matmul(*inversion.thin(np.zeros((100, 100))))) == 0


@pytest.mark.parametrize("top", [0.0, 4000.0])
def test_f3_moments_are_the_far_field(top):
    """Against an accurate sum over the prisms; far away the facets' own formula has lost more digits."""
    rng, j = np.random.default_rng(6), np.arange(1500)
    c = np.c_[(j % 10) * 100.0, (j // 10 % 10) * 100.0, -top - 50 - (j // 100) * 100.0, np.full((1500, 3), 50.0)]
    density = rng.uniform(-1, 1, 1500)
    corner = (c[:, None, None, :3] + 50 * np.array(fw.BOX_TRIANGLES, float)[None]).reshape(-1, 3, 3)
    o = np.c_[rng.uniform(0, 1000, 300), rng.uniform(-200_000, 200_000, 300), np.full(300, 60.0)]
    o[:80, 1] = rng.uniform(0, 1000, 80)
    moments = faraway.Moments.of(corner, np.repeat(density, 12))
    far = moments.far(o)
    assert 100 < far.sum() < 300 and len(moments.q) < len(corner) / 4
    each = np.concatenate([inversion.prism_gravity(o[i : i + 1], c) for i in range(300)]) / fw.g.G_MGAL
    want, size = each @ density, each.sum(axis=1)
    assert np.abs(moments.at(o[far]) - want[far]).max() < 1e-12 * size[far].max()
    both = faraway.near_sums(o, corner, np.repeat(density, 12), fw._all_pairs)
    assert np.abs(both - want).max() < 1e-10 * size.max()


def test_f3_many_facets_far_and_near_are_all_pairs(spark, monkeypatch):
    rng, j = np.random.default_rng(7), np.arange(3000)
    cells = pd.DataFrame({"group_id": j % 2, "cx": (j % 10) * 100.0, "cy": (j // 10 % 10) * 100.0, "cz": -50 - (j // 100) * 100.0, "half": 50.0, "density": rng.uniform(-1, 1, 3000)})
    cells.loc[0, "density"] = np.nan
    at = np.c_[rng.uniform(0, 1000, 400), rng.uniform(-30_000, 30_000, 400), np.full(400, 60.0)]
    at[:100, 1] = rng.uniform(0, 1000, 100)
    at[100] = np.nan
    obs = spark.createDataFrame(pd.DataFrame({"obs_id": [f"s{i}" for i in range(400)], **dict(zip("xyz", at.T))}))
    facets = fw.box_facets(spark.createDataFrame(cells)).withColumn("density", F.nanvl("density", F.lit(None).cast("double")))
    whole = cells.fillna(0.0)
    prisms = np.c_[whole[["cx", "cy", "cz"]].to_numpy(), np.full((3000, 3), 50.0)]
    pull = np.concatenate([inversion.prism_gravity(at[i : i + 1], prisms) for i in range(400)]) * whole["density"].to_numpy()
    asked = []
    monkeypatch.setattr(fw, "_FACET_BLOCK", 2048)
    monkeypatch.setattr(fw, "_OBS_BLOCK", 90)
    monkeypatch.setattr(fw, "BROADCAST_FACETS", 100)
    monkeypatch.setattr(fw.faraway, "gravity", lambda *a, f=faraway.gravity: asked.append(1) or f(*a))
    got = {r.obs_id: r.response for r in fw.gravity(obs, facets).collect()}
    assert asked and len(got) == 400 and got["s100"] is None
    # more ranges than asked for
    kind = type(facets)
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c, f=kind.repartitionByRange: f(self, max(n, 23), *c))
    by = {(r.obs_id, r.b): r.response for r in fw.gravity(obs, facets.withColumnRenamed("group_id", "b"), ["b"]).collect()}
    assert len(by) == 800
    for i in set(range(400)) - {100}:
        assert got[f"s{i}"] == pytest.approx(pull[i].sum(), abs=1e-9)
        assert by[f"s{i}", 1] == pytest.approx(pull[i][1::2].sum(), abs=1e-9)


def test_f3_upright_facets_alone_still_give_every_station_its_row(spark, monkeypatch):
    monkeypatch.setattr(fw, "BROADCAST_FACETS", 2)
    box = fw.box_facets(spark.createDataFrame([(0, 0.0, 0.0, -300.0, 50.0)], "group_id int, cx double, cy double, cz double, half double")).filter("t_id BETWEEN 4 AND 11")
    obs = spark.createDataFrame([(1, 5.0, 5.0, 0.0), (2, 9e5, 5.0, 0.0)], "obs_id int, x double, y double, z double")
    assert sorted((r.obs_id, r.response) for r in fw.gravity(obs, box, density=None).collect()) == [(1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("kind", ["gravity", "tmi", "tmi_ascoded", "angle", "surface"])
def test_f4_pairs_of_one_geometry_are_one(spark, kind, tmp_path):
    k = np.arange(4000)
    at = np.c_[(k % 40) * 100.0, (k // 40) * 100.0, np.zeros(4000)]
    at[7] = np.nan
    obs = spark.createDataFrame(pd.DataFrame({"obs_id": k, **dict(zip("xyz", at.T))}))
    boxes = spark.createDataFrame([(n, n * 200.0, (n % 5) * 300.0, -300.0, 50.0) for n in range(10)] + [(10, 41.7, 80.3, -200.0, 33.3)], "group_id int, cx double, cy double, cz double, half double")
    facets = fw.box_facets(boxes).withColumns({"m_x": F.lit(0.3), "m_y": F.lit(0.2), "m_z": F.lit(-0.93)})
    f = (0.4, 0.1, -0.9) if kind.startswith("tmi") else None
    got = fw.facet_gradient(obs, facets, 1e-3, kind, f)
    got.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.select("obs_id", "group_id", "t_id").distinct().count() == 4000 * 132
    assert rows.filter("obs_id = 7 AND d_px IS NULL").count() == 132 and rows.filter("obs_id <> 7 AND d_px IS NULL").isEmpty()
    some = rows.filter("obs_id IN (0, 1, 45, 2777)").orderBy("obs_id", "group_id", "t_id").toPandas()
    held = facets.orderBy("group_id", "t_id").toPandas()
    corner = held[fw.CORNERS].to_numpy(float).reshape(-1, 3, 3)
    m = [held[f"m_{a}"].to_numpy(float)[None] for a in "xyz"]
    term = lambda c: fw.pair_terms(kind, [x[:, None] for x in at[[0, 1, 45, 2777]].T], [[c[None, :, i, a] for a in range(3)] for i in range(3)], m, f)
    base = term(corner)
    for j, name in enumerate(fw.CORNERS):
        moved = corner.copy()
        moved[:, j // 3, j % 3] += 1e-3
        np.testing.assert_allclose(some[f"d_{name}"].to_numpy(), ((term(moved) - base) / 1e-3).reshape(-1), rtol=1e-6, atol=1e-6 if kind in ("surface", "gravity") else 1e-9)
    # nine numbers a row; of those seen the same way from several stations of a task, fewer are written
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 0.7 * 4000 * 132 * 72
    order, which, first = fw._by_geometry(at[200:3200], corner[:120, 0], np.arange(120) % 12, 12)
    assert len(order) == len(which) == 3000 * 120 and len(first) < len(order) / 4


def test_f4_geometries_beyond_64_bits_and_none(spark):
    rng = np.random.default_rng(8)
    o, place = rng.uniform(-1e6, 1e6, (1500, 3)), rng.uniform(-1e6, 1e6, (1500, 3))
    order, which, first = fw._by_geometry(o, place, np.arange(1500), 1500)
    assert len(first) == 1500**2 and (np.sort(order) == np.arange(1500**2)).all() and (order[np.argsort(which)] == first).all()
    empty = spark.createDataFrame([], "group_id int, t_id int, " + ", ".join(f"{c} double" for c in fw.CORNERS))
    assert fw.facet_gradient(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "obs_id int, x double, y double, z double"), empty).count() == 0
