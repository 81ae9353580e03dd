"""Nearest neighbours by descent, chains by doubling, sides of surfaces: against brute force."""

import numpy as np
import pandas as pd
import pytest

from terralith.operators import locate


@pytest.mark.parametrize(("dims", "k"), [("xy", 1), ("xy", 3), ("xyz", 4), ("x", 2)])
def test_tree_descent_equals_brute_force(spark, monkeypatch, dims, k):
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 50)
    rng = np.random.default_rng(k)
    t, q = rng.uniform(0, 100, (900, 3)), rng.uniform(-20, 120, (150, 3))
    t[:400] = [50, 50, 5]  # one place
    t[400:600] = 30 + rng.standard_normal((200, 3)) * 1e-4  # one small heap
    t[600:700] = np.round(t[600:700], -1)  # ties
    q[:40], q[40:80] = [10, 10, 10], 30 + rng.standard_normal((40, 3)) * 1e-3
    q[80:90] = t[600:610]
    targets = spark.createDataFrame(pd.DataFrame({"target_id": np.arange(900), "x": t[:, 0], "y": t[:, 1], "z": t[:, 2]}))
    points = spark.createDataFrame(pd.DataFrame({"obs_id": np.arange(150), "x": q[:, 0], "y": q[:, 1], "z": q[:, 2]}))
    got: dict[int, list] = {}
    for r in locate.nearest(points, targets, k, dims).orderBy("obs_id", "rank").collect():
        got.setdefault(r.obs_id, []).append(r.target_id)
    d = len(dims)
    for i in range(150):
        far = ((t[:, :d] - q[i, :d]) ** 2).sum(1)
        assert got[i] == np.lexsort((np.arange(900), far))[:k].tolist()


def test_fewer_targets_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(locate, "BROADCAST_POINTS", 1)
    targets = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "target_id long, x double, y double, z double")
    points = spark.createDataFrame([(7, 4.0, 0.0, 0.0), (8, None, 1.0, 1.0)], "obs_id long, x double, y double, z double")
    assert [(r.obs_id, r.target_id, r.rank) for r in locate.nearest(points, targets, 4).orderBy("rank").collect()] == [(7, 2, 1), (7, 1, 2)]
    assert locate.nearest(points, targets.filter("x is null").union(targets.filter("x is null")), 1).count() == 0


def test_side_through_the_tree_is_the_side_of_all_triangles(spark, monkeypatch):
    from terralith.operators import control

    rng = np.random.default_rng(4)
    base = rng.uniform(0, 100, (300, 3))
    corners = base[:, None, :] + rng.uniform(-6, 6, (300, 3, 3))
    names = [f"{c}{a}" for c in "pqr" for a in "xyz"]
    facets = spark.createDataFrame(pd.DataFrame(corners.reshape(300, 9), columns=names).assign(t_id=np.arange(300)))
    q = rng.uniform(-40, 140, (200, 3))
    points = spark.createDataFrame(pd.DataFrame({"obs_id": np.arange(200), "x": q[:, 0], "y": q[:, 1], "z": q[:, 2]}))
    want = sorted(map(tuple, control.side(points, facets).collect()))
    monkeypatch.setattr(control, "FEW_FACETS", 5)
    assert sorted(map(tuple, control.side(points, facets).collect())) == want


def test_chains_of_loops_and_open_ends(spark):
    from terralith.operators import graph, model

    rng = np.random.default_rng(5)
    names = rng.permutation(1000)
    loop, other, path = names[:137].tolist(), names[137:141].tolist(), names[141:190].tolist()
    rows = [(1, a, b) for x in (loop, other) for a, b in zip(x, x[1:] + x[:1])] + [(1, a, b) for a, b in zip(path, path[1:])] + [(2, 5, 6), (2, 6, 5)]
    df = spark.createDataFrame(rows, "mesh_id int, a long, b long")
    got = graph.chains(df, ["mesh_id"]).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.mesh_id, r.chain), []).append((r.ord, r.a, r.b, r.size, r.closed))
    found = {tuple(a for _, a, *_ in sorted(v)): (v[0][3], v[0][4]) for v in by.values()}
    turned = lambda x: tuple(x[x.index(min(x)) :] + x[: x.index(min(x))])
    assert found == {turned(loop): (137, True), turned(other): (4, True), tuple(path[:-1]): (48, False), (5, 6): (2, True)}
    numbers = {(r.mesh_id, r.loop): r.v_id for r in model.boundary_loops(df).filter("ord = 0").collect()}
    firsts = sorted([(min(loop), min(loop)), (min(other), min(other)), (min(path[:-1]), path[0])])
    assert numbers == {**{(1, i): v for i, (_, v) in enumerate(firsts)}, (2, 0): 5}
