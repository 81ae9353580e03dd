"""Findings F11 to F24 of round 3: tasks whose rows are bounded, and the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith.operators import storage, voxel


def _cells(spark, n=400, seed=11):
    rng = np.random.default_rng(seed)
    at = rng.permutation(8 * 8 * 8)[:n]
    frame = pd.DataFrame({"cell_id": np.arange(n) * 3, "ix": at % 8, "iy": at // 8 % 8, "iz": at // 64, "label": rng.integers(-1, 4, n)})
    return spark.createDataFrame(frame.astype({"ix": "int32", "iy": "int32", "iz": "int32"})), frame


def _pairs(frame):
    by = {}
    for r in frame.itertuples():
        by.setdefault((r.ix, r.iy, r.iz), []).append(r.cell_id)
    return {r.cell_id: [o for s in voxel.STEPS for o in by.get((r.ix + s[0], r.iy + s[1], r.iz + s[2]), [])] for r in frame.itertuples()}


def _modes(near, label):
    out = {}
    for c, others in near.items():
        seen = [label[o] for o in others]
        if seen:
            out[c] = min(set(seen), key=lambda x: (-seen.count(x), x))
    return out


def test_f11_f17_cells_are_dealt_by_their_number_and_nothing_is_broadcast(spark, monkeypatch):
    cells, frame = _cells(spark)
    cells = cells.unionByName(cells.filter("cell_id % 9 = 0").withColumn("cell_id", F.col("cell_id") + 10_000))  # two cells in one place
    frame = cells.toPandas()
    near, label = _pairs(frame), dict(zip(frame.cell_id, frame.label))
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    pairs, modes = voxel.neighbours(cells), voxel.neighbour_mode(cells)
    for got in (pairs, modes):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert modes.rdd.getNumPartitions() >= 6 * len(frame) // 100
    assert sorted((r.cell_id, r.label, r.other, r.other_label) for r in pairs.collect()) == sorted((c, label[c], o, label[o]) for c in near for o in near[c])
    assert {r.cell_id: r.mode for r in modes.collect()} == _modes(near, label)


@pytest.mark.parametrize("least", [1, 2, 3, 4, 7, 9, 40])
def test_f18_fragments_are_those_of_whole_components_in_every_pass(spark, least):
    cells, frame = _cells(spark, seed=least)
    near, label = _pairs(frame), dict(zip(frame.cell_id, frame.label))
    for _ in range(5):
        seen, moving = set(), []
        for c in label:
            if c in seen or label[c] < 0:
                continue
            part, todo = {c}, [c]
            while todo:
                for o in near[todo.pop()]:
                    if label[o] == label[c] and o not in part:
                        part.add(o)
                        todo.append(o)
            seen |= part
            moving += part if len(part) < least else []
        modes = _modes(near, label)
        label = label | {c: modes.get(c, label[c]) for c in moving}
    got = voxel.clean_fragments(cells, least)
    assert got.columns == cells.columns
    assert {r.cell_id: r.label for r in got.collect()} == label


def test_f18_a_pass_looks_only_at_what_the_one_before_it_moved(spark, monkeypatch):
    cells, _ = _cells(spark)
    sizes, found = [], voxel._fragments

    def fragments(near, least):
        sizes.append(near.count())
        return found(near, least)

    monkeypatch.setattr(voxel, "_fragments", fragments)
    voxel.clean_fragments(cells, 4)
    assert len(sizes) > 1 and sizes[1] < sizes[0] and sizes == sorted(sizes, reverse=True)


def test_f19_f20_intervals_are_dealt_once_by_hole_and_number(spark, monkeypatch):
    from terralith.plans import bindings, properties

    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    most = bindings.read(spark, sf, "lineitem").count()
    for query in (properties.merge_intervals, properties.merge_intervals_in_order):
        got = query(spark, sf)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert got.rdd.getNumPartitions() >= most // 100
        assert got.agg(F.sum("n")).first()[0] == most


def test_f24_edges_are_distinct_in_tasks_of_bounded_rows(spark, monkeypatch):
    from terralith.operators import mesh

    rows = [(i, i % 7, (i * 3 + 1) % 7, (i * 5 + 2) % 7) for i in range(300)] + [(300, 9, 9, 8), (301, None, 3, 9)]
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    got = mesh.undirected_edges(spark.createDataFrame(rows, "t_id int, v0 long, v1 long, v2 long"))
    assert got.rdd.getNumPartitions() >= 9
    want = set()
    for _, *v in rows:
        for a, b in zip(v, v[1:] + v[:1]):
            want |= {(a, b), (b, a)}
    assert sorted(((r.a, r.b) for r in got.collect()), key=str) == sorted(want, key=str)


def test_f23_equal_prices_are_one_row_before_the_percentile(spark, tmp_path):
    from terralith.plans import survey

    rows = [("A", float(p)) for p in (1, 1, 1, 2, 5, 9)] * 50 + [("A", None), ("N", 4.0), ("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double").repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = survey.map_range_percentiles(spark, str(tmp_path))
    assert "Aggregate [l_returnflag" in (plan := query._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate [") == 2
    got = {r.l_returnflag: (r.p05, r.p95) for r in query.collect()}
    held = [p for f, p in rows if f == "A" and p is not None]
    assert got == {"A": tuple(np.percentile(held, [5, 95])), "N": (4.0, 4.0), "R": (None, None)}
