import numpy as np
import pytest

from terralith.llm import embeddings


def slow(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.asarray(v, np.float64)
        return a / np.linalg.norm(a)

    us = [unit(v) for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if us[i] is None or us[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(us[i]) != len(us[j]):
                continue
            if us[i] @ us[j] >= threshold:
                links[ids[i]] += 1
                links[ids[j]] += 1
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {i: (links[i], find(i)) for i in ids}


@pytest.mark.parametrize(("block", "small"), [(7, 2), (1024, 2), (1024, 16)])
def test_clusters_and_odd_rows(spark, monkeypatch, block, small):
    monkeypatch.setattr(embeddings, "SMALL", small)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(20):
            v = centre + rng.standard_normal(16) * 0.09 * np.linalg.norm(centre) / 4
            rows.append((100 + len(rows), v.astype(np.float32).tolist(), c % 2))
    rows += [(10, rows[0][1], 0), (11, rows[0][1], 1), (12, rows[0][1], None), (13, None, 0), (14, [0.0] * 16, 0)]
    rows += [(15, [float("nan")] * 16, 0), (16, [1.0, None], 0), (17, [], 0), (18, [2.0, 1.0], 0), (19, [1.0, 0.5], 0), (20, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()}
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert got == slow(f32)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_query_against_brute_force(spark):
    rows = embeddings.op3_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect()
    src = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want = slow([(r.vec_id, r.embedding, r.label) for r in src])
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


@pytest.mark.parametrize("small", [1, 16])
def test_links_at_the_very_threshold_are_not_lost_to_rounding(spark, monkeypatch, small):
    # the exact cosines round to 0.98, the product of the normalised vectors lies below it
    monkeypatch.setattr(embeddings, "SMALL", small)
    pairs = [([7.0, 3.0, 0.0, -4.0, -4.0, -9.0], [6.0, 2.0, -1.0, -3.0, -4.0, -5.6284144791860955]), ([-2.0, 7.0, 1.0, -9.0, 5.0, 4.0], [-1.0, 6.0, 0.0, -8.0, 4.0, 5.620996235594651])]
    rows = [(2 * n + i, v, str(n)) for n, pair in enumerate(pairs) for i, v in enumerate(pair)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2)]


def _chains(n, angle=0.19):
    """Rows of ``n`` paths of four vectors, each linked with the next only; by their ids 1-3, 3-4 and 4-2."""
    rng, rows = np.random.default_rng(11), []
    for c in range(n):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        for k, i in enumerate((1, 3, 4, 2)):
            rows.append((10 * c + i, (np.cos(angle * k) * a + np.sin(angle * k) * b).tolist(), 0))
    return rows


@pytest.mark.parametrize("small", [2, 16])
def test_paths_of_links_inside_a_bucket_are_one_component(spark, monkeypatch, small):
    monkeypatch.setattr(embeddings, "SMALL", small)
    rows = _chains(400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == slow(rows)


def test_a_unit_gives_the_smallest_member_its_pairs_reach():
    import pandas as pd

    rows = _chains(1)
    m = [{"rep": i, "v": np.array(v), "w": 1, "k": [7, 7]} for i, v, _ in rows]
    want = {1: (1, 1), 3: (2, 1), 4: (2, 1), 2: (1, 1)}
    few = next(iter(embeddings._small_links(0.98)([pd.DataFrame({"dim": [16], "t": [0], "n": [4], "m": [m]})])))
    assert {r.rep: (r.links, r.low) for r in few.itertuples()} == want
    many = pd.DataFrame(m).assign(t=0, i=0, j=0, side=0)
    assert {r.rep: (r.links, r.low) for r in embeddings._unit_links(0.98)(many).itertuples()} == want
    # two blocks: 1-3 and 4-2 are no pairs of this unit
    assert {r.rep: (r.links, r.low) for r in embeddings._unit_links(0.98)(many.assign(j=1, side=[0, 0, 1, 1])).itertuples()} == {3: (1, 3), 4: (1, 3)}
    # a long path in one block, and ids that fall along it
    ids = np.random.default_rng(3).permutation(300)
    path = pd.DataFrame([{"rep": int(i), "v": np.array([np.cos(0.01 * k), np.sin(0.01 * k)]), "w": 1, "k": [7]} for k, i in enumerate(ids)]).assign(t=0, i=0, j=0, side=0)
    assert set(embeddings._unit_links(0.9999)(path)["low"]) == {0}
