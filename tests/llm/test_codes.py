import math

import numpy as np
import pytest

from terralith.llm import codes


def slow(rows, entries, rounds):
    """Plain Lloyd over Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[1])
    kept = [r for r in kept if len(r[1]) == dim]
    seeds = []
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        if i not in [s[0] for s in seeds] and len(seeds) < entries:
            seeds.append((i, v))
    cuts = [dim * p // 4 for p in range(5)]
    books = [[s[1][cuts[p] : cuts[p + 1]] for s in seeds] for p in range(4)]

    def assign():
        out = []
        for _, v, _ in kept:
            best = []
            for p in range(4):
                x = v[cuts[p] : cuts[p + 1]]
                best.append(min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for j in range(len(seeds)):
                mine = [r[1][cuts[p] : cuts[p + 1]] for r, b in zip(kept, found) if b[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    coded = [(i, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for (i, _, _), b in zip(kept, found)]
    return sorted(coded, key=repr), books


def check(spark, rows, entries, rounds):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, id int")
    coded, books, work = codes.vector_codes(df, entries=entries, rounds=rounds)
    got = sorted(((r.id, bytes(r.code).hex(), r.error) for r in coded.collect()), key=repr)
    want, plain = slow(rows, entries, rounds)
    assert got == want
    assert [b.tolist() for b in books] == plain
    return work


def test_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 18))
    rows = [(100 - i, (centres[i % 12] + 0.1 * rng.standard_normal(18)).tolist(), i % 3) for i in range(90)]
    rows += [rows[5], rows[5], (rows[7][0], rows[8][1], None), (None, rows[3][1], 1), (500, None, 1), (501, [], 0), (502, [math.nan] * 18, 0), (503, [1.0] * 17 + [None], 0), (504, [math.inf] * 18, 0), (505, [1.0, 2.0], 0), (12, [1.0], 0)]
    work = check(spark, rows, 16, 4)
    assert work[-1] < work[0] / 2  # bounds prune


def test_ties_go_to_the_lower_index(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), None) for i in range(200)]
    check(spark, rows, 32, 4)


def test_fewer_vectors_than_entries_and_short_vectors(spark):
    check(spark, [(3, [0.5, -0.25], 1), (1, [0.25, 1.0], 1), (2, [0.1, 0.9], 0)], 256, 4)


def test_empty_table_and_large_components(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books, _ = codes.vector_codes(none)
    assert coded.count() == 0 and sum(map(len, books)) == 0
    large = spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="scale the vectors"):
        codes.vector_codes(large)


def test_bounds_hold_over_rounds():
    rng = np.random.default_rng(6)
    x = rng.integers(-3000, 3000, (300, 5))
    book = codes.Codebook(x[:20].copy())
    a, upper, lower = book.first(x)
    for _ in range(6):
        entries = book.entries.copy()
        for j in range(20):
            if (a == j).any():
                entries[j] = x[a == j].sum(axis=0) // (a == j).sum()
        book = codes.Codebook(entries, book.entries)
        a, upper, lower, _ = book.again(x, a, upper, lower)
        d = np.sqrt(((x[:, None] - entries[None]) ** 2).sum(-1))
        assert (a == codes._squares(x, entries).argmin(axis=1)).all()
        assert (upper >= d[np.arange(300), a]).all() and (lower <= d).all()
