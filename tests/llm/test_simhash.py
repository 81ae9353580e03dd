import numpy as np
import pytest
import xxhash

from terralith.llm import simhash


def slow_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(rows):
    """Brute-force components over (id, fp)."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


TEXTS = ["", None, "one", "One two", "one TWO three", "a b c d", "a b c d a b c d e", "é è x y z w", "  lead\ttab\x0bvt\n", "w " * 3000, " em space stays"]


def test_fingerprint_matches_definition():
    for t in TEXTS:
        assert simhash.fingerprint_bytes((t or "").encode()) == slow_fp(t)


def run_op(spark, rows, tmp_path, bucket=simhash.BUCKET):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, n int")
    return {(r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(df).collect()}


def test_groups_and_edges(spark, tmp_path):
    base = [f"w{i}" for i in range(200)]
    rows = [(10 + i, t, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(base[: 198 + i % 3]), None, 2) for i in range(12)]
    rows += [(100, " ".join(base[:198]), None, 2), (None, "a b c d", None, None)]
    got = run_op(spark, rows, tmp_path)
    want_fp = {(i, slow_fp(t)) for i, t, *_ in rows}
    assert {(i, f) for i, f, _ in got} == want_fp
    want = roots([(i, f) for i, f in want_fp if i is not None])
    assert {(i, c) for i, _, c in got if i is not None} == set(want.items())
    assert {c for i, _, c in got if i is None} == {None}


@pytest.mark.parametrize("bucket", [1, 4, 48])
def test_links_keep_every_component(spark, bucket):
    rng = np.random.default_rng(5)
    fps = set()
    for c in rng.integers(-(2**63), 2**63 - 1, 12).tolist():
        x = c
        for _ in range(25):
            flip = rng.integers(0, 64, 2).tolist()
            x ^= (1 << flip[0]) ^ (1 << flip[1])
            fps.add(((x & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.fingerprint_links(df, bucket=bucket).collect()
    u = (1 << 64) - 1
    assert all(((e.a & u) ^ (e.b & u)).bit_count() <= 2 and e.a != e.b for e in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((find(e.a), find(e.b)))
        parent[b] = a
    want = roots([(f, f & u) for f in fps])
    assert {f: find(f) for f in fps} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(df).count() == 0
    assert simhash.keep_one_per_group(df).columns == ["doc_id", "text"]


def test_query_against_brute_force(spark):
    rows = simhash.op6_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = {d.doc_id: slow_fp(d.text) for d in docs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == roots(list(fps.items()))


def test_long_texts_are_read_in_pieces():
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["Alpha", "b", "grün", "delta\t", "\n e", "x" * 70], 3000)).encode()
    want = simhash.fingerprint_bytes(text)
    assert all(simhash.fingerprint_bytes(text, piece=p) == want for p in (1, 7, 500, 20000))
    assert simhash.fingerprint_bytes(b"a b", piece=1) == simhash.fingerprint_bytes(b"a b") == simhash.fingerprint_bytes(b" A  b ", piece=1)


def test_columns_with_helper_names(spark):
    names = "doc_id long, text string, key long, _key string, id long, fp long, n long, component_id long"
    df = spark.createDataFrame([(1, "a b c d", 1, "u", 5, 6, 7, 8), (2, "a b c d", 2, "v", 5, 6, 7, 8), (3, "q r s t", 3, None, 5, 6, 7, 8), (3, "q r s t", 3, None, 5, 6, 7, 8)], names)
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
