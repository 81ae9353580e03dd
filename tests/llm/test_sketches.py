import hashlib

import numpy as np
import pytest
import xxhash

from terralith.llm import sketches as sk
from tests.llm.test_bpe import thue_morse


def words(t):
    t = t.translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def grams(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def of(t):
    return sk.sketch(sk.word_hashes(t.encode()))


def test_likeness_tracks_jaccard():
    base = [f"w{i}" for i in range(4000)]
    for cut in (0, 500, 1500, 3000):
        a, b = " ".join(base), " ".join(base[cut:] + [f"x{i}" for i in range(cut)])
        assert abs(sk.likeness(of(a), of(b)) - jaccard(a, b)) < 0.06
    small = " ".join(base[1000:1400])
    assert sk.containment(of(small), of(" ".join(base))) > 0.95
    merged = sk.merge(of(small), of(" ".join(base)))
    assert merged.tolist() == of(" ".join(base)).tolist()
    assert sk.from_text(sk.to_text(merged)).tolist() == merged.tolist()


def test_words_and_short_texts():
    assert len(sk.word_hashes(b" A\tb\x0bA  ")) == 3
    assert sk.word_hashes(b"A b")[0] == sk.word_hashes(b"x  a")[1]
    assert len(of("")) == 0 and len(of("one")) == 1 and sk.likeness(of(""), of("")) == 1.0 and sk.likeness(of(""), of("a")) == 0.0


def test_merge_is_the_sketch_of_the_union():
    """Sketches of shingles that lie in one text or the other, short and long."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 40, 400):
        a, b = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2), rng.integers(0, 2**63, 5, np.uint64) * np.uint64(2)
        one, two = [np.unique(sk._kept(np.unique(x >> sk._SHIFT), sk.FRACTION)) for x in (a, b)]
        both = np.unique(sk._kept(np.unique(np.concatenate([a, b]) >> sk._SHIFT), sk.FRACTION))
        assert sk.merge(one, two).tolist() == both.tolist()


def test_words_of_equal_weak_hashes():
    a, b = thue_morse(2048)
    assert sk.word_hashes(a.encode())[0] != sk.word_hashes(b.encode())[0] and sk.likeness(of(a), of(b)) == 0.0


def slow(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64), r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), sk.to_text(of(t)), sk.to_text(of(new)), sk.likeness(of(t), of(new)), sk.likeness(of(t), of(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("per", [50, 1000, 100000])
def test_every_row_meets_its_follower(spark, per):
    rows = [(i * 7 % 31, f"text é😀 {i} " * (i % 5 * 40)) for i in range(31)] + [(3, None), (3, None), (None, "null id"), (40, ""), (41, "a b c d e f g")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, mark int")
    got = sorted((tuple(r) for r in sk.with_next(df, range_bytes=per).collect()), key=str)
    assert got == slow(rows)


def test_one_and_none(spark):
    df = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in sk.with_next(df).collect()] == [(1, 6)]
    assert sk.with_next(df.filter("doc_id > 1")).count() == 0
    assert sk.fingerprints(df).collect()[0].fingerprint == sk.to_text(of("abcdef"))


def test_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in sk.op4_document_fingerprints(spark, "/root/testdata/sf0.001").collect()), key=str)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == slow([(d.doc_id, d.text) for d in docs])


def test_one_id_is_spread_by_text(spark):
    rows = [(7, f"text {i}") for i in range(500)] + [(None, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    src = df.select("doc_id", "text", sk.F.struct(sk.F.col("doc_id").isNotNull().cast("long").alias("a"), sk.F.coalesce("doc_id", sk.F.lit(0)).alias("b"), sk.F.xxhash64("text").alias("c")).alias("key"))
    assert 6 <= len(sk._cuts(src, 7000)) <= 9
    got = sorted((tuple(r) for r in sk.with_next(df, range_bytes=7000).collect()), key=str)
    assert got == slow(rows)


def test_long_texts_in_pieces():
    raw = ("Alpha b\tgrün  " * 300 + "x" * 500 + "\n").encode()
    want = sk.word_hashes(raw)
    assert len(want) == 901 and all(sk.word_hashes(raw, p).tolist() == want.tolist() for p in (1, 10, 777))
