import hashlib
import re

from terralith.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def slow(text):
    out = []
    for i, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(p, text or "") if ok(kind, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "mail a.b@c.d_e@f.g and x@y a@b.c@d.e é😀 q@w.e. -@-.-", "ip 1.2.3.4.5 256.1.1.1 0255.1.1.1 00000300.1.1.1 1.2.3 10.0.0.1",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 49942260209008919 4994226020900891", "call +49 (30) 1234-567 or +1 2 or +(1) +12345678901234567 +1.2.3.4.5.6.7.8.9",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "a" * 20000 + "@" + "b" * 20000 + ".c", "+" * 2000 + "1" * 2000, "9" * 30000 + ".1",
    "tel 030-123 4567, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, dear Mr. John Smith,", "version 1.2.3.4 isbn 978-3-16-148410-0",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None)], "doc_id long, text string, weak string, len int")
    rows = pii.scan(df).select("id", pii.ordered(pii.F.col("base"), pii.KINDS).alias("b"), "extra").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.b == slow(TEXTS[r.id]), (TEXTS[r.id] or "")[:80]
    assert {x.kind for r in rows if r.id == 10 for x in r.extra} >= {"iban"}
    assert not [x for r in rows if r.id == 11 for x in r.extra]


def test_em_learns_who_is_right():
    groups = [("email", (1, 0, 1, 1, 0), 1, 500), ("email", (1, 0, 1, -1, 0), 1, 10), ("ip", (-1, 0, -1, 1, -1), 1, 300), ("ip", (-1, 0, -1, -1, -1), 1, 20)]
    post, right = pii.estimate(groups)
    assert post["email", (1, 0, 1, 1, 0)] > 0.9 and post["ip", (-1, 0, -1, 1, -1)] < 0.1
    assert right[0] > right[3]
    assert pii.fit([]) == [0.0] * len(pii.fit([]))


def test_empty_table(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    rows = pii.op8_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        base = slow(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == (len(base.split(",")) if base else 0)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_many_spans_in_one_text(spark):
    import time

    n = 100_000
    text = "; ".join(f"u{i}@host{i}.com" for i in range(n)) + " tel 030-123 4567"
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    began = time.time()
    got = {r.id: r for r in pii.scan(df).select("id", pii.F.size("base").alias("n"), pii.F.try_element_at("base", pii.F.lit(-1)).alias("last"), "extra").collect()}
    assert time.time() - began < 90
    assert got[1].n == n and text[got[1].last.s : got[1].last.e] == f"u{n - 1}@host{n - 1}.com" and got[2].n == 0
    assert [text[x.s : x.e] for x in got[1].extra] in ([], ["030-123 4567"])


def test_votes_by_hand(spark):
    """shape, checksum, gazetteer, words before, counter-indications."""
    cases = [
        ("write to anna.b@web.de now", "email", [1, 0, 1, 1, 0]),
        ("x a@b.c9", "email", [-1, 0, 0, 0, 0]),
        ("host 127.0.0.1", "ip", [0, -1, 0, 1, 0]),
        ("version 10.20.30.40", "ip", [0, 0, 0, 0, -1]),
        ("visa 4111 1111 1111 1111", "card", [1, 1, 0, 1, 0]),
        ("call +49 30 1234567", "phone", [1, 0, 1, 1, 0]),
        ("iban DE89 3704 0044 0532 0130 00", "iban", [0, 1, 1, 1, 0]),
        ("konto DE88 3704 0044 0532 0130 00", "iban", [0, -1, 1, 1, 0]),
        ("from Mr. John Smith", "name", [0, 0, 1, 1, 0]),
        ("y" * 1020 + " ssn 123-45-6789", "ssn", [1, 0, 0, 1, 0]),
        ("order 123-45-6789", "ssn", [1, 0, 0, 0, -1]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i long, text string")
    text = pii.F.col("text")
    rows = df.select("i", pii._labelled(text, pii.F.concat(pii.base_spans(text), pii.weak_spans(text))).alias("x")).collect()
    for r in rows:
        _, kind, votes = cases[r.i]
        assert votes in [x.votes for x in r.x if x.kind == kind], (cases[r.i], r.x)


def test_em_against_expanded_rows():
    """The same estimates from one row for each span instead of counted groups."""
    import numpy as np

    rng = np.random.default_rng(7)
    groups = [(k, tuple(map(int, rng.integers(-1, 2, pii.LABELERS))), 1, int(n)) for k in ("email", "tel") for n in rng.integers(1, 40, 12)]
    groups = list({(k, v): (k, v, ln, n) for k, v, ln, n in groups}.values())
    kinds = np.array([k for k, _, _, n in groups for _ in range(n)])
    votes = np.array([v for _, v, _, n in groups for _ in range(n)])
    right, share = np.full(pii.LABELERS, 0.8), {k: 0.5 for k in set(kinds)}
    for _ in range(40):
        prior = np.array([np.log(share[k] / (1 - share[k])) for k in kinds])
        p = 1 / (1 + np.exp(-np.clip(prior + votes @ np.log(right / (1 - right)), -30, 30)))
        agree = np.where(votes > 0, p[:, None], 1 - p[:, None])
        right = np.clip((8 + (agree * (votes != 0)).sum(0)) / (10 + (votes != 0).sum(0)), 0.51, 0.99)
        share = {k: float(np.clip((2 + p[kinds == k].sum()) / (4 + (kinds == k).sum()), 0.02, 0.98)) for k in share}
    post, got = pii.estimate(groups)
    assert np.allclose(got, right)
    for (k, v), x in post.items():
        assert abs(x - p[np.flatnonzero((kinds == k) & (votes == v).all(1))[0]]) < 1e-6


def test_columns_with_helper_names(spark):
    df = spark.createDataFrame([(1, "a@b.de", "x", 1, 2, 3)], "doc_id long, text string, base string, weak int, extra int, id long")
    assert [(r.id, len(r.base)) for r in pii.scan(df).collect()] == [(1, 1)]
