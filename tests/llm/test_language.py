import numpy as np
import pytest

from terralith.llm import language as lg

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return lg.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    """Fitted on one half of the labelled documents, tested on the other, text alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    model = lg.fit([(d.lang, d.text) for d in docs if d.doc_id % 2])
    rest = [d for d in docs if d.doc_id % 2 == 0 and d.text.count(" ") >= 8]
    right = sum(model[0][int(np.argmax(lg.posterior(*model, d.text)[0]))] == d.lang for d in rest)
    assert right / len(rest) > 0.97


def test_query(spark):
    rows = lg.op10_language_id(spark, DIR).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    pages = {d.page_id: d for d in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(docs)
    assert sorted(r.page_id for r in rows if r.page_id is not None) == sorted(pages)
    found = [r for r in rows if r.doc_id is not None]
    assert sum(r.lang == docs[r.doc_id].lang for r in found) / len(found) > 0.97
    assert sum(r.accepted for r in found) / len(found) > 0.97
    assert all(r.accepted == (r.lang != "und") and 0 < r.confidence <= 1 for r in rows)


def test_fusion_matches_brute_force(spark, model):
    """The joint posterior, recomputed row by row from the same text scores."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    rows = [(d.doc_id, d.lang if d.doc_id % 9 else None, ["com", "fr", None][d.doc_id % 3], f"h{d.doc_id % 7}.{d.doc_id % 2}" if d.doc_id % 5 else None, f"{d.doc_id % 2}" if d.doc_id % 5 else None, d.text) for d in docs]
    rows += [(1000, "en", "com", "h1.1", "1", None), (1001, None, None, None, None, ""), (1002, "xx", "zz", "new", "new", "123 456"), (None, "en", None, None, None, "the thing")]
    df = spark.createDataFrame(rows, "key long, declared string, suffix string, host string, domain string, text string")
    got = {r.key: r for r in lg.identify(df, model).collect()}
    languages, k = model[0], len(model[0])
    ll = {r[0]: lg.posterior(*model, r[5] or "") for r in rows}
    soft = {i: np.exp(s) / np.exp(s).sum() if n else np.zeros(k) for i, (s, n) in ll.items()}
    mass = sum(soft.values())
    share = (mass + 1) / (mass.sum() + k)
    total = lambda col, v: sum((soft[r[0]] for r in rows if r[col] == v), np.zeros(k))
    for r in rows:
        joint = np.array(ll[r[0]][0])
        if r[3] is None:
            joint = joint + np.log(share)
        else:
            d, h = total(4, r[4]), total(3, r[3])
            middle = (d + lg.SMOOTH * share) / (d.sum() + lg.SMOOTH)
            joint = joint + np.log((h + lg.SMOOTH * middle) / (h.sum() + lg.SMOOTH))
        for c in (1, 2):
            if r[c] is not None:
                joint = joint + np.log((total(c, r[c]) + 0.5) / (mass + 50))
        p = np.exp(joint - joint.max())
        sure = 1 / p.sum()
        assert abs(got[r[0]].confidence - sure) < 1e-9
        want = languages[int(np.argmax(joint))] if ll[r[0]][1] and sure >= lg.ACCEPT else "und"
        assert got[r[0]].lang == want
    assert not got[1000].accepted and not got[1002].accepted


def test_pages_evidence(spark):
    html = '<!DOCTYPE html><html class="x" lang="pt-BR"><body>x</body></html>'
    df = spark.createDataFrame([(1, "https://u@News.Example.fr:80/a", html), (2, None, None), (3, "nonsense", "<html>"), (4, "http://10.0.0.1/", "")], "page_id long, url string, html string")
    got = {r.key: (r.declared, r.suffix, r.host, r.domain) for r in lg.page_rows(df).collect()}
    assert got[1] == ("pt", "fr", "news.example.fr", "example.fr")
    assert got[2] == got[3] == (None,) * 4
    assert got[4] == (None, None, "10.0.0.1", "0.1")


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, extra int")
    assert lg.identify(lg.document_rows(none), model).count() == 0
    assert lg.accepted_documents(none).columns == none.columns and lg.accepted_documents(none).count() == 0


def test_short_text_rests_on_other_evidence():
    """One letter gives no trigram but counts as a letter; digits and signs do not."""
    languages, model = lg.fit([("en", "the thing of the"), ("fr", "le la les des")])
    assert lg.posterior(languages, model, "A.") == ([0.0, 0.0], 1)
    assert lg.posterior(languages, model, "12. !")[1] == 0 and lg.posterior(languages, model, "")[1] == 0


def invented(rng, name):
    """Words of an invented language."""
    own = rng.permutation(26)[:9]
    return ["".join(chr(97 + own[i]) for i in rng.integers(0, 9, rng.integers(2, 7))) for _ in range(60)]


def test_many_and_rare_languages(spark):
    rng = np.random.default_rng(1)
    codes = [a + b for a in "abcdefghi" for b in "klmnopqrs"][:80]
    words = {c: invented(rng, c) for c in codes}
    say = lambda c: " ".join(rng.choice(words[c], 40))
    rows = [(c, say(c)) for c in codes for _ in range(3 if c == codes[-1] else 12 if c != codes[0] else 400)]
    df = spark.createDataFrame([(i, t, c, "s", 0) for i, (c, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, key int")
    model = lg.train(df, sample=6)
    assert model[0] == sorted(codes)
    fresh = [(c, say(c)) for c in codes for _ in range(2)]
    new = spark.createDataFrame([(i, t, None, None, 0) for i, (_, t) in enumerate(fresh)], "doc_id long, text string, lang string, source string, key int")
    got = {r.key: r.lang for r in lg.identify(lg.document_rows(new), model).collect()}
    assert sum(got[i] == c for i, (c, _) in enumerate(fresh)) >= 150
    assert got[158] == got[159] == codes[-1]
    assert lg.accepted_documents(df).columns == df.columns


def test_long_texts_in_pieces(monkeypatch):
    text = "the thing of größe 12 " * 200
    whole = lg.trigrams(text)
    monkeypatch.setattr(lg, "PIECE", 37)
    assert np.array_equal(np.sort(np.concatenate(list(lg._pieces(text)))), np.sort(whole))
    assert np.array_equal(lg._counts(text), np.bincount(whole, minlength=1 << lg.BITS)) and not lg._counts("").any()
