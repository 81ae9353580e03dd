import collections

import corpus_pipeline as cp
from terralith.llm import packing
from tests.llm.test_packing import check
from tests.llm.test_secrets import ASSIGN
from tests.llm.test_simhash import roots, slow_fp

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns = docs.columns
    rows = {d.doc_id: d for d in docs.collect()}

    one = cp.language_id(spark, docs, DIR).cache()
    kept = {d.doc_id: d for d in one.collect()}
    assert one.columns == columns and all(kept[i] == rows[i] for i in kept)
    assert len(kept) > 0.97 * len(rows)

    two = cp.near_duplicates(spark, one, DIR).cache()
    groups = roots([(i, slow_fp(d.text)) for i, d in kept.items()])
    single = {d.doc_id: d for d in two.collect()}
    assert set(single) == set(groups.values()) and two.columns == columns
    assert all(single[i] == rows[i] for i in single)

    three = cp.secret_scan(spark, two, DIR).cache()
    clean = {d.doc_id: d for d in three.collect()}
    assert set(clean) == set(single) and three.columns == columns
    for i, d in clean.items():
        assert not [m for m in ASSIGN.finditer(d.text) if len(m[2]) >= 12]
        if "<secret>" in d.text:
            assert d.n_chars == len(d.text)
        else:
            assert d == single[i]

    four = cp.packing(spark, three, DIR)
    check(four.collect(), three.collect(), packing._tokenizer(packing.default_tokenizer()))


def test_run_equals_stages(spark):
    got = cp.run(spark, DIR).collect()
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "packing"]
    docs = collections.Counter(r.doc_id for r in got)
    assert docs and sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_odd_rows_survive(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and thing", "en", "s", 4), (3, "password=abcdefghijklmnop the of and", "en", "s", 1)]
    rows += [rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[1:3]:
        docs = stage(spark, docs, DIR)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str)
    assert got == sorted([(1, None, None), (None, "the of and thing", 4), (3, "password=<secret> the of and", 28)], key=str)
    empty = docs.filter("doc_id > 99")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DIR).count() == 0
