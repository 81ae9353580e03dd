"""Empty tables, and extra columns whose names the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from terralith.llm import bpe, common, embeddings, language, licenses

DIR = "/root/testdata/sf0.001"
CLASHES = ["id", "key", "text_", "words", "found", "runs", "base", "fp", "label_", "gone", "lang_", "rep", "v", "w", "t", "n", "cls", "template"]


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, n=60):
    return spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(n)


def wide(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("operator", ["licenses", "bpe", "embeddings", "language"])
def test_clashing_columns_change_nothing(spark, operator):
    docs = documents(spark)
    if operator == "licenses":
        run = licenses.scan
    elif operator == "bpe":
        run = lambda d: bpe.digests(d, ranks())
    elif operator == "embeddings":
        docs = spark.read.parquet(f"{DIR}/embeddings.parquet")
        run = embeddings.near_duplicates
    else:
        run = lambda d: language.identify(language.document_rows(d), language.train(d))
    assert rows(run(wide(docs))) == rows(run(docs))


@pytest.mark.parametrize("stage", [name for name, _ in cp.STAGES])
def test_stages_with_clashing_columns(spark, stage):
    docs = documents(spark)
    own = dict(cp.STAGES)[stage](spark, docs, DIR)
    got = dict(cp.STAGES)[stage](spark, wide(docs), DIR)
    assert rows(got.select(*own.columns)) == rows(own)
    if stage != "packing":
        assert set(CLASHES) <= set(got.columns)


def test_empty_tables(spark):
    docs = documents(spark).filter("doc_id < 0")
    assert bpe.digests(docs, ranks()).count() == 0 and bpe.encode(docs, ranks()).count() == 0
    assert licenses.scan(docs).count() == 0


def test_a_run_leaves_only_what_its_result_reads(spark):
    before = list(common._TABLES)
    cp.run(spark, DIR).count()
    left = [x for x in common._TABLES if x not in before]
    assert 1 <= len(left) <= 4


def test_very_long_text_through_the_pipeline(spark):
    long = "the house of the old river and the small boat " * 60_000
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, "of and the " * 30 + "password=abcdefghijklmnop", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
    got = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.n == r.m for r in got)
