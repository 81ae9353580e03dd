import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from terralith.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    random.seed(3)
    alphabet = [*"abcdefghij 's\n éß😀1.\x00Ā", "the ", " ing", "<|endoftext|>", "ción", " größe"]
    out = ["".join(random.choices(alphabet, k=random.randint(0, 120))) for _ in range(150)]
    return [None, "", *out, "x" * 3000, "=" * 700 + "é" * 400, " \n" * 500, "ab" * 40 + " end"]


def test_heap_matches_library(enc):
    ranks = bpe.load_ranks(PATH)
    for t in texts():
        for w in [(t or "")[:60].encode(), b"aaaaaaaaaaaaa"]:
            if w:
                assert bpe.heap_encode(w, ranks) == enc._core_bpe.encode_single_piece(w)


def test_encode_and_decode(spark, enc):
    ts = texts()
    df = spark.createDataFrame([(i, t, "q", "w") for i, t in enumerate(ts)] + [(2, ts[2], None, None)], "doc_id long, text string, words string, ids string")
    tokens = bpe.encode(df, PATH)
    got = {r.id: r.tokens for r in tokens.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(ts)}
    back = {r.id: bytes(r.bytes) for r in bpe.decode(tokens, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ts)}
    assert bpe.encode(df.filter("doc_id < 0"), PATH).count() == 0


def test_small_dictionary(enc, monkeypatch):
    import pyarrow as pa

    ts = texts()
    monkeypatch.setattr(bpe.Dictionary, "LIMIT", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["a", "b"]) for i, t in enumerate(ts)]
    got = [b.column(1).to_pylist()[0] for b in bpe._assemble(PATH, bpe._id_lists, bpe._id_list_long)(batches)]
    assert got == [enc.encode_ordinary(t or "") for t in ts]


def test_fold_in_the_plan(spark, enc):
    words = sorted({w for t in texts() for w in regex.findall(public_tokenizers.PATTERN, t or "") if len(w) < 30})
    df = spark.createDataFrame([(w,) for w in [*words, None, "", words[0]]], "word string")
    got = {r.word: r.ids for r in bpe.fold_words(df, PATH).collect()}
    assert got == {w: enc.encode_ordinary(w) for w in [*words, ""]}


def test_query_against_library(spark, enc):
    rows = bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def thue_morse(n):
    """Two words of n letters with equal polynomial hashes modulo 2**64 for every odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("apart", [False, True])
def test_words_with_equal_hashes(enc, apart):
    import pyarrow as pa

    ts = [*thue_morse(2048), *thue_morse(1024), "ab " + thue_morse(2048)[1]]
    groups = [[t] for t in ts] if apart else [ts]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(g))), pa.array(g, pa.string())], ["a", "b"]) for g in groups]
    got = [x for b in bpe._assemble(PATH, bpe._id_lists, bpe._id_list_long)(batches) for x in b.column(1).to_pylist()]
    assert got == [enc.encode_ordinary(t) for t in ts]


def test_long_texts_in_pieces(spark, enc):
    random.seed(5)
    ts = ["".join(random.choices(["word ", "größe\n", "  x", "it's ", "12 ", "\n\n", "_a "], k=400_000)), "short", "y" * 700_000, "a b " * 300_000 + " "]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    tokens = {r.id: r.tokens for r in bpe.encode(df, PATH).collect()}
    for i, t in enumerate(ts):
        ids = enc.encode_ordinary(t)
        assert tokens[i] == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
