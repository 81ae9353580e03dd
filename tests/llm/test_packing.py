import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from terralith.llm import packing
from terralith.llm.words import Batch
from tests.llm.test_bpe import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tk, window=2048):
    want = {}
    for d in docs:
        want[d.doc_id] = [*tk.encode(d.text or "", add_special_tokens=False).ids, 1]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(want[d])
    partial = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        partial += at != window
        assert at <= window
    assert partial <= 1 and sorted(by_seq) == list(range(len(by_seq)))
    return want, by_seq


def test_words_match_the_pattern():
    random.seed(4)
    slow = regex.compile(public_tokenizers.PATTERN)
    alphabet = [*"'' '  \n\t  aAstrevlmdé1²٣あ!?.-  😀", "'s", "'re", "'ll", "'ve", "'d ", "  "]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(5000)] + [""]
    b = Batch(texts)
    for i, t in enumerate(texts):
        assert [b.word(j) for j in range(b.bounds[i], b.bounds[i + 1])] == slow.findall(t)


def test_encoder_matches_tokenizers(tk):
    random.seed(2)
    alphabet = [*"abcdefghij 's\n éß😀1.", "the ", " ing", "<|endoftext|>"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 200))) for _ in range(300)]
    texts += ["", "x" * 3000, "=" * 700 + "é" * 400, " \n" * 500, "a <|endoftext|> b", "<|endoftext|>", "long it's größe\n\n _x  " * 60_000, *thue_morse(2048), *thue_morse(1024)]
    got = [x.tolist() for x in packing.Encoder(PATH).encode(texts)]
    assert got == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_packs_every_token(spark, tk):
    rows = packing.op7_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want, by_seq = check(rows, docs, tk)
    source = {d.doc_id: d.source for d in docs}
    total = Counter()
    for d, ids in want.items():
        total[source[d]] += len(ids)
    everything, served = sum(total.values()), Counter()
    for i, s in enumerate(sorted(by_seq)[:-4]):
        for p in by_seq[s]:
            served[source[p.doc_id]] += p.length
        for q, n in total.items():  # deficits stay small in every window, as they carry over
            assert abs(served[q] - n / everything * (i + 1) * 2048) < 6 * packing.QUANTUM


def test_edges(spark, tk):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "word " * 9000, "a", "x"), (4, "end", "b", None), (5, "more words here", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, queue string")
    check(packing.pack(df, PATH).collect(), df.collect(), tk)
    check(packing.pack(df, PATH, mixture={"b": 0.9, "a": 0.1}).collect(), df.collect(), tk)
    twice = packing.pack(df.unionAll(df), PATH, with_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(df, PATH).collect())
    assert packing.pack(df.filter("doc_id < 0"), PATH).count() == 0


def test_schedule_is_a_permutation():
    s = packing.Schedule({"a": 5000, "b": 300, "c": 20000, "d": 10}, {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1})
    seen = [int(s.rank(np.array([q]), np.array([k]))[0]) for q in range(4) for k in range(s.quanta[q])]
    assert sorted(seen) == list(range(len(seen)))


def test_many_sources_stay_queues(spark, tk):
    random.seed(9)
    size = {f"host{i:03d}": random.randint(2000, 6000) for i in range(400)}
    # sources lie together, in one partition each
    rows = [(i, "word " * (n - 2), s) for i, (s, n) in enumerate(sorted(size.items()))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = {s: 2.0 if int(s[4:]) % 2 else 1.0 for s in size}
    for mixture in (None, given):
        want, by_seq = check(packing.pack(df, PATH, mixture=mixture).collect(), df.collect(), tk)
        total = {rows[d][2]: len(ids) for d, ids in want.items()}
        share = total if mixture is None else mixture
        everything, served = sum(share.values()), Counter()
        dry = min(total[s] * everything / share[s] for s in total)  # tokens until the first queue runs dry
        for i, seq in enumerate(sorted(by_seq)):
            for p in by_seq[seq]:
                served[rows[p.doc_id][2]] += p.length
            if (i + 1) * 2048 > dry - 400 * packing.QUANTUM:
                break
            for s in total:
                assert abs(served[s] - share[s] / everything * (i + 1) * 2048) < 2.5 * packing.QUANTUM
        assert i > 100
    schedule = packing.Schedule(size, given)
    seen = np.concatenate([schedule.rank(np.full(n, q), np.arange(n)) for q, n in enumerate(schedule.quanta)])
    assert sorted(seen.tolist()) == list(range(len(seen)))


def tokens(rows):
    """(document, token) to its place in the stream of windows."""
    return {(r.doc_id, r.start + i): r.sequence_id * 2048 + r.offset + i for r in rows for i in range(r.length)}


@pytest.mark.parametrize("mixture", [None, {"a": 5.0, "b": 1.0, "ü": 3.0}])
def test_sorted_quanta_give_the_places_of_the_closed_form(spark, tk, monkeypatch, mixture):
    random.seed(5)
    docs = [(i, "word " * random.choice([0, 3, 200, 2500, 9000]), random.choice(["a", "a", "a", "b", "c", "ü", None])) for i in range(120)]
    docs.append((200, None, "only"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    df = spark.createDataFrame(df.collect(), df.schema)
    want = packing.pack(df, PATH, mixture=mixture).collect()
    monkeypatch.setattr(packing, "QUEUES", 0)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    got = packing.pack(df, PATH, mixture=mixture, with_ids=True).collect()
    check(got, df.collect(), tk)
    assert tokens(got) == tokens(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack(df.filter("doc_id < 0"), PATH).count() == 0


def test_thousands_of_sources_match_a_served_round_robin(spark, tk):
    """Quanta of 3,000 sources in the order of their due times, as exact fractions."""
    from fractions import Fraction

    random.seed(6)
    rows = [(i, "word " * random.choice([10, 300, 300, 900]), f"s{i % 3000}") for i in range(3600)]
    rows += [(9000 + i, "word " * 20_000, "s7") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, PATH).collect()
    want, _ = check(got, df.collect(), tk)
    source, size = {r[0]: r[2] for r in rows}, Counter()
    for d, ids in want.items():
        size[source[d]] += len(ids)
    schedule = packing.Schedule(size)
    due = [(Fraction(k + 1, int(w)), q) for q, w, m in zip(schedule.names, schedule.weights, schedule.quanta, strict=True) for k in range(m)]
    order, by_place = [q for _, q in sorted(due)], [None] * sum(size.values())
    for (d, _), place in tokens(got).items():
        by_place[place] = source[d]
    tail = [q for q in schedule.names for _ in range(size[q] % packing.QUANTUM)]
    assert by_place == [q for q in order for _ in range(packing.QUANTUM)] + tail


@pytest.mark.parametrize("seed", range(6))
def test_places_match_a_served_round_robin(seed):
    """Deficit round-robin served quantum by quantum, credits in exact fractions."""
    from fractions import Fraction

    rng = random.Random(seed)
    totals = {f"q{i}": rng.randint(0, 9000) for i in range(rng.randint(1, 7))}
    mixture = {q: rng.choice([1.0, 2.0, 5.0]) for q in totals} if seed % 2 else None
    s = packing.Schedule(totals, mixture)
    credit = {i: Fraction(0) for i, n in enumerate(s.quanta) if n}
    left, served = {i: int(s.quanta[i]) for i in credit}, []
    while any(left.values()):
        # time until the first queue that still has quanta can pay for one; all earn alike
        wait = min((1 - credit[i]) / int(s.weights[i]) for i in credit if left[i])
        for i in credit:
            credit[i] += wait * int(s.weights[i])
        for i in sorted(credit):
            if left[i] and credit[i] >= 1:
                credit[i] -= 1
                left[i] -= 1
                served.append((i, int(s.quanta[i]) - left[i] - 1))
    queue, k = np.array([q for q, _ in served], np.int64), np.array([x for _, x in served], np.int64)
    assert s.rank(queue, k).tolist() == list(range(len(served)))


def test_dictionary_tells_words_of_one_hash_apart(monkeypatch):
    """With one hash for all words, numbers still follow the words, in a batch and across batches."""
    from terralith.llm import words

    monkeypatch.setattr(words, "slice_hashes", lambda points, starts, ends: np.zeros(len(starts), np.uint64))
    d, names = words.Dictionary(), []
    for text in ("one two one 3", "three two one, 3", "", "two four"):
        batch = Batch([text])
        got, fresh = d.number(batch)
        names += fresh
        assert [names[i] for i in got] == [batch.word(i) for i in range(len(batch.starts))]
    assert len(set(names)) == len(names)
