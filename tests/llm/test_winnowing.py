import random
import re

import numpy as np
import pytest

from terralith.llm import winnowing

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return _WORDS.findall(low)


def slow(docs, items, size=10):
    lists = [(i, words(t)) for i, t in items]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i, x in lists:
            n = min(size, len(x))
            if not n:
                continue
            windows = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    if i is not None:
                        found.add(i)
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = ["wort", "été", "a", "Ünï", "x9", "Lamp", "der", "hat", "漢字", "go"]
    phrase = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(phrase(n))) for i, n in enumerate([40, 12, 10, 10, 9, 7, 5, 3, 30, 25])]
    items += [(20, items[0][1]), (21, items[1][1].upper()), (22, None), (23, " ... "), (None, " ".join(phrase(11)))]
    docs = []
    for d in range(40):
        text = phrase(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            source = words(rng.choice(items)[1] or "")
            at = rng.randrange(len(source) + 1)
            cut = source[at : at + rng.randrange(1, 25)]
            where = rng.randrange(len(text) + 1)
            text[where:where] = cut
        docs.append((d, rng.choice([" ", ", ", "\n", "--"]).join(text)))
    docs += [(40, None), (41, ""), (42, "!!! ???"), (43, items[0][1]), (43, items[8][1]), (44, items[0][1]), (44, items[0][1]), (None, items[2][1])]
    docs += [(45, " ".join([items[0][1]] * 50 + phrase(3000) + [items[8][1]]))]
    return docs, items


@pytest.mark.parametrize("seed,piece", [(1, 1 << 20), (2, 200), (3, 37)])
def test_against_all_windows(spark, seed, piece):
    docs, items = planted(seed)
    df = spark.createDataFrame([(*r, 1, "s", 2, "w") for r in docs], "doc_id long, text string, th int, win string, n_words int, id string")
    bench = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, cls string")
    got = sorted(((r.id, r.n_words, r.n_hit, tuple(r.items)) for r in winnowing.contamination(df, bench, piece=piece).collect()), key=repr)
    assert got == slow(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in winnowing.contamination(docs, none).collect()] == [(1, 3, 0, [])]
    assert winnowing.contamination(docs.limit(0), spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 0


def test_every_span_of_a_window_shares_a_fingerprint():
    rng = np.random.default_rng(5)
    raw = lambda w: np.frombuffer(" ".join(w).encode(), np.uint8)
    span = [f"w{x}" for x in rng.integers(0, 50, 10)]
    alone = winnowing.Words(raw(span), np.zeros(1, np.int64)).windows(10, 5)[1][0]
    for at in range(30):
        around = [f"v{x}" for x in rng.integers(0, 9, 30)]
        begin, prints = winnowing.Words(raw(around[:at] + span + around[at:]), np.zeros(1, np.int64)).windows(10, 5)
        assert prints[begin.tolist().index(at)] == alone


def test_one_very_long_word_and_text(spark):
    long = "ab" * 300_000 + " " + " ".join(f"t{i % 97}" for i in range(50_000)) + " x"
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"t{(90 + i) % 97}" for i in range(10)))], "item_id long, text string")
    got = winnowing.contamination(docs, items, piece=4096).collect()[0]
    assert tuple(got) == slow([(1, long)], [(7, items.first().text)])[0][:3] + ([7],)
