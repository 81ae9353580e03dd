import random

from terralith.llm import licenses as lc


def slow(text):
    """Exact search: best containment of each template in any window of 2L words every L words."""
    words = lc.words_of(text or "")
    out = {}
    for name, t in lc.TEMPLATES.items():
        grams = set(lc.shingles_of(lc.words_of(t)))
        size = lc.size_class(len(lc.words_of(t)))
        best = 0.0
        for at in range(0, max(1, len(words)), size):
            here = set(lc.shingles_of(words[at : at + 2 * size]))
            best = max(best, len(grams & here) / len(grams))
        if best >= lc.CONTAINMENT:
            out[name] = best
    return out


def test_anchors_are_necessary():
    marks = lc.anchors(lc.TEMPLATES)
    for t in lc.TEMPLATES.values():
        grams = lc.shingles_of(lc.words_of(t))
        assert sum(not set(g.split()) & marks for g in grams) < lc.CONTAINMENT * len(grams)


def texts():
    random.seed(7)
    filler = [f"word{i}" for i in range(50)] + ["license", "permission", "the", "version"]
    pad = lambda n: " ".join(random.choices(filler, k=n))
    out = [None, "", "license", "the MIT License", pad(3000)]
    for name, t in lc.TEMPLATES.items():
        out += [t, t.upper(), f"{pad(random.randint(0, 300))}\n * {t.replace(' ', chr(10) + ' * ', 3)} {pad(40)}", " ".join(t.split()[: len(t.split()) // 2])]
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(pad(20) + " " + " ".join(w))
    out.append(" ".join([lc.TEMPLATES["MIT-short"], pad(500)] * 30))
    return out


def test_scan_against_exact_search(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(5, texts()[5], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, at int")
    got = {}
    for r in lc.scan(df).collect():
        got.setdefault(r.id, {})[r.template] = r.containment
    want = {i: s for i, t, *_ in rows if (s := slow(t))}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lc.scan(df).count() == 0
    assert lc.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), templates={"none": " - "}).count() == 0


def test_query_against_exact_search(spark):
    rows = lc.op1_license_scan(spark, "/root/testdata/sf0.001").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        want = slow(docs[r.doc_id])
        assert (r.n_licenses, r.licenses, r.best) == (len(want), ",".join(sorted(want)), max(want.values(), default=0.0))
    assert sum(r.n_licenses for r in rows) > 0


#: As found in projects, not copied from the library.
FOREIGN = {
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-short"},
    "Text and pictures: licensed under CC-BY-NC-SA 3.0, see the site": {"CC-BY-NC-SA-3.0-short"},
    "<p>This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.</p>": {"CC-BY-NC-ND-4.0"},
    "-- This library is free software; you can redistribute it under the terms of the\n-- GNU Lesser General Public License as published by the Free Software\n"
    "-- Foundation; either version 2.1 of the License": {"LGPL-header", "LGPL-2.1-header"},
    "# This is free and unencumbered software released into the public domain.": {"Unlicense-short"},
    "All accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this": {"EPL-1.0-header"},
    "// you can use it under the terms of the GNU Affero General Public License\n// as published by the FSF": {"AGPL-header"},
    "# Released under the GNU General Public License, version 2 (see COPYING)": {"GPL-2.0-short"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0-short"},
}


def test_notices_from_elsewhere(spark):
    cases = list(FOREIGN.items())
    got = {i: set() for i in range(len(cases))}
    for r in lc.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect():
        got[r.id].add(r.template)
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_full_texts_are_found_in_files(spark):
    with open("/usr/share/common-licenses/GPL-2", encoding="utf-8") as f:
        gpl = f.read()
    other = "the and that this thing with from some prose " * 900
    rows = [(1, "int main;\n" + gpl.replace("\n", "\n * ") + other), (2, other), (3, gpl[: len(gpl) // 2] + other)]
    found = lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id for r in found if r.template == "GPL-2.0-text"} == {1} and all(r.id != 2 for r in found)


def test_windows_need_their_anchors():
    for size, (marks, need) in lc.class_anchors(lc.TEMPLATES).items():
        for t in lc.TEMPLATES.values():
            words = lc.words_of(t)
            if lc.size_class(len(words)) != size:
                continue
            free = sum(not set(g.split()) & marks for g in lc.shingles_of(words))
            assert need >= 1 and free + (need - 1) * lc.SHINGLE < lc.CONTAINMENT * len(lc.shingles_of(words))


def test_lines_of_the_table_have_a_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text like '%Licensed under CC BY-NC 4.0.%'")
    found = {r.id for r in lc.scan(docs).filter("template = 'CC-BY-NC-4.0-short'").collect()}
    assert found == {r.doc_id for r in docs.collect()} and found


def test_bands_reach_every_matching_window():
    """For each class, the stated loss at the least Jaccard similarity of a matching window."""
    bands = lc.class_bands(lc.TEMPLATES)
    for t in lc.TEMPLATES.values():
        words = lc.words_of(t)
        g, size = len(lc.shingles_of(words)), lc.size_class(len(words))
        c = next(c for c in range(g + 1) if c / g >= lc.CONTAINMENT)
        window = 2 * size - lc.SHINGLE + 1
        assert (1 - c / (g + window - c)) ** bands[size] <= lc.MISS


def test_every_offset_of_the_shortest_notice(spark):
    filler = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join([*filler[i : i + 40], "Released under the MIT License.", *filler[i + 40 : i + 80]])) for i in range(3000)]
    found = lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("template = 'MIT-short'")
    assert found.select("id").distinct().count() == 3000


def test_more_templates_than_are_broadcast(spark, monkeypatch):
    library = {f"T{i}": f"these are the terms number {i} of the old license number {i * 7} in force" for i in range(60)}
    rows = [(i, f"intro words {library[f'T{i}']} and so on") for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, cls int")
    want = sorted(map(tuple, lc.scan(df, library).collect()))
    monkeypatch.setattr(lc, "BROADCAST_TEMPLATES", 10)
    assert sorted(map(tuple, lc.scan(df, library).collect())) == want
    assert {(i, t) for i, t, _ in want} >= {(i, f"T{i}") for i in range(60)}
