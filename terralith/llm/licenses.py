"""License scans with Spark expressions only: MinHash bands over windows, exact containment.

Words are runs of letters and digits in lower case, shingles have ``SHINGLE`` words (a shorter
template is one shingle). Templates fall into classes by length: a class of ``L`` words holds
templates of L/2 to L words, and its windows have 2L words and start every L words, so that
every passage of up to L words lies whole in a window. A passage that holds ``CONTAINMENT`` of a
template's g shingles, c of them, then has a Jaccard similarity J of at least c / (g + 2L - 4 - c)
with its window: 1/12 for templates of five words, about 0.16 and more for long ones. Bands have
one row each, and a class has so many of them that (1 - J)**bands is at most ``MISS`` for each of
its templates (``class_bands``). What meets is verified by exact containment.

Windows that cannot match are not hashed: from every template, words are chosen such that the
shingles without any of them fall short of ``CONTAINMENT``; a window without one of these anchor
words cannot reach it. Long templates get so many anchors that their windows need several: one
occurrence lies in ``SHINGLE`` shingles at most, so ``least_anchors`` occurrences are needed for
what the shingles without an anchor leave to ``CONTAINMENT``. This drops no match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import table, text_or_empty
from terralith.llm.license_library import notices, texts

SHINGLE = 5
CONTAINMENT = 0.8
#: Most probable loss of a matching window.
MISS = 1e-6
#: Libraries of up to so many templates are broadcast with their bands; larger ones are joined.
BROADCAST_TEMPLATES = 2000
#: Templates of this many words or more take anchors until FREE of their shingles are without one.
LONG = 128
FREE = 0.3
#: Words too common in plain English to be good anchors; long templates never take them.
COMMON = frozenset(
    "a about all also an and any are as at be been but by can do each for from had has have he her his i if in into is it its may more most must no not of on one only or other"
    " our out over shall she should so some such than that the their them then there these they this those to under up us was we were what when where which who will with would you your".split()
)
#: Well-known notices (fixed values); the library adds further notices and full texts.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-short": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ' (the "Software"), to deal in the Software without restriction',
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    **notices(),
    **texts(),
}
_WORD = r"[\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    """Words of a template, as the plan takes them from texts."""
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    return sorted({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}) if words else []


def size_class(n: int) -> int:
    """Length class of a template of ``n`` words: the power of two at or above it, 8 at least."""
    return max(8, 1 << (n - 1).bit_length())


def class_bands(library: dict[str, str]) -> dict[int, int]:
    """By length class: the number of bands that its least similar matching window needs."""
    found: dict[int, int] = {}
    for t in library.values():
        size, g = size_class(len(words_of(t))), len(shingles_of(words_of(t)))
        c = math.ceil(CONTAINMENT * g - 1e-9)
        j = c / (g + 2 * size - SHINGLE + 1 - c)
        found[size] = max(found.get(size, 1), math.ceil(math.log(MISS) / math.log(1 - j)) if j < 1 else 1)
    return found


def anchors(templates: dict[str, str]) -> set[str]:
    """Words of which every sufficient share of any template's shingles holds one, rarest first."""
    spread: dict[str, int] = {}
    for t in templates.values():
        for w in set(words_of(t)):
            spread[w] = spread.get(w, 0) + 1
    chosen: set[str] = set()
    for _, t in sorted(templates.items()):
        grams = [set(g.split(" ")) for g in shingles_of(words_of(t))]
        free = [g for g in grams if not g & chosen]
        while len(free) >= CONTAINMENT * len(grams):
            gain = {w: sum(w in g for g in free) for w in set().union(*free)}
            best = max(gain, key=lambda w: (w not in COMMON, len(w) > 3, gain[w], spread[w], w))
            chosen.add(best)
            free = [g for g in free if best not in g]
    return chosen


def class_anchors(library: dict[str, str]) -> dict[int, tuple[set[str], int]]:
    """By length class: its anchor words, and how many of them a matching window holds."""
    classes: dict[int, dict[str, str]] = {}
    for name, t in library.items():
        classes.setdefault(size_class(len(words_of(t))), {})[name] = t
    found = {}
    for size, members in sorted(classes.items()):
        chosen = _long_anchors(members) if size >= LONG else set()
        needs = [least_anchors(t, chosen) for t in members.values()]
        if min(needs) < 1:
            chosen = anchors(members)
            needs = [least_anchors(t, chosen) for t in members.values()]
        found[size] = (chosen, min(needs))
    return found


def _long_anchors(members: dict[str, str]) -> set[str]:
    chosen: set[str] = set()
    for _, t in sorted(members.items()):
        grams = [set(g.split(" ")) for g in shingles_of(words_of(t))]
        free = [g for g in grams if not g & chosen]
        while len(free) > FREE * len(grams):
            gain: dict[str, int] = {}
            for g in free:
                for w in g - COMMON:
                    gain[w] = gain.get(w, 0) + (len(w) > 3)
            if not any(gain.values()):
                break
            chosen.add(max(gain, key=lambda w: (gain[w], w)))
            free = [g for g in free if not g & chosen]
    return chosen


def least_anchors(text: str, chosen: set[str]) -> int:
    """Occurrences of anchors without which no window reaches ``CONTAINMENT`` of ``text``."""
    grams = shingles_of(words_of(text))
    free = sum(not set(g.split(" ")) & chosen for g in grams)
    if free >= CONTAINMENT * len(grams):
        return 0
    lacking = math.ceil(CONTAINMENT * len(grams) - 1e-9) - free
    return max(1, math.ceil(lacking / SHINGLE))


def _shingles(words: Column, k: int = SHINGLE) -> Column:
    count = F.greatest(F.size(words) - k + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))


def _bands(rows: DataFrame, grams: str, bands: dict[int, int]) -> DataFrame:
    """With ``__m``, the smallest hash over the shingles for each band of the row's class ``cls``."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(bands.items()) for x in kv]), F.col("cls"))
    hashed = rows.withColumn("__h", F.transform(grams, lambda g: F.xxhash64(g)))
    least = F.transform(F.sequence(F.lit(1), number), lambda b: F.array_min(F.transform("__h", lambda h: F.xxhash64(h, b))))
    return hashed.withColumn("__m", least).drop("__h")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, containment): the templates found in each row's text, best window each.

    Null and empty texts hold nothing; repeated rows are one; a template without words is
    ignored; other columns are not read; an empty table, or no templates, gives none. Any number
    of templates is taken: up to ``BROADCAST_TEMPLATES`` they are broadcast, beyond joined.
    """
    spark = docs.sparkSession
    library = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if words_of(v)}
    schema = f"id {dict(docs.dtypes)[id_col]}, template string, containment double"
    if not library:
        return spark.createDataFrame([], schema)
    small = F.broadcast if len(library) <= BROADCAST_TEMPLATES else lambda df: df
    bands = class_bands(library)
    known = spark.createDataFrame([(k, size_class(len(words_of(v))), shingles_of(words_of(v))) for k, v in sorted(library.items())], "template string, cls int, grams array<string>")
    by_class = class_anchors(library)
    marks = sorted(set().union(*[m for m, _ in by_class.values()]))
    guard = "(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, marks)) + ")(?![\\p{L}\\p{N}])"

    src = docs.select(F.col(id_col).alias("id"), F.lower(text_or_empty(text_col)).alias("text")).filter(F.col("text").rlike(guard))
    worded = src.select("id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(marks), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    found = worded.select("id", "words", hits.alias("hits"))
    spans = []
    for size, (chosen, need) in by_class.items():
        at = F.transform(F.filter("hits", _one_of(sorted(chosen))), lambda h: h["i"])
        spans.append(F.transform(_window_starts(at, size, need), _window(size)))
    windows = found.select("id", F.explode(F.concat(*spans)).alias("w")).select("id", "w.cls", _shingles(F.col("w.words")).alias("grams"))
    # equal windows of a text are told by two hashes, 128 bits together
    windows = windows.select("id", "cls", "grams", F.struct(F.xxhash64("grams").alias("a"), F.xxhash64(F.lit("window"), "grams").alias("b")).alias("same"))
    # a fixed number of partitions: little data but much work, which Spark would merge into few tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = windows.repartition(parts, "id", "cls", "same").dropDuplicates(["id", "cls", "same"])
    banded = _bands(windows, "grams", bands).select("id", "cls", "same", "grams", F.col("__m").alias("mins"))
    targets = _bands(known, "grams", bands).select("template", F.col("cls").alias("c2"), F.posexplode("__m").alias("band", "value"))
    targets = targets.groupBy("c2", "band", "value").agg(F.collect_set("template").alias("templates"))
    probes = banded.select("id", "cls", "same", "grams", F.posexplode("mins").alias("band", "value"))
    met = probes.join(small(targets), (F.col("cls") == F.col("c2")) & (probes["band"] == targets["band"]) & (probes["value"] == targets["value"]))
    pairs = met.select("id", "cls", "same", "grams", F.explode("templates").alias("template")).dropDuplicates(["id", "cls", "same", "template"])
    checked = pairs.join(small(known.select(F.col("template").alias("t2"), F.col("grams").alias("tg"))), F.col("template") == F.col("t2"))
    score = F.size(F.array_intersect("tg", "grams")) / F.size("tg")
    return checked.select("id", "template", score.alias("c")).filter(F.col("c") >= CONTAINMENT).groupBy("id", "template").agg(F.max("c").alias("containment"))


def _one_of(chosen: list[str]):
    return lambda h: h["w"].isin(chosen)


def _window_starts(at: Column, size: int, need: int) -> Column:
    """Numbers of the windows of ``2 * size`` words, one every ``size``, that hold ``need`` anchors."""
    block = F.transform(at, lambda i: F.floor(i / size).cast("int"))
    if need == 1:
        return F.array_distinct(F.flatten(F.transform(block, lambda n: F.array(F.greatest(n - 1, F.lit(0)), n))))
    # the numbers rise, so a window holds `need` anchors if some anchor and the one need - 1 further lie in its two blocks
    ends = F.zip_with(block, F.slice(block, F.lit(need), F.greatest(F.size(block) - need + 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = F.filter(ends, lambda x: x["b"] - x["a"] <= 1)
    starts = F.transform(near, lambda x: F.when(x["a"] == x["b"], F.array(F.greatest(x["a"] - 1, F.lit(0)), x["a"])).otherwise(F.array(x["a"])))
    return F.array_distinct(F.flatten(starts))


def _window(size: int):
    return lambda n: F.struct(F.lit(size).alias("cls"), F.slice("words", n * size + 1, F.lit(2 * size)).alias("words"))


def op1_license_scan(spark, sf_dir):
    """All ``documents``: doc_id, n_licenses, licenses (names, comma-joined), best containment."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs).groupBy("id").agg(F.array_sort(F.collect_list("template")).alias("names"), F.max("containment").alias("best"))
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    return out.select(
        "doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"),
    )


def _oracle() -> str:
    """Exact search of every window, without bands or anchors, as DuckDB SQL."""
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        grams = ", ".join(f"'{g}'" for g in shingles_of(words_of(text)))
        rows.append(f"('{name}', {size_class(len(words_of(text)))}, [{grams}])")
    return f"""
WITH t(template, cls, grams) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents),
n AS (SELECT doc_id, cls, words, unnest(range(0, greatest(1, ceil(len(words) / cls))::BIGINT)) AS i FROM w, (SELECT DISTINCT cls FROM t)),
x AS (SELECT doc_id, cls, words[i * cls + 1 : i * cls + 2 * cls] AS ws FROM n),
g AS (SELECT doc_id, cls, list_distinct(list_transform(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1), lambda k: array_to_string(ws[k : k + {SHINGLE - 1}], ' '))) AS grams FROM x),
m AS (SELECT doc_id, template, max(len(list_intersect(t.grams, g.grams)) / len(t.grams)) AS c FROM g JOIN t USING (cls) GROUP BY 1, 2),
f AS (SELECT doc_id, count(*) AS n, string_agg(template, ',' ORDER BY template) AS names, max(c) AS best FROM m WHERE c >= {CONTAINMENT} GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(best, 0.0)::DOUBLE AS best FROM documents LEFT JOIN f USING (doc_id)
"""


ORACLE_SQL = _oracle()
