"""Benchmark decontamination by winnowing: minimum k-gram hashes, a join of fingerprints, hits extended to whole windows.

A window is ``WINDOW`` = 10 consecutive words of an item (all words of a shorter item). Its
fingerprint is the smallest hash among its six five-word grams (of an item under five words: the
hash of all its words). The choice depends on the window's words alone, so every span of ten
words that a document shares with an item has the same fingerprint on both sides: nothing is
missed. Documents are winnowed the same way. A bitmap of ``FILTER_BITS`` bits, of fixed size
whatever the benchmark holds, lets go of windows whose fingerprint no item has. What passes is
joined with the items' windows on the fingerprint and, as the extension of the hit from the gram
to its window, on the window's words themselves, so that a hash never decides.

The join meets distinct windows, and items of equal words are one class with a list of ids:
copies on either side multiply nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import stored, table
from terralith.llm.words import mix, slice_hashes

WINDOW = 10
GRAM = 5
FILTER_BITS = 24
#: Bytes of text worked on at once; longer texts are cut between words.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a run of bytes that holds one or more texts, in lower case."""

    def __init__(self, raw: np.ndarray, doc_starts: np.ndarray):
        self.low = _LOWER[raw]
        inside = _WORD[self.low]
        edge = np.zeros(len(raw) + 1, bool)
        edge[0] = edge[len(raw)] = True
        edge[doc_starts] = True
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(doc_starts, self.starts, "right") - 1
        self.hashes = slice_hashes(self.low, self.starts, self.ends)

    def windows(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every run of ``length`` words within one text."""
        k, n = min(gram, length), len(self.starts) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = np.zeros(len(self.starts) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * _BASE + self.hashes[j : j + len(grams)]
        grams = mix(grams + np.uint64(length))
        least = grams[:n].copy()
        for j in range(1, length - k + 1):
            np.minimum(least, grams[j : j + n], out=least)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return at, least[at].view(np.int64)

    def text(self, at: int, length: int) -> str:
        flat = self.low
        return b" ".join(flat[a:b].tobytes() for a, b in zip(self.starts[at : at + length], self.ends[at : at + length])).decode("utf-8", "replace")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _runs(data: np.ndarray, at: np.ndarray, piece: int, overlap: int) -> Iterator[tuple[int, Words, int, int]]:
    """(first text, its words, index of their first word, words seen before) for runs of texts.

    Short texts come many at once; a text of more than ``piece`` bytes comes in pieces that are
    cut between words and share ``overlap`` words.
    """
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] <= piece:
            j = int(np.searchsorted(at, at[i] + piece, "right")) - 1
            j = max(i + 1, min(j, n))
            yield i, Words(data[at[i] : at[j]], at[i:j] - at[i]), 0, 0
            i = j
            continue
        begin, end, seen, shared = int(at[i]), int(at[i + 1]), 0, 0
        cut = begin
        while cut < end:
            gap = _GAP.search(data, min(cut + piece, end), end) if cut + piece < end else None
            cut = gap.end() if gap else end
            found = Words(data[begin:cut], np.zeros(1, np.int64))
            yield i, found, seen - shared, shared
            seen += len(found.starts) - shared
            shared = min(overlap, len(found.starts))
            begin = begin + int(found.starts[-shared]) if shared else cut
        i += 1


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(classes, windows) of the items.

    classes(cls, ids): items of equal words, by a digest of the words, with their ids.
    windows(len, fp, win, cls): every window of every class. Null texts and texts without a word
    have none; items without an id have windows but add no id.
    """

    def normal(batches):
        for batch in batches:
            data, at = _bytes_of(batch.column(1))
            texts = []
            for i in range(batch.num_rows):
                found = Words(data[at[i] : at[i + 1]], np.zeros(1, np.int64))
                texts.append(found.text(0, len(found.starts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["item", "words"])

    def cut(batches):
        for batch in batches:
            out = {"len": [], "fp": [], "win": [], "cls": []}
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Words(np.frombuffer(words.encode("utf-8", "surrogatepass"), np.uint8), np.zeros(1, np.int64))
                length = min(window, len(found.starts))
                for i, fp in zip(*(x.tolist() for x in found.windows(length, gram))):
                    for key, value in (("len", length), ("fp", fp), ("win", found.text(i, length)), ("cls", name)):
                        out[key].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["len"], pa.int32()), pa.array(out["fp"], pa.int64()), pa.array(out["win"], pa.string()), pa.array(out["cls"], pa.string())], list(out))

    src = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    words = src.mapInArrow(normal, "item long, words string").filter("words <> ''")
    classes = words.groupBy(F.sha2("words", 256).alias("cls"), "words").agg(F.collect_set("item").alias("ids"))
    windows = classes.select("cls", "words").mapInArrow(cut, "len int, fp long, win string, cls string").distinct()
    return classes.select("cls", "ids"), windows


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the first ``FILTER_BITS`` bits of a fingerprint: 2 MB, whatever the benchmark holds."""
    row, bit = F.shiftrightunsigned("fp", 64 - FILTER_BITS + 6), F.shiftrightunsigned("fp", 64 - FILTER_BITS).bitwiseAND(F.lit(63))
    marks = windows.select(row.alias("row"), F.expr("1L").alias("one"), bit.cast("int").alias("bit")).groupBy("row").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[marks.column("row").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    return words


def candidates(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """(id, th, n_words, found) for every row of ``docs``: found holds the windows whose fingerprint may be an item's.

    th, a hash of the text, tells rows apart that carry one id with different texts.
    """
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    marks = spark.sparkContext.broadcast(_bitmap(windows))
    overlap = max(lengths, default=1) - 1

    def run(batches):
        bits = marks.value
        for batch in batches:
            data, at = _bytes_of(batch.column(2))
            n_words, owner = np.zeros(batch.num_rows, np.int64), []
            out = {"s": [], "len": [], "fp": [], "win": []}
            for i, words, base, shared in _runs(data, at, piece, overlap):
                counts = np.bincount(words.doc, minlength=1) if len(words.doc) else np.zeros(1, np.int64)
                n_words[i : i + len(counts)] += counts
                n_words[i] -= shared
                first = np.cumsum(counts) - counts
                for length in lengths:
                    begin, fp = words.windows(length, gram)
                    u = fp.view(np.uint64)
                    hit = bits[u >> np.uint64(64 - FILTER_BITS + 6)] >> ((u >> np.uint64(64 - FILTER_BITS)) & np.uint64(63)) & np.uint64(1) == 1
                    for b, f in zip(begin[hit].tolist(), fp[hit].tolist()):
                        d = words.doc[b]
                        owner.append(i + d)
                        out["s"].append(base + b - first[d])
                        out["len"].append(length)
                        out["fp"].append(f)
                        out["win"].append(words.text(b, length))
            owner = np.array(owner, np.int64)
            order = np.argsort(owner, kind="stable")
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=batch.num_rows), out=offsets[1:])
            found = pa.StructArray.from_arrays([pa.array(out["s"], pa.int64()), pa.array(out["len"], pa.int32()), pa.array(out["fp"], pa.int64()), pa.array(out["win"], pa.string())], list(out)).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.ListArray.from_arrays(pa.array(offsets), found)], ["id", "th", "n_words", "found"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, th long, n_words long, found array<struct<s:long,len:int,fp:long,win:string>>")


def hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, th, s, len, win): the windows of documents that are windows of items, once each."""
    placed = found.select("id", "th", F.explode("found").alias("x")).select("id", "th", "x.s", "x.len", "x.fp", "x.win").distinct()
    return placed.join(windows.select("len", "fp", "win").distinct(), ["len", "fp", "win"]).select("id", "th", "s", "len", "win")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """(id, n_words, n_hit, items) for every row of ``docs``; items is the sorted array of the ids of all items found.

    Null, empty and wordless texts have no words and no hits; such items are never found. Equal
    rows give equal rows; rows of one id with different texts are judged each by its text; a
    null id is an id like any other. Items of equal words are all reported; an item without an
    id marks words and adds no id. Texts of any length are read whole, in pieces. Further
    columns are not read, whatever their names. An empty benchmark hits nothing, an empty table
    of documents gives no rows. The list of one document holds all ids of all items it quotes.
    """
    spark = docs.sparkSession
    classes, windows = benchmark_windows(items, item_id_col, item_text_col, window, gram)
    classes, _ = stored(classes)
    windows, _ = stored(windows.coalesce(8))
    base, _ = stored(candidates(docs, windows, id_col, text_col, gram, piece))
    found, _ = stored(hits(base, windows))

    before = Window.partitionBy("id", "th").orderBy("s", F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("s") + F.col("len")
    spans = found.groupBy("id", "th", "s").agg(F.max("len").alias("len")).select("id", "th", end.alias("e"), F.greatest("s", F.coalesce(F.max(end).over(before), F.lit(0))).alias("from"))
    marked = spans.groupBy("id", "th").agg(F.sum(F.greatest(F.col("e") - F.col("from"), F.lit(0))).alias("n_hit"))
    named = found.select("id", "th", "len", "win").distinct().join(windows.select("len", "win", "cls"), ["len", "win"]).select("id", "th", "cls").distinct()
    named = named.join(classes, "cls").groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    per = marked.join(named, marked["id"].eqNullSafe(named["id"]) & (marked["th"] == named["th"]), "left").select(marked["id"].alias("i"), marked["th"].alias("t"), "n_hit", "items")
    out = base.select("id", "th", "n_words").join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    none = F.array().cast("array<bigint>")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def op12_benchmark_decontamination(spark, sf_dir):
    """Contract query over all ``documents`` and the whole ``benchmark``."""
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The contract word by word: all windows of all texts.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM words),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS win
        FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, unnest(range(1, n - l + 2)) AS s, unnest(list_transform(range(1, n - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' '))) AS win FROM d, lens WHERE n >= l),
hit AS (SELECT doc_id, l, s, win FROM dw SEMI JOIN win USING (l, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN win USING (l, win)) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
