"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of
documents of any size compare and merge, and the share of one sketch found in another estimates
containment however unequal the two are. Words are runs without white space, A-Z in lower case;
shingles have five words (a shorter text is one shingle). The smallest hash of a text is kept as
well, so that no text with a word has an empty sketch. ``merge`` keeps, of the hashes at or above
the threshold, the smallest only and that only if it is the smallest of all: the result is
exactly the sketch of the union of the two texts' shingles.

Hashing works on the bytes of many texts at once: a word's hash comes from polynomials over its
bytes modulo two primes, and a shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import table, text_or_empty
from terralith.llm.words import mix, word_digests

SHINGLE = 5
FRACTION = 1 / 8
#: Bytes of text of a range (a range is sorted with spills and read as a stream, not held).
RANGE_BYTES = 16 << 20
#: Ranges beyond which they grow instead (1 GB each at 100 TB), because their cuts pass the driver.
RANGES = 100_000
#: Keys looked at for each range when the cuts are placed (32 bytes each on the driver).
_KEYS_PER_RANGE = 20
#: A fingerprint stores the top 48 bits of each kept hash, big-endian, ascending, in base64.
_BYTES = 6
_SHIFT = np.uint64(64 - 8 * _BYTES)
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: bytes, piece: int = PIECE) -> np.ndarray:
    """Hashes of the words of one UTF-8 text, in order; a long text is read in pieces."""
    found, at = [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + piece) if at + piece < len(raw) else None
        end = gap.end() if gap else len(raw)
        found.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1))
    return word_digests(_LOWER[b], edges[::2], edges[1::2])


def sketch(words: np.ndarray, k: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct kept hashes (their top 48 bits) of the shingles of one text."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    shingles = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i]
    hashes = mix(shingles + np.uint64(size))
    return np.unique(_kept(hashes >> _SHIFT, fraction))


def _kept(hashes: np.ndarray, fraction: float) -> np.ndarray:
    """The hashes (top 48 bits) below the threshold, and the smallest one."""
    below = hashes < np.uint64(int(fraction * 2.0 ** (8 * _BYTES)))
    return hashes[below] if below.any() else hashes.min(keepdims=True)


def to_text(found: np.ndarray) -> str:
    return base64.b64encode(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BYTES)
    return np.pad(raw, ((0, 0), (8 - _BYTES, 0))).reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles (Jaccard); 1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 if ``a`` is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of the union of two texts' shingles, from their sketches alone."""
    both = np.union1d(a, b)
    return _kept(both, fraction) if len(both) else both


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(id, fingerprint) per row; null text is empty, an empty text has the fingerprint ''.

    Repeated rows give equal rows; other columns are not read; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [to_text(sketch(word_hashes((t or "").encode()), k, fraction)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fingerprint string")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range, doc_id, text, mark) to one row per document that has a follower."""
    before = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            out = []
            for where, key, text, mark in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                own = sketch(word_hashes(text.encode()))
                if before and before[0] == where:
                    _, key0, text0, own0 = before
                    new = _edited(text0, text)
                    changed = sketch(word_hashes(new.encode()))
                    out.append((key0, len(text0), hashlib.sha256(new.encode()).hexdigest(), to_text(own0), to_text(changed), likeness(own0, changed), likeness(own0, own)))
                before = None if mark else (where, key, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], _OUT)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and the next one's.

    Documents are ordered by id (null first), then by a hash of the text and the text; the last
    one is followed by the first. The order is cut into ranges of about ``range_bytes`` of text,
    one task sorts a range, and the first document of each range also goes, marked, to the end
    of the range before: whole texts are shuffled once, and only keys that place the cuts, some
    ``_KEYS_PER_RANGE`` a range, reach the driver. Documents with one id, or none, are spread by
    their text; only repeated rows stay together. Null text is empty. A single document follows
    itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    key = F.struct(F.col("doc_id").isNotNull().cast("long").alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", key.alias("key"))
    cuts = _cuts(src, range_bytes)
    listed = [F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in range(3)]
    number = _place(F.col("key"), listed, len(cuts)) if cuts else F.lit(0)
    ranged = src.withColumn("range", number.cast("int"))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("key", "doc_id", "text")).alias("d")).select("range", "d.key", "d.doc_id", "d.text")
    present = sorted(r["range"] for r in ranged.select("range").distinct().collect())
    if not present:
        return spark.createDataFrame([], _SCHEMA)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    moved = F.split(F.lit(",".join(str(before.get(r, -1)) for r in range(present[-1] + 1))), ",").cast("array<int>")
    marks = firsts.select(F.element_at(moved, F.col("range") + 1).alias("range"), "key", "doc_id", "text", F.lit(True).alias("mark"))
    together = ranged.select("range", "key", "doc_id", "text", F.lit(False).alias("mark")).unionByName(marks)
    # a key of each partition's own, so that no two ranges meet in one
    homes = _homes(spark, len(present))
    at = {r: homes[i] for i, r in enumerate(present)}
    home = F.element_at(F.split(F.lit(",".join(str(at.get(r, 0)) for r in range(present[-1] + 1))), ",").cast("array<int>"), F.col("range") + 1)
    placed = together.withColumn("home", home).repartition(len(present), "home").sortWithinPartitions("range", "mark", "key", "text")
    return placed.select("range", "doc_id", "text", "mark").mapInArrow(_compare, _SCHEMA)


def _cuts(src: DataFrame, range_bytes: int) -> list[tuple[int, int, int]]:
    """Keys that cut the order into ranges of about equal bytes, from keys drawn by their bytes."""
    size = F.octet_length("text").cast("double") + 64
    total = src.agg(F.sum(size)).first()[0] or 0.0
    ranges = min(RANGES, int(total // range_bytes) + 1)
    if ranges < 2:
        return []
    step = total / (ranges * _KEYS_PER_RANGE)
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = src.filter(chance * step < size).select("key.a", "key.b", "key.c", F.greatest(size, F.lit(step)).alias("w")).toArrow()
    a, b, c, w = (drawn.column(i).to_numpy() for i in range(4))
    order = np.lexsort((c, b, a))
    seen = np.cumsum(w[order]) - w[order] / 2
    at = order[np.minimum(np.searchsorted(seen, seen[-1] * np.arange(1, ranges) / ranges), len(order) - 1)]
    return sorted({(int(a[i]), int(b[i]), int(c[i])) for i in at})


def _homes(spark, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark's hash partitioning sends there."""
    found: dict[int, int] = {}
    size = 4 * n
    while len(found) < n:
        size *= 4
        rows = spark.range(size).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
        found = {r["p"]: r["k"] for r in rows.collect()}
    return [found[p] for p in range(n)]


def _place(key, cuts, n: int):
    """Number of cuts below ``key``, by a bisection unrolled into the plan."""

    def below(i):
        a, b, c = [F.element_at(x, i) for x in cuts]
        return (a < key["a"]) | ((a == key["a"]) & ((b < key["b"]) | ((b == key["b"]) & (c < key["c"]))))

    def advance(step):
        return lambda x: x + F.when((x + step <= n) & below(F.least(x + step, F.lit(n))), step).otherwise(0)

    low, step = F.lit(0), 1 << n.bit_length()
    while step := step // 2:
        # the array of one binds ``low`` to a name, so that each step evaluates it once
        low = F.element_at(F.transform(F.array(low), advance(step)), 1)
    return low


def op4_document_fingerprints(spark, sf_dir):
    """Contract query over all ``documents``."""
    return with_next(table(spark, sf_dir, "documents"))
