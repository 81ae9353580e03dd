"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints within ``DISTANCE`` = 2 bits agree on at least two of four 16-bit blocks, so six
tables keyed by two blocks each find every close pair. Equal fingerprints are one node from the
start, which takes groups of exact copies out of every join. A block bucket is compared pair by
pair only up to ``BUCKET`` members; a larger one is resolved exactly and in linear time: each
member visits the fingerprints one bit away from it inside the free bits of its large buckets,
two members within two bits meet at one of those, and a meeting point has at most 65 members,
because fingerprints are distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import few_files, free_name, materialise, table
from terralith.llm.components import connected_components

DISTANCE = 2
SHINGLE = 3
BUCKET = 48
_BLOCKS = 4
_WIDTH = 64 // _BLOCKS
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint_bytes(text: bytes, k: int = SHINGLE, piece: int = PIECE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned 64-bit number (0 if it has no word).

    Long texts are read in pieces of about ``piece`` bytes cut at white space, so that a text's
    words are never all held at once.
    """
    ones, m, last = np.zeros(64, np.int64), 0, []
    at, size = 0, len(text)
    while at < size:
        gap = _GAP.search(text, at + piece) if at + piece < size else None
        end = gap.end() if gap else size
        words = last + text[at:end].lower().split()
        at = end
        if len(words) >= k:
            hashes = _shingle_hashes(words, k)
            ones += _bit_sums(hashes)
            m += len(hashes)
            last = words[len(words) - k + 1 :]
        else:
            last = words
    if not m and last:
        ones, m = _bit_sums(np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    flat = b" ".join(words)
    starts = [0, *(ends[: n - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(flat[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = [fingerprint_bytes((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                signed = np.array(fps, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed)], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _mask(blocks: tuple[int, ...]) -> int:
    bits = 0
    for b in blocks:
        bits |= ((1 << _WIDTH) - 1) << (b * _WIDTH)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within two bits.

    ``fps``: one column fp of distinct longs. Every edge is checked by Hamming distance.
    """
    if distance != 2:
        raise ValueError("four blocks and one-bit meeting points serve a distance of two")
    tables = list(combinations(range(_BLOCKS), 2))
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("key")) for t, c in enumerate(tables)])).alias("k"),
    ).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(sizes, ["t", "key"])

    small = members.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))

    # blocks (as bits) that are free in some large bucket of the fingerprint
    free = F.array(*[F.lit(sum(1 << x for x in range(_BLOCKS) if x not in c)) for c in tables])
    large = members.filter(F.col("n") > bucket).groupBy("fp").agg(F.bit_or(F.element_at(free, F.col("t") + 1)).alias("free"))
    flips = F.array(F.struct(F.lit((1 << _BLOCKS) - 1).alias("of"), F.lit(0).cast("long").alias("bit")),
                    *[F.struct(F.lit(1 << i // _WIDTH).alias("of"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long").alias("bit")) for i in range(64)])
    points = large.select("fp", "free", F.explode(flips).alias("x")).filter(F.col("free").bitwiseAND(F.col("x.of")) != 0)
    # sorted rows instead of arrays: the smallest fingerprint of a point is the centre of its star
    meet = points.select(F.col("fp").alias("b"), F.col("fp").bitwiseXOR(F.col("x.bit")).alias("point"))
    stars = meet.select(F.min("b").over(Window.partitionBy("point")).alias("a"), "b").filter("a <> b")

    found = pairs.unionByName(stars)
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, fp, component_id).

    component_id is the smallest id reachable by links of at most two bits. Null and empty
    texts have fingerprint zero and link like any other; repeated rows and ties give equal
    rows; null ids take part in no group and have a null component; an empty table gives none.
    """
    fps = materialise(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    links = connected_components(fingerprint_links(nodes.select("fp")), rows=fps.count())
    rooted = nodes.join(links, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select(F.col("fp").alias("f"), "component_id")
    out = fps.join(by_fp, F.col("fp") == F.col("f"), "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, once each, all columns kept.

    Rows that carry one id several times shrink to one of them; rows without an id stay.
    """
    found = simhash_groups(docs, id_col, text_col).filter("id is not null")
    groups = materialise(few_files(found, docs.count()))
    key = free_name(docs, "key")
    gone = groups.filter("id <> component_id").select(F.col("id").alias(key)).distinct()
    kept = docs.join(gone, docs[id_col] == gone[key], "left_anti")
    again = groups.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias(key))
    if again.isEmpty():
        return kept
    single = kept.join(again, kept[id_col] == again[key], "left_semi").dropDuplicates([id_col])
    return kept.join(again, kept[id_col] == again[key], "left_anti").unionByName(single)


def op6_simhash_near_dedup(spark, sf_dir):
    """Contract query over all ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = simhash_groups(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
