"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding.

One narrow pass: a task splits its texts into words, folds the ranked merges over each word it
has not met before (all new words of a batch at once, against the rank table of token pairs),
and puts the documents' ids together from the words'. Decoding concatenates the byte pieces of
the ids. A task keeps at most ``Dictionary.LIMIT`` words, then starts anew, so memory is bounded,
nothing is shuffled and no vocabulary of the corpus travels anywhere.

``RankMap`` holds the same fold as Spark higher-order functions over a literal rank map
(``fold_words``), for tables of distinct words; it costs some hundred microseconds a word, too
much for the distinct words of every partition of a corpus (figures in the README), so the
corpus path folds in arrays. Spark's own map lookup scans its keys, so the literal rank map is
two arrays: a displaced hash table from XXH64 to rank, and the pieces by rank to confirm a hit.
Bytes are characters U+0000 to U+00FF inside that fold, because Spark splits and compares
strings faster than binaries.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import table
from terralith.llm.merges import MergeTable
from terralith.llm.words import PIECE, Batch, Dictionary, chunks, pieces

#: Bytes of a word from which it is folded with a heap (the fold over arrays is quadratic).
LONG_WORD = 256
_MISS = 1 << 30
_BUCKET_BITS, _SLOT_BITS = 14, 17


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: lowest rank first, leftmost on ties, in n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = [i + 1 for i in range(n)]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = []

    def push(i):
        j = after[i]
        if j >= 0 and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] > i else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i >= 0 and i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class RankMap:
    """The ranks as literal columns: hash displacements, rank by slot, piece by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        pieces = [""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        slots, buckets = 1 << _SLOT_BITS, 1 << _BUCKET_BITS
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        for rank, piece in enumerate(pieces):
            if piece:
                h = xxhash.xxh64_intdigest(piece.encode(), 42)
                groups[h & (buckets - 1)].append((h >> 20 & (slots - 1), h >> 44 & (slots - 1) | 1, rank))
        table_, shift = [0] * slots, [0] * buckets
        used = bytearray(slots)
        for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
            d = 0
            while groups[b]:
                at = [(x + d * y) & (slots - 1) for x, y, _ in groups[b]]
                if len(set(at)) == len(at) and not any(used[a] for a in at):
                    for a, (_, _, rank) in zip(at, groups[b], strict=True):
                        used[a], table_[a] = 1, rank
                    break
                d += 1
                if d > slots:
                    raise ValueError("no displacement fits; use more slots")
            shift[b] = d
        # split and cast of literals are folded into array literals before execution
        ints = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
        self.shift, self.slot_rank = ints(shift), ints(table_)
        self.pieces = F.split(F.lit("Ā".join(pieces)), "Ā")

    def ranks(self, keys: Column) -> Column:
        """Rank of every string of an array, ``_MISS`` where it has none."""

        def at(h):
            move = F.element_at(self.shift, h.bitwiseAND((1 << _BUCKET_BITS) - 1).cast("int") + 1)
            step = F.shiftrightunsigned(h, 44).bitwiseAND((1 << _SLOT_BITS) - 1).bitwiseOR(1)
            return F.element_at(self.slot_rank, (F.shiftrightunsigned(h, 20) + move * step).bitwiseAND((1 << _SLOT_BITS) - 1).cast("int") + 1)

        found = F.transform(F.transform(keys, lambda k: F.xxhash64(k)), at)
        return F.zip_with(found, keys, lambda r, k: F.when(F.element_at(self.pieces, r + 1) == k, r).otherwise(_MISS))

    def fold(self, word: Column) -> Column:
        """Ids of one word, given as a string of bytes: merges the best pair until none is left."""
        whole = F.element_at(self.ranks(F.array(word)), 1)
        pair = lambda parts: F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.concat(a, b))
        let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

        def merge(acc, _):
            parts, ranks = acc["parts"], acc["ranks"]

            def at(i):
                joined = F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
                left = F.when(i > 1, F.array(F.concat(F.element_at(parts, F.greatest(i - 1, F.lit(1))), joined))).otherwise(F.array().cast("array<string>"))
                more = i + 1 < F.size(parts)
                right = F.when(more, F.array(F.concat(joined, F.element_at(parts, F.least(i + 2, F.size(parts)))))).otherwise(F.array().cast("array<string>"))
                new = self.ranks(F.concat(left, right))
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), i - 1), F.array(joined), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(i - 2, F.lit(0))), new, F.slice(ranks, i + 2, F.size(parts))).alias("ranks"),
                )

            step = let(F.array_position(ranks, F.array_min(ranks)).cast("int"), at)
            return F.when(F.coalesce(F.array_min(ranks), F.lit(_MISS)) < _MISS, step).otherwise(acc)

        letters = F.split(word, "")
        start = F.struct(letters.alias("parts"), self.ranks(pair(letters)).alias("ranks"))
        parts = F.aggregate(F.sequence(F.lit(2), F.length(word)), start, merge, lambda acc: acc["parts"])
        return F.when(whole < _MISS, F.array(whole)).otherwise(self.ranks(parts))

    def decode(self, ids: Column) -> Column:
        """The byte string of an array of ids."""
        return F.array_join(F.transform(ids, lambda i: F.element_at(self.pieces, i + 1)), "")


def fold_words(words: DataFrame, ranks_path: str, word_col: str = "word") -> DataFrame:
    """(word, ids) of the distinct words of a table, by the fold in the plan; null words go."""
    rank_map = RankMap(_ranks(ranks_path))
    distinct = words.select(F.col(word_col).cast("string").alias("word")).filter("word is not null").distinct()
    as_bytes = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")
    ids = F.transform(F.array(as_bytes), lambda w: F.when(F.length(w) > 0, rank_map.fold(w)).otherwise(F.array().cast("array<int>")))
    return distinct.select("word", F.element_at(ids, 1).alias("ids"))


@cache
def _merge_table(path: str) -> MergeTable:
    return MergeTable.from_ranks(_ranks(path))


@cache
def _pieces(path: str) -> list[bytes]:
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


class _Folded:
    """Distinct words of a task: their ids as text, their bytes decoded from the ids, counts."""

    def __init__(self, path: str):
        self.words, self.id_text, self.raw, self.count = Dictionary(), [], [], []
        self._ranks, self._merges, self._pieces = _ranks(path), _merge_table(path), _pieces(path)

    def add(self, fresh: list[str]) -> None:
        raw = [w.encode() for w in fresh]
        known = [self._ranks.get(w) for w in raw]
        folded = [w if r is None and len(w) <= LONG_WORD else b"" for w, r in zip(raw, known, strict=True)]
        flat, sizes = self._merges.encode(folded)
        listed, at = flat.tolist(), 0
        piece = self._pieces.__getitem__
        for word, rank, size in zip(raw, known, sizes.tolist(), strict=True):
            ids = [rank] if rank is not None else listed[at : at + size] if size else heap_encode(word, self._ranks)
            at += size
            self.id_text.append(",".join(map(str, ids)).encode())
            self.raw.append(b"".join(map(piece, ids)))
            self.count.append(len(ids))


def _assemble(ranks_path: str, make, make_long):
    """Map over (id, text) batches that hands ``make`` the documents' words: ids, bytes, counts.

    A long text goes to ``make_long`` alone, as (codes, ids, bytes, counts) piece by piece.
    """

    def run(batches):
        held = _Folded(ranks_path)

        def coded(block):
            nonlocal held
            if held.words.full():
                held = _Folded(ranks_path)
            codes, fresh = held.words.number(block)
            held.add(fresh)
            return codes, held.id_text, held.raw, held.count

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for part in chunks(texts):
                if len(part) == 1 and len(part[0]) > PIECE:
                    yield make_long(keys[at], (coded(Batch([x])) for x in pieces(part[0])))
                else:
                    block = Batch(part)
                    yield make(keys[at : at + len(part)], block.bounds, *coded(block))
                at += len(part)

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _digests(keys, bounds, codes, id_text, raw, count):
    sizes = np.array(count or [0])[codes] if len(codes) else np.zeros(0, int)
    total = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    listed, n, ids_sha, back_sha = codes.tolist(), [], [], []
    for i in range(len(keys)):
        words = listed[bounds[i] : bounds[i + 1]]
        n.append(int(total[i + 1] - total[i]))
        ids_sha.append(hashlib.sha256(b",".join(map(id_text.__getitem__, words))).hexdigest())
        back_sha.append(hashlib.sha256(b"".join(map(raw.__getitem__, words))).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _digest_long(key, parts):
    ids_sha, back_sha, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
    for codes, id_text, raw, count in parts:
        words = codes.tolist()
        ids_sha.update((b"" if first else b",") + b",".join(map(id_text.__getitem__, words)))
        back_sha.update(b"".join(map(raw.__getitem__, words)))
        n, first = n + sum(map(count.__getitem__, words)), False
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([ids_sha.hexdigest()]), pa.array([back_sha.hexdigest()])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_list_long(key, parts):
    found = [np.array([int(x) for w in codes.tolist() for x in id_text[w].split(b",")], np.int32) for codes, id_text, _, _ in parts]
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.concatenate(found)], pa.list_(pa.int32()))], ["id", "tokens"])


def _id_lists(keys, bounds, codes, id_text, _raw, _count):
    listed = codes.tolist()
    lists = [[int(x) for w in listed[bounds[i] : bounds[i + 1]] for x in id_text[w].split(b",")] for i in range(len(keys))]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["id", "tokens"])


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens): the token ids of every text, one row per row of ``docs``.

    Null and empty texts have no tokens; repeated rows give equal rows; other columns are not
    read; an empty table gives an empty result. Marks of special tokens are ordinary text.
    """
    return _source(docs, id_col, text_col).mapInArrow(_assemble(ranks_path, _id_lists, _id_list_long), "id long, tokens array<int>")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, bytes): the concatenated pieces of every array of token ids; null stays null.

    An id outside the vocabulary is an error.
    """
    text = RankMap(_ranks(ranks_path)).decode(F.col(tokens_col))
    return tokens.select(F.col(id_col).alias("id"), F.encode(text, "ISO-8859-1").alias("bytes"))


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, digest of the ids and digest of the decoded bytes."""
    return _source(docs, id_col, text_col).mapInArrow(
        _assemble(ranks_path, _digests, _digest_long), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe(spark, sf_dir):
    """Contract query over all ``documents``."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
