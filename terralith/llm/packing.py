"""Packing documents into token sequences with a controlled mixture of sources.

Every source is a queue of tokens. Deficit round-robin serves the queues in quanta of
``QUANTUM`` tokens: each round credits a queue with its share of the window, a queue is served
while its credit covers a quantum, and what is left carries over to the next window. Served
this way, quantum k of a queue with weight w is due at the credit time (k + 1) / w, and the
whole schedule is the quanta of all queues in the order of their due times. The place of a
quantum is therefore a count that needs the queues' weights only, so deficits carry across
windows and partitions without any task waiting for another one: a document needs its start in
its queue (a running count inside its partition plus the sum of the partitions before) and
finds the windows of its pieces by itself. No queue, however large, meets in one task.

That count loops over the queues, so it serves up to ``QUEUES`` of them. With more, the quanta
themselves are rows (one for 256 tokens): they are sorted by due time in ranges, the place of a
quantum is its number in that order, and pieces find it by a join on queue and quantum. Queues
are then rows of a table everywhere; neither the driver nor a task holds them all.

Windows are filled completely; the less than a quantum that each queue has left goes to the
last windows, so the corpus has one partial window at most.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import materialise, table
from terralith.llm.merges import MergeTable
from terralith.llm.words import PIECE, Batch, Dictionary, Ragged, chunks, pieces

WINDOW = 2048
QUANTUM = 256
END_ID = 1
LONG_WORD = 256
#: Rows of (partition, queue) offsets up to which they are broadcast (24 bytes each).
BROADCAST_ROWS = 200_000
#: Queues up to which every task works out places from all queues' weights.
QUEUES = 256
#: Weights are whole numbers that sum to this; more than 256 queues take a finer scale, up to
#: 2^31, so that a due time's remainder times 2^32 still is a long.
_WEIGHT_SCALE = 1 << 20


def weight_scale(queues: int) -> int:
    """What the weights of so many queues sum to, about."""
    return _WEIGHT_SCALE << min(11, max(0, (queues - 1).bit_length() - 8))



@cache
def _merge_table(path: str) -> MergeTable:
    return MergeTable.from_json(path)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> list[str]:
    """Contents of the file's added tokens, which the library finds in texts before it splits them."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


class Encoder:
    """Token ids of texts, each distinct word encoded once per task.

    A text that quotes one of the file's added tokens is encoded by the library alone.
    """

    def __init__(self, path: str):
        self._merges, self._path = _merge_table(path), path
        self._words, self._ids, self._marks = Dictionary(), Ragged(np.int64), _added(path)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(_tokenizer(self._path).encode(text, add_special_tokens=False).ids, np.int64)

    def _add(self, fresh: list[str]) -> None:
        raw = [w.encode() for w in fresh]
        long = [i for i, w in enumerate(raw) if len(w) > LONG_WORD]
        if not long:
            return self._ids.extend(*self._merges.encode(raw))
        for i in long:
            raw[i] = b""
        flat, sizes = self._merges.encode(raw)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for i in long:
            parts[i] = self._by_library(fresh[i])
        self._ids.extend(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))

    def _gathered(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of the batch in a row, their numbers by word)."""
        if self._words.full():
            self._words, self._ids = Dictionary(), Ragged(np.int64)
        numbers, fresh = self._words.number(batch)
        if fresh:
            self._add(fresh)
        return self._ids.gather(numbers)

    def _piece(self, text: str) -> np.ndarray:
        return self._gathered(Batch([text]))[0].astype(np.uint32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a long text is read in pieces."""
        for part in chunks(texts):
            if len(part) == 1 and len(part[0]) > PIECE and not any(m in part[0] for m in self._marks):
                yield np.concatenate([self._piece(x) for x in pieces(part[0])])
                continue
            quoting = {i for i, t in enumerate(part) if any(m in t for m in self._marks)}
            batch = Batch(["" if i in quoting else t for i, t in enumerate(part)] if quoting else part)
            flat, sizes = self._gathered(batch)
            ends = np.concatenate([[0], np.cumsum(sizes)])[batch.bounds]
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                yield self._by_library(part[i]) if i in quoting else flat[a:b]


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, queue, part, start, n, ids): ids with the end id, start within (part, queue)."""

    def run(batches):
        part, at, encoder = TaskContext.get().partitionId(), {}, Encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                texts = [t or "" for t in piece.column(2).to_pylist()]
                names = piece.column(1).to_pylist()
                starts, sizes, packed = [], [], []
                for name, ids in zip(names, encoder.encode(texts), strict=True):
                    n = len(ids) + 1
                    starts.append(at.get(name, 0))
                    at[name] = starts[-1] + n
                    sizes.append(n)
                    packed.append(np.append(ids, END_ID).astype("<u4" if _merge_table(path)._merged.max() > 65535 else "<u2").tobytes())
                m = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([part] * m, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "queue", "part", "start", "n", "ids"],
                )

    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("queue"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, queue string, part int, start long, n long, ids binary")


class Schedule:
    """Places of quanta in the served order, from the queues' sizes and weights."""

    def __init__(self, totals: dict[str, int], mixture: dict[str, float] | None = None, quantum: int = QUANTUM):
        self.names = sorted(totals)
        self.quantum = quantum
        sizes = np.array([totals[q] for q in self.names], np.int64)
        self.quanta = sizes // quantum
        given = np.array([float(mixture.get(q, 0.0)) if mixture else float(totals[q]) for q in self.names])
        share = given / max(given.sum(), 1e-300)
        self.weights = np.maximum(1, np.round(share * weight_scale(len(self.names)))).astype(np.int64)
        tails = sizes - self.quanta * quantum
        self.tail_start = int(self.quanta.sum()) * quantum + np.cumsum(tails) - tails

    def rank(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many quanta are served before quantum ``k`` of ``queue``.

        Quantum j of another queue precedes if it is due earlier, or at the same time and its
        queue comes first by name.
        """
        out = np.zeros(len(k), np.int64)
        w = self.weights[queue]
        for other in np.flatnonzero(self.quanta).tolist():
            due = (k + 1) * self.weights[other]
            before = np.where(other < queue, due, due - 1) // w
            out += np.where(other == queue, k, np.minimum(before, self.quanta[other]))
        return out

    def place(self, queue: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Place in the whole served stream of the token at ``pos`` of ``queue``."""
        k = pos // self.quantum
        tail = k >= self.quanta[queue]
        whole = self.rank(queue, np.where(tail, 0, k)) * self.quantum + pos % self.quantum
        return np.where(tail, self.tail_start[queue] + pos - self.quanta[queue] * self.quantum, whole)


def by_quantum(quantum: int, start: np.ndarray, n: np.ndarray):
    """Documents cut at the ends of quanta: (row, first token in the queue, end in the queue)."""
    first, last = start // quantum, (start + n - 1) // quantum
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))
    return row, np.maximum(k * quantum, start[row]), np.minimum((k + 1) * quantum, (start + n)[row])


def by_window(window: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray):
    """Pieces cut at the ends of windows, which only what is left of queues can cross."""
    over = place // window != (place + hi - lo - 1) // window
    if over.any():
        at = (place[over] // window + 1) * window - place[over] + lo[over]
        row = np.concatenate([row, row[over]])
        place = np.concatenate([place, place[over] + at - lo[over]])
        lo, hi = np.concatenate([lo, at]), np.concatenate([np.where(over, 0, hi), hi[over]])
        hi[: len(over)][over] = at
        order = np.lexsort((lo, row))
        row, place, lo, hi = row[order], place[order], lo[order], hi[order]
    return row, lo, hi, place


def cut(schedule: Schedule, window: int, queue: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Pieces of documents: (row, first token, length, place), joined where they touch."""
    row, lo, hi = by_quantum(schedule.quantum, start, n)
    row, lo, hi, place = by_window(window, row, lo, hi, schedule.place(queue[row], lo))
    joins = np.zeros(len(row), bool)
    joins[1:] = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + hi[:-1] - lo[:-1]) & (place[1:] % window != 0)
    head = np.flatnonzero(~joins)
    ends = hi[np.append(head[1:], len(row)) - 1] if len(head) else hi
    return row[head], lo[head] - start[row[head]], ends - lo[head], place[head]


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` stored in ranges sorted by ``by`` (unique), with ``range`` and ``at``, the place in it."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return materialise(numbered.withColumns({"range": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}))


def before_ranges(held: DataFrame, size) -> DataFrame:
    """(range, before): what ``size`` sums to over the ranges before. One row a shuffle partition."""
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("range").agg(F.sum(size).alias("size"))
    return F.broadcast(sums.select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")))


def queue_table(totals: DataFrame, mixture: dict[str, float] | None, quantum: int) -> DataFrame:
    """(queue, quanta, weight, tail_start) of ``totals`` (queue, size): ``Schedule`` as a table."""
    if mixture is None:
        given = totals.withColumn("given", F.col("size").cast("double"))
    else:
        shares = totals.sparkSession.createDataFrame(list(mixture.items()), "queue string, share double")
        given = totals.join(shares, "queue", "left").withColumn("given", F.coalesce("share", F.lit(0.0)))
    held = in_order(given.select("queue", "size", "given", (F.col("size") % quantum).alias("tail")), ["queue"])
    all_ = held.agg(F.count("*").alias("n"), F.sum("given").alias("given"), F.sum("size").alias("size"), F.sum("tail").alias("tail")).first()
    share = F.col("given") / max(all_["given"], 1e-300)
    in_range = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tails = F.col("before") + F.coalesce(F.sum("tail").over(in_range), F.lit(0))
    return held.join(before_ranges(held, F.col("tail")), "range").select(
        "queue",
        F.expr(f"size div {quantum}").alias("quanta"),
        F.greatest(F.lit(1), F.rint(share * weight_scale(all_["n"]))).cast("long").alias("weight"),
        (tails + all_["size"] - all_["tail"]).alias("tail_start"),
    )


def quantum_places(parts: DataFrame, quantum: int) -> DataFrame:
    """(queue, k, rank) of every quantum, by a sort of the due times (k + 1) / weight in ranges.

    ``parts``: queue, base, n, quanta, weight; the part in which a quantum begins makes its row.
    Due times are compared exactly: whole part and 64 binary places, more than two fractions
    with denominators of at most 2^31 can share; equal ones go by the queue's name.
    """
    begin = F.expr(f"(base + {quantum - 1}) div {quantum}")
    end = F.least(F.expr(f"(base + n + {quantum - 1}) div {quantum}"), F.col("quanta"))
    rows = parts.withColumns({"begin": begin, "end": end}).filter("begin < end").select("queue", "weight", F.explode(F.sequence("begin", F.col("end") - 1)).alias("k"))
    rows = rows.withColumns({"turn": F.expr("(k + 1) div weight"), "left": (F.col("k") + 1) % F.col("weight")})
    rows = rows.withColumns({"high": F.expr("shiftleft(left, 32) div weight"), "left": F.shiftleft("left", 32) % F.col("weight")})
    rows = rows.withColumn("low", F.expr("shiftleft(left, 32) div weight"))
    held = in_order(rows.select("turn", "high", "low", "queue", "k"), ["turn", "high", "low", "queue"])
    return held.join(before_ranges(held, F.lit(1)), "range").select("queue", "k", (F.col("before") + F.col("at")).alias("rank"))


def pack_by_sort(held: DataFrame, base: DataFrame, totals: DataFrame, wide: bool, mixture: dict[str, float] | None, window: int, quantum: int, with_ids: bool) -> DataFrame:
    """``pack`` for any number of queues: the same places, by joins.

    Pieces end with their quantum also where the next quantum follows at once.
    """
    parts = materialise(base.join(queue_table(totals, mixture, quantum), "queue"))
    places = quantum_places(parts, quantum)
    # what is left of a queue has its place already; negative numbers of no quantum spread it over the join
    known = parts.select("queue", "part", "base", "quanta", "tail_start")
    if parts.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                start, n, quanta, tail_start = (part.column(i).to_numpy() for i in (2, 3, 5, 6))
                row, lo, hi = by_quantum(quantum, start, n)
                tail = lo // quantum >= quanta[row]
                row, lo, hi, place = by_window(window, row, lo, hi, np.where(tail, tail_start[row] + lo - quanta[row] * quantum, lo))
                k = lo // quantum
                tail = k >= quanta[row]
                raw = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4").tobytes() for x in part.column(4).to_pylist()]
                first = lo - start[row]
                slices = [raw[r][4 * a : 4 * (a + m)] for r, a, m in zip(row.tolist(), first.tolist(), (hi - lo).tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(first), pa.array(hi - lo), pa.array([zlib.crc32(s) for s in slices], pa.int64()), pa.array(n[row]),
                           part.column(1).take(pa.array(row)), pa.array(np.where(tail, -1 - lo, k)), pa.array(np.where(tail, place, lo % quantum))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "queue", "k", "at"]
                if with_ids:
                    columns.append(pa.array(slices, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    placed = held.join(known, ["queue", "part"]).select("doc_id", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids", "quanta", "tail_start")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, queue string, k long, at long" + (", ids binary" if with_ids else "")
    place = F.col("at") + F.coalesce(F.col("rank") * quantum, F.lit(0))
    found = placed.mapInArrow(run, schema).join(places, ["queue", "k"], "left")
    ends = [((place - place % window) / window).cast("long").alias("sequence_id"), (place % window).alias("offset")]
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *ends, *(["ids"] if with_ids else []))


def pack(docs: DataFrame, tokenizer_path: str, mixture: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: where ``length`` tokens of a document, from ``start``, lie.

    ``mixture``: target share of each source (its share of all tokens where not given); a
    queue that runs dry leaves its share to the others. Null text is an empty document (the
    end id alone), null source is the source ''. Rows with equal ids are packed one by one.
    Every source is a queue, whatever their number; more than ``QUEUES`` are served by a sort
    of the quanta, to the same places. An empty table gives no rows. ``with_ids`` adds the
    piece's ids (binary, unsigned 32-bit).
    """
    if window % quantum:
        raise ValueError("a window must hold a whole number of quanta")
    held = materialise(tokenise(docs, tokenizer_path, id_col, text_col, source_col))
    sums = held.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("size"))
    some = totals.limit(QUEUES + 1).collect()
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    wide = tokenizer_wide(tokenizer_path)
    if len(some) > QUEUES:
        return pack_by_sort(held, base, totals, wide, mixture, window, quantum, with_ids)
    schedule = Schedule({r["queue"]: r["size"] for r in some}, mixture, quantum)
    base = base.drop("n")
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    number = {q: i for i, q in enumerate(schedule.names)}

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                queue = np.array([number[q] for q in part.column(1).to_pylist()], np.int64)
                start, n = part.column(2).to_numpy(), part.column(3).to_numpy()
                row, first, length, place = cut(schedule, window, queue, start, n)
                raw = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4").tobytes() for x in part.column(4).to_pylist()]
                slices = [raw[r][4 * a : 4 * (a + m)] for r, a, m in zip(row.tolist(), first.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(first), pa.array(length), pa.array([zlib.crc32(s) for s in slices], pa.int64()),
                           pa.array(n[row]), pa.array(place // window), pa.array(place % window)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(slices, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    placed = held.join(base, ["queue", "part"]).select("doc_id", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def tokenizer_wide(path: str) -> bool:
    """Whether ids need 32 bits."""
    return bool(_merge_table(path)._merged.max() > 65535)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark, sf_dir):
    """Contract query over all ``documents``."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
