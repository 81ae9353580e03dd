"""Finding text spans with Spark's own expressions: offsets are code points, ends exclusive.

Everything here takes time in proportion to the text and its spans: running sums and maxima go
through blocks of blocks (``running``) instead of one fold that copies its result at every step,
and parts of a text are cut from pieces of ``PIECE`` characters (``pieces_of``, ``cut``) instead
of from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"
BLOCK = 64
LEVELS = 4
PIECE = 1024
_FAR = 2**31 - 1


def no_spans() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, levels: int = LEVELS) -> Column:
    """Running result of the associative ``op`` over an array of ints, each element included.

    Blocks of ``BLOCK`` elements are folded one by one; what lies before each block is the
    running result over the blocks' totals, found the same way one level up.
    """
    none = F.array().cast("array<int>")

    def step(acc, x):
        new = op(acc["at"], x)
        return F.struct(new.alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    def fold(block):
        return F.aggregate(block, F.struct(F.lit(zero).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    if levels == 1:
        return fold(values)

    def whole(v):
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) <= BLOCK, fold(v)).otherwise(let(blocks, joined))

    def joined(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda a, x: op(a, x)))
        before = F.concat(F.array(F.lit(zero)), running(totals, op, zero, levels - 1))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(before, F.lit(1), F.size(blocks)).alias("t")), lambda x: F.transform(fold(x["b"]), lambda y: op(x["t"], y))))

    return let(values, whole)


def find(text: Column, kind: str, pattern: str, guard: Column, valid=None) -> Column:
    """Spans of all leftmost non-overlapping matches of ``pattern`` that pass ``valid(match)``.

    Spark has no match offsets, so they are summed from the pieces between the matches
    (``split``) and the matches themselves; both walk the same matcher. Texts that fail
    ``guard``, a cheap necessary condition, are not scanned.
    """

    def placed(found):
        lengths = F.zip_with(F.transform(found, F.length), F.transform(F.split(text, pattern, -1), F.length), lambda m, g: m + g)
        ends = running(F.slice(lengths, F.lit(1), F.size(found)), lambda a, x: a + x, 0)
        return F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(no_spans()))
    if valid is not None:
        spans = F.filter(spans, lambda x: valid(x["m"]))
    return F.when(guard, spans).otherwise(no_spans())


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the order of ``kinds``, as 'kind:start:end' joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.element_at(rank, x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``, by start.

    Among the others, the farthest end of those that start at or before a span and the first
    start of those after it tell whether any overlaps it.
    """

    def place(own, others_):
        theirs = F.transform(others_, lambda o: F.struct(o["s"].alias("s"), F.lit(-1).alias("i"), o["e"].alias("e")))
        mine = F.transform(own, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["e"].alias("e")))
        return F.array_sort(F.concat(theirs, mine))

    def chosen(own, rows):
        ends = running(F.transform(rows, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(rows, lambda x: F.when(x["i"] < 0, x["s"]).otherwise(_FAR))), F.least, _FAR))
        zipped = F.arrays_zip(rows.alias("x"), ends.alias("before"), starts.alias("after"))
        free = F.filter(zipped, lambda z: (z["x"]["i"] >= 0) & (z["before"] <= z["x"]["s"]) & (z["after"] >= z["x"]["e"]))
        return F.transform(free, lambda z: F.element_at(own, z["x"]["i"] + 1))

    kept = let(spans, lambda own: let(place(own, others), lambda rows: chosen(own, rows)))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(kept)


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` as an array of strings."""

    def part(k):
        low = F.greatest(start - k * PIECE, F.lit(0))
        return F.substring(F.element_at(pieces, k + 1), low + 1, F.least(end - k * PIECE, F.lit(PIECE)) - low)

    numbers = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
    return F.when(start < end, F.transform(numbers, part)).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every run of overlapping spans (s, e) replaced by ``mark``."""

    def segments(rows):
        ends = running(F.transform(rows, lambda x: x["e"]), F.greatest, 0)
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(rows))
        zipped = F.arrays_zip(rows.alias("x"), before.alias("at"))
        outer = F.filter(zipped, lambda z: z["x"]["s"] >= z["at"])
        kept = F.transform(outer, lambda z: F.struct(z["at"].alias("a"), z["x"]["s"].alias("b"), F.lit(mark).alias("mark")))
        tail = F.struct(F.array_max(ends).alias("a"), F.length(text).alias("b"), F.lit("").alias("mark"))
        return F.concat(kept, F.array(tail))

    def joined(pieces):
        return F.array_join(F.flatten(F.transform(let(F.array_sort(spans), segments), lambda x: F.concat(cut(pieces, x["a"], x["b"]), F.array(x["mark"])))), "")

    return F.when(F.size(spans) > 0, let(pieces_of(text), joined)).otherwise(text)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the logistic approximation (error under 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))
