"""Joins of points with boxes through grid cells, so that no table meets another one whole.

A box has the level of its largest side, the power of two at or above it; at its level it covers
two cells along each axis at most. Points look into their own cell of every level that occurs.
The join is by level and cell: Spark hashes it, broadcasts it where one side is small, and
adaptive execution splits cells that hold very much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides below this have the level of this (and so a bounded number of levels).
LEAST_SIDE = 1e-6


def with_boxes(points: DataFrame, at: list[Column], boxes: DataFrame, extents: list[tuple[Column, Column]], keep: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Points beside the boxes whose ``extents`` (low, high by axis) hold them at ``at``.

    Columns of both, ``keep`` of the boxes' (all of them by default); ``on`` are columns of both that must be equal. Boxes with a null or
    non-finite extent meet no point. The levels are read first, by one aggregation; there are
    as many as powers of two between the smallest and the largest box.
    """
    lows, highs = [e[0].cast("double") for e in extents], [e[1].cast("double") for e in extents]
    side = F.greatest(F.lit(LEAST_SIDE), *[h - lo for lo, h in zip(lows, highs, strict=True)])
    level = F.ceil(F.log2(side)).cast("int")
    n = len(extents)
    names = [f"__lo{i}" for i in range(n)], [f"__hi{i}" for i in range(n)], [f"__c{i}" for i in range(n)]
    sized = boxes.select(*(keep or boxes.columns), *[c.alias(x) for c, x in zip(lows + highs, names[0] + names[1], strict=True)], level.alias("__level"))
    finite = [F.abs(F.col(x)) < float("inf") for x in names[0] + names[1]]
    for f in finite:
        sized = sized.filter(f)
    levels = sorted(r["__level"] for r in sized.select("__level").distinct().collect())
    dealt = sized
    for lo, hi, c in zip(*names, strict=True):
        width = F.pow(F.lit(2.0), F.col("__level"))
        dealt = dealt.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    spots = points.select("*", *[c.cast("double").alias(f"__at{i}") for i, c in enumerate(at)])
    spots = spots.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    for i, c in enumerate(names[2]):
        spots = spots.withColumn(c, F.floor(F.col(f"__at{i}") / F.pow(F.lit(2.0), F.col("__level"))))
    met = spots.join(dealt, ["__level", *names[2], *(on or [])])
    for i, (lo, hi) in enumerate(zip(*names[:2], strict=True)):
        met = met.filter(F.col(f"__at{i}").between(F.col(lo), F.col(hi)))
    return met.drop("__level", *names[0], *names[1], *names[2], *[f"__at{i}" for i in range(n)])
