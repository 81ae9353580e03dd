"""Farthest-point sampling of control points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def farthest_points(points: DataFrame, k: int, stop: float = 1e-20) -> DataFrame:
    """(ord, p_id): the smallest id first, then the point farthest from those chosen, ties by id.

    Each round is one aggregation (one row to the driver); the chosen points, ``k`` in number,
    are literals of the next round's plan. Ends early when no point is farther than ``stop``.
    """
    first = points.agg(F.min_by(F.struct("p_id", "x", "y", "z"), "p_id").alias("p")).first()["p"]
    chosen = [first]
    while first is not None and len(chosen) < k:
        near = F.least(*[F.pow(F.col("x") - c["x"], 2) + F.pow(F.col("y") - c["y"], 2) + F.pow(F.col("z") - c["z"], 2) for c in chosen * (2 if len(chosen) == 1 else 1)])
        best = points.withColumn("d2", near).agg(F.max_by(F.struct("p_id", "x", "y", "z", "d2"), F.struct(F.col("d2"), -F.col("p_id"))).alias("p")).first()["p"]
        if best is None or best["d2"] < stop:
            break
        chosen.append(best)
    rows = [(i, c["p_id"]) for i, c in enumerate(chosen) if c is not None]
    return points.sparkSession.createDataFrame(rows, "ord int, p_id long")
