"""Drill-hole intervals: gaps and islands, first occurrences, stratigraphic order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(rows: DataFrame, gap: float | None = 0.1, order: list[str] | None = None) -> DataFrame:
    """Runs of consecutive intervals of one hole with equal ``grp``: (hole_id, grp, z_top, z_bottom, n).

    With ``gap``, a run also ends where the next interval starts ``gap`` or more from the last
    one's end; ``gap=None`` merges by order alone. Holes are sorted separately.
    """
    w = Window.partitionBy("hole_id").orderBy(*(order or ["from_m", "to_m"]))
    new = F.col("grp") != F.lag("grp").over(w)
    if gap is not None:
        new = new | (F.abs(F.col("from_m") - F.lag("to_m").over(w)) >= gap)
    flagged = rows.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int"))
    runs = flagged.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("hole_id", "__run", "grp").agg(F.min("from_m").alias("z_top"), F.max("to_m").alias("z_bottom"), F.count("*").alias("n")).drop("__run")


def stratigraphic_order(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Groups by shallowest depth over all holes; groups never met come last, ties by name."""
    first = rows.groupBy("grp").agg(F.min("from_m").alias("shallowest"))
    out = expected.join(first, "grp", "left").withColumn("shallowest", F.coalesce("shallowest", F.lit(1e18)))
    return out.withColumn("ordinal", F.row_number().over(Window.orderBy("shallowest", "grp")))


def first_depths(rows: DataFrame, holes: DataFrame, groups: DataFrame, absent: float = 9999.0) -> DataFrame:
    """Depth of the first occurrence of every group in every hole; ``absent`` where there is none."""
    first = rows.groupBy("hole_id", "grp").agg(F.min("from_m").alias("depth"))
    return holes.crossJoin(F.broadcast(groups)).join(first, ["hole_id", "grp"], "left").withColumn("depth", F.coalesce("depth", F.lit(absent)))


def anomalous_holes(contacts: DataFrame, regional: float, strong: float = 50.0, weak: float = 10.0) -> DataFrame:
    """Holes whose contact rises over the regional level by ``strong``, else those by ``weak``.

    Adds ellipsoid half-axes with floors 100, 50 and 20.
    """
    rise = F.col("contact") - regional
    level = contacts.agg(F.when(F.max(rise) > strong, strong).otherwise(weak).alias("__level"))
    out = contacts.withColumn("rise", rise).crossJoin(F.broadcast(level)).filter(F.col("rise") > F.col("__level")).drop("__level")
    return out.withColumns({"a": F.greatest(F.lit(100.0), F.col("rise") * 2), "b": F.greatest(F.lit(50.0), F.col("rise")), "c": F.greatest(F.lit(20.0), F.abs("rise"))})


def interval_penalty(classified: DataFrame, omega: float = 1.0) -> DataFrame:
    """omega times the sum of squared thickness of intervals whose group is not the expected one."""
    thick = F.col("z_bottom") - F.col("z_top")
    wrong = ~F.col("found").eqNullSafe(F.col("expected"))
    return classified.agg(F.coalesce(F.sum(F.when(wrong, omega * thick * thick)), F.lit(0.0)).alias("penalty"), F.count(F.when(wrong, 1)).alias("n_wrong"), F.count("*").alias("n"))
