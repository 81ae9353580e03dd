"""Survey residuals: weights, misfits, autocorrelation, trends and distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.mesh import dense_number


#: Rows that one task may sort.
WINDOW_ROWS = 200_000


def default_uncertainty(std: Column, default: float) -> Column:
    """A standard deviation that is not positive becomes the default."""
    return F.when(std <= 0, F.lit(default)).otherwise(std)


def weight(std: Column) -> Column:
    """1 / std, or 1 where std is not positive."""
    return F.when(std > 0, 1.0 / std).otherwise(1.0)


def local(x: Column, y: Column, z: Column, origin: tuple[float, float, float], inverse: bool = False) -> tuple[Column, Column, Column]:
    """Coordinates less (or, inverse, plus) the local origin."""
    sign = 1.0 if inverse else -1.0
    return tuple(c + sign * o for c, o in zip((x, y, z), origin, strict=True))


def survey_frame(obs: DataFrame) -> DataFrame:
    """Centre of the extent and mean height, one row."""
    return obs.agg(((F.min("x") + F.max("x")) / 2).alias("x0"), ((F.min("y") + F.max("y")) / 2).alias("y0"), F.avg("z").alias("datum"))


def misfit(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Half the sum of squared weighted residuals, RMS and count of rows(value, predicted, std)."""
    r = F.col("value") - F.col("predicted")
    return rows.groupBy(*(by or [])).agg(F.sum(0.5 * F.pow(weight(F.col("std")) * r, 2)).alias("misfit"), F.sqrt(F.avg(r * r)).alias("rms"), F.count("*").alias("n"))


def misfit_gradient(jacobian: DataFrame, residuals: DataFrame) -> DataFrame:
    """-J' W^2 r by degree of freedom; jacobian(obs_id, dof, j), residuals(obs_id, r, std)."""
    w = weight(F.col("std"))
    return jacobian.join(residuals, "obs_id").groupBy("dof").agg(F.sum(-F.col("j") * w * w * F.col("r")).alias("gradient"))


def joint_objective(parts: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """Components (name, weight, value) and their weighted total from one-row misfit tables."""
    rows = None
    for name, alpha, part in parts:
        one = part.select(F.lit(name).alias("component"), F.lit(alpha).alias("alpha"), F.col("misfit").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    total = rows.agg(F.lit("total").alias("component"), F.lit(1.0).alias("alpha"), F.sum(F.col("alpha") * F.col("value")).alias("value"))
    return rows.unionByName(total)


def durbin_watson(residuals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Durbin-Watson statistics along x (order x, y) and along y (order y, x).

    rows: x, y, r, obs_id. Rows are ordered within ``by`` (a survey line, say); without it the
    order is over all rows: up to ``WINDOW_ROWS`` (counted) are sorted in one task, more are
    numbered by sorted ranges and meet their predecessor by number. Ties go by obs_id, which must then be unique. 2 where there are fewer than two rows
    or no residual energy.
    """
    by = by or []
    energy = F.sum(F.col("r") ** 2)
    ratio = lambda c: F.when((F.count("*") < 2) | (energy < 1e-30), 2.0).otherwise(F.sum(F.col(c) ** 2) / energy)
    if not by and residuals.count() > WINDOW_ROWS:
        parts = []
        for name, order in (("dx", ["x", "y", "obs_id"]), ("dy", ["y", "x", "obs_id"])):
            placed = dense_number(residuals.select("x", "y", "obs_id", "r"), order, "__i").select("__i", "r")
            before = placed.select((F.col("__i") + 1).alias("__i"), F.col("r").alias("__before"))
            parts.append(placed.join(before, "__i", "left").select("r", (F.col("r") - F.col("__before")).alias(name)))
        along, across = [p.agg(ratio(c).alias(f"dw_{c[1]}"), F.count("*").alias("n")) for p, c in zip(parts, ("dx", "dy"), strict=True)]
        return along.crossJoin(F.broadcast(across.drop("n"))).select("dw_x", "dw_y", "n")
    along_x = Window.partitionBy(*by).orderBy("x", "y", "obs_id")
    along_y = Window.partitionBy(*by).orderBy("y", "x", "obs_id")
    d = residuals.select(*by, "r", (F.col("r") - F.lag("r").over(along_x)).alias("dx"), (F.col("r") - F.lag("r").over(along_y)).alias("dy"))
    return d.groupBy(*by).agg(ratio("dx").alias("dw_x"), ratio("dy").alias("dw_y"), F.count("*").alias("n"))


def planar_trend(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c, one row (a, b, c).

    One aggregation of moments about the mean; the 2 x 2 system is solved in the plan.
    """
    c = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    m = c.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"),
        F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return m.select(a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def detrend(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """``rows`` with the residual from their plane as ``detrended``."""
    plane = F.broadcast(planar_trend(rows, x, y, z))
    return rows.crossJoin(plane).withColumn("detrended", F.col(z) - (F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c"))).drop("a", "b", "c")


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (0 where that is 0)."""
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"{c}_z", F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0))
    return out.drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def histogram(rows: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins between the column's minimum and maximum over all rows."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("__lo")) / width)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def upper_median(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The element at place n div 2 of the sorted values (not the mean of the middle two)."""
    picked = F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")
    return rows.groupBy(*(by or [])).agg(picked.alias("upper_median"), F.count("*").alias("n"))


def data_scale(values: DataFrame, column: str) -> DataFrame:
    """RMS of the data, 1 at least."""
    return values.agg(F.sqrt(F.greatest(F.avg(F.col(column) ** 2), F.lit(1.0))).alias("scale"))


def down_sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement, the same ones for the same seed (by hash order)."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def name_hash(name: Column) -> Column:
    """h = 31 h + code over the characters, modulo 2**32."""
    return F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)


def perturb(value: Column, name: Column, factor: float) -> Column:
    """Value times 1 + factor * (2 u - 1), u from the hash of the name."""
    u = (name_hash(name) % 10000) / 10000.0
    return value * (1.0 + factor * (2.0 * u - 1.0))


def box_project(x: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(lower, F.least(upper, x))
