"""Control points, signed sides of surfaces, body windows and borehole gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators.forward import BROADCAST_FACETS, CORNERS, corners, pairs
from terralith.operators.locate import descend, over_facets
from terralith.operators.mesh import lattice

#: Triangles that points beside a surface all look at; more are searched through a tree.
FEW_FACETS = BROADCAST_FACETS // 100


def grid_weights(nodes: DataFrame, n: int, stride: int, ring: int = 0) -> DataFrame:
    """Bilinear weights of an n x n grid's nodes (ix, iy) on control nodes every ``stride``.

    (ix, iy, cx, cy, w) with w > 0. Padding of ``ring`` nodes takes the nearest inner node's
    weights; the last control row and column are the inner grid's end.
    """
    lo, hi = ring, n - 1 - ring
    inside = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
    low = lambda v: F.least((F.floor((v - lo) / stride) * stride + lo).cast("int"), F.lit(max(lo, hi - 1)))
    out = nodes.select("ix", "iy", inside("ix").alias("px"), inside("iy").alias("py"))
    out = out.select("*", low(F.col("px")).alias("x0"), low(F.col("py")).alias("y0"))
    out = out.withColumn("x1", F.least(F.col("x0") + stride, F.lit(hi))).withColumn("y1", F.least(F.col("y0") + stride, F.lit(hi)))
    t = lambda p, a, b: F.when(F.col(b) > F.col(a), (F.col(p) - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    tx, ty = t("px", "x0", "x1"), t("py", "y0", "y1")
    four = [("x0", "y0", (1 - tx) * (1 - ty)), ("x1", "y0", tx * (1 - ty)), ("x0", "y1", (1 - tx) * ty), ("x1", "y1", tx * ty)]
    rows = F.array(*[F.struct(F.col(a).alias("cx"), F.col(b).alias("cy"), w.alias("w")) for a, b, w in four])
    return out.select("ix", "iy", F.explode(rows).alias("c")).select("ix", "iy", "c.cx", "c.cy", "c.w").filter("w > 0")


def control_points(vertices: DataFrame, cell: float) -> DataFrame:
    """(mesh_id, v_id) of control points on a lattice shared by all meshes.

    One position per cell of side ``cell``, the one nearest its centre (ties by lattice key);
    every vertex of any mesh at that position is a control point.
    """
    keyed = vertices.select("mesh_id", "v_id", "x", "y", "z", *[lattice(F.col(c)).alias(f"q{c}") for c in "xyz"], *[F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xyz"])
    d2 = F.round(sum((F.pow(F.col(c) - (F.col(f"c{c}") + 0.5) * cell, 2) for c in "xyz"), F.lit(0.0)), 9)
    best = keyed.groupBy("cx", "cy", "cz").agg(F.min(F.struct(d2.alias("d2"), "qx", "qy", "qz")).alias("b"))
    return keyed.join(best.select("b.qx", "b.qy", "b.qz"), ["qx", "qy", "qz"], "left_semi").select("mesh_id", "v_id")


def side(points: DataFrame, facets: DataFrame, dead: float = 1e-9) -> DataFrame:
    """(obs_id, side): 1 over, -1 under, 0 on the surface.

    The normal of the first triangle (by t_id) that covers the point in x-y decides; they meet
    through cells of the triangles' extents. Points that none covers are held against the plane
    of the triangle whose clamped foot point is nearest (ties by t_id): they meet all of up to
    ``BROADCAST_FACETS`` / 100 triangles, more are searched through a tree of the triangles'
    boxes (``locate.descend``; a foot lies in its triangle's box). Null without any triangle.
    """
    p, q, r = corners()
    d = (F.col("qy") - F.col("ry")) * (F.col("px") - F.col("rx")) + (F.col("rx") - F.col("qx")) * (F.col("py") - F.col("ry"))
    wa = ((F.col("qy") - F.col("ry")) * (F.col("x") - F.col("rx")) + (F.col("rx") - F.col("qx")) * (F.col("y") - F.col("ry"))) / d
    wb = ((F.col("ry") - F.col("py")) * (F.col("x") - F.col("rx")) + (F.col("px") - F.col("rx")) * (F.col("y") - F.col("ry"))) / d
    n, _ = g.normal(p, q, r)
    o = g.vec("x", "y", "z")
    sign = lambda height: F.when(F.abs(height) <= dead, 0).otherwise(F.signum(height).cast("int"))
    covered = (F.abs(d) > 1e-30) & (wa >= -1e-9) & (wb >= -1e-9) & (1.0 - wa - wb >= -1e-9)
    # points of one place are one
    spots = points.select("obs_id", "x", "y", "z")
    all_points = spots.groupBy("x", "y", "z").agg(F.min("obs_id").alias("obs_id"))
    found = over_facets(all_points, facets).filter(covered).groupBy("obs_id").agg(F.min_by(sign(g.dot(g.sub(o, p), n)), "t_id").alias("side"))

    rest = all_points.join(found.select("obs_id"), "obs_id", "left_anti")
    foot = clamped_foot(o, p, q, r)
    away = g.sub(o, foot)
    # each step a projection of its own, so that shared parts are computed once
    solid = facets.filter(g.norm(g.cross(g.sub(q, p), g.sub(r, p))) > 1e-15)
    near = pairs(rest, solid) if solid.count() <= FEW_FACETS else _around(rest, solid)
    near = near.select("obs_id", "t_id", g.dot(away, away).alias("d2"), sign(g.dot(away, n)).alias("s"))
    outside = near.groupBy("obs_id").agg(F.min(F.struct("d2", "t_id", "s")).alias("b")).select("obs_id", F.col("b.s").alias("side"))
    sides = all_points.join(found.unionByName(outside), "obs_id", "left").select(*[F.col(a).alias(f"__{a}") for a in "xyz"], "side")
    return spots.join(sides, [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in "xyz"], "left").select("obs_id", "side")


def _around(points: DataFrame, facets: DataFrame) -> DataFrame:
    """Points beside the triangles that may be nearest to them."""
    ends = {f"{e}{a}": f(*[F.col(f"{c}{a}").cast("double") for c in "pqr"]) for a in "xyz" for e, f in (("lo", F.least), ("hi", F.greatest))}
    boxes = facets.select(F.col("t_id").alias("target_id"), *[v.alias(k) for k, v in ends.items()]).withColumns({a: (F.col(f"lo{a}") + F.col(f"hi{a}")) / 2 for a in "xyz"})
    places = points.select(F.col("obs_id").alias("p"), *[(F.col(a).cast("double") + 0.0).alias(f"__{a}") for a in "xyz"])
    met = descend(places, boxes, 1, "xyz").select(F.col("p").alias("obs_id"), *[F.col(f"__{a}").alias(a) for a in "xyz"], F.col("target_id").alias("t_id"))
    return met.join(facets.select("t_id", *CORNERS), "t_id")


def clamped_foot(o, p, q, r):
    """Foot of ``o`` in the plane of the triangle p, q, r, its weights moved into the triangle.

    Negative weights of q and r become 0; weights that then exceed 1 together are scaled to 1.
    """
    a, b, v = g.sub(q, p), g.sub(r, p), g.sub(o, p)
    aa, ab, bb, av, bv = g.dot(a, a), g.dot(a, b), g.dot(b, b), g.dot(a, v), g.dot(b, v)
    det = aa * bb - ab * ab
    s = F.greatest(F.lit(0.0), (bb * av - ab * bv) / det)
    t = F.greatest(F.lit(0.0), (aa * bv - ab * av) / det)
    k = F.greatest(F.lit(1.0), s + t)
    return tuple(x + (s * y + t * z) / k for x, y, z in zip(p, a, b, strict=True))


def body_labels(cells: DataFrame, windows: list[tuple[tuple[float, float], tuple[float, float], tuple[float, float]]]) -> DataFrame:
    """Cells with ``body``: number of the last window of normalised coordinates that holds them, 0 for none."""
    ends = cells.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"])
    unit = lambda c: (F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12))
    label: Column = F.lit(0)
    for i, window in enumerate(windows, 1):
        held = F.lit(True)
        for c, (a, b) in zip("xyz", window, strict=True):
            held = held & unit(c).between(a, b)
        label = F.when(held, i).otherwise(label)
    return cells.crossJoin(F.broadcast(ends)).withColumn("body", label).drop(*[f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"])


def penalty_gradient(plus: DataFrame, minus: DataFrame, step: float, omega: float = 1.0, compat_double_omega: bool = False) -> DataFrame:
    """(dof, gradient) by central differences of penalties(dof, penalty) that already hold omega once.

    ``compat_double_omega`` multiplies by it again, as older results did.
    """
    k = omega if compat_double_omega else 1.0
    return plus.alias("p").join(minus.alias("m"), "dof").select("dof", (k * (F.col("p.penalty") - F.col("m.penalty")) / (2.0 * step)).alias("gradient"))


def stations_at(stations: DataFrame, data: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows of data(station, f) with the number of the station's frequency within ``tolerance``.

    stations: station, frequencies (array). The join is on the station; frequencies are matched
    inside its array.
    """
    listed = stations.select("station", F.posexplode("frequencies").alias("number", "fs"))
    return data.join(listed, "station").filter(F.abs(F.col("f") - F.col("fs")) < tolerance).select("station", "number", "f")


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Moved and unmoved vertices and the largest displacement between two states, one row."""
    d = F.sqrt(sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in "xyz"), F.lit(0.0)))
    rows = before.alias("b").join(after.alias("a"), "v_id").select(d.alias("d"))
    return rows.agg(F.count(F.when(F.col("d") > 1e-8, 1)).alias("moved"), F.count(F.when(F.col("d") <= 1e-8, 1)).alias("unmoved"), F.max("d").alias("largest"))


def padded_nodes(nodes: DataFrame, nx: int, ny: int, step: float, z: float, ring: int) -> DataFrame:
    """nodes(v_id row-major) of a flat nx x ny grid with x, y, z, freedom: the padding ring is FIXED, the rest Z_ONLY."""
    rows = nodes.select("v_id", (F.col("v_id") % nx).alias("i"), F.floor(F.col("v_id") / nx).alias("j"))
    pad = (F.col("i") < ring) | (F.col("i") >= nx - ring) | (F.col("j") < ring) | (F.col("j") >= ny - ring)
    return rows.select("v_id", (F.col("i") * step).alias("x"), (F.col("j") * step).alias("y"), F.lit(z).alias("z"), F.when(pad, "FIXED").otherwise("Z_ONLY").alias("freedom"))


def padded_grid(spark, nx: int, ny: int, step: float, z: float, ring: int) -> DataFrame:
    """``padded_nodes`` of all nodes of the grid."""
    return padded_nodes(spark.range(nx * ny).withColumnRenamed("id", "v_id"), nx, ny, step, z, ring)


def history_changes(history: DataFrame, by: str = "run_id") -> DataFrame:
    """Iterations whose parameter norm changed since the one before by more than 1e-14 (squared)."""
    w = Window.partitionBy(by).orderBy("iteration")
    step = F.pow(F.col("norm") - F.lag("norm").over(w), 2)
    return history.withColumn("step2", step).filter(F.col("step2").isNull() | (F.col("step2") > 1e-14)).drop("step2")
