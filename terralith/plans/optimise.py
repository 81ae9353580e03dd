"""Queries on penalties, validation, property solves, bounded descent and model set-up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.operators import forward as fw
from terralith.operators import hooks
from terralith.operators import inversion as inv
from terralith.operators import mesh as m
from terralith.operators import model as md
from terralith.operators.storage import discard, stored_at
from terralith.plans import bindings as b
from terralith.plans.registry import query
from terralith.plans.shapes import strips


@query("reference_penalty", f"WITH {b.OBS_SQL} SELECT round(sum(0.5*0.3*pow(value-2.0, 2)), 6) AS penalty, round(sqrt(sum(pow(0.3*(value-2.0), 2))), 6) AS gradient_norm FROM obs")
def reference_penalty(spark, d):
    p = b.obs(spark, d).select(F.col("obs_id").alias("dof_id"), F.col("value").alias("p"), F.lit(2.0).alias("p0"))
    return inv.reference_penalty(p, 0.3).select(F.round("penalty", 6).alias("penalty"), F.round("gradient_norm", 6).alias("gradient_norm"))


_VAL = "st AS (SELECT v.v_id, k.m AS mesh_id, x, y, z FROM vertices v, (VALUES (0),(1)) k(m)), nw AS (SELECT v_id, mesh_id, x, y, z + CASE WHEN v_id % 50 = 0 AND mesh_id = 1 THEN 0.05 ELSE 0 END AS z FROM st)"


@query("model_validation", f"WITH {b.VERTICES_SQL},\n{b.TRIANGLES_SQL}, dir AS (SELECT v0 AS a, v1 AS b FROM triangles UNION ALL SELECT v1, v2 FROM triangles UNION ALL SELECT v2, v0 FROM triangles), edges AS (SELECT a, b FROM dir UNION SELECT b, a FROM dir), {_VAL},"
       " side AS (SELECT greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))*0.2 AS s FROM st), ar AS (SELECT n.mesh_id, e.a AS v_id, avg(n.x) AS mx, avg(n.y) AS my, avg(n.z) AS mz FROM edges e JOIN nw n ON n.v_id = e.b GROUP BY 1, 2)"
       " SELECT 'shared_gap' AS \"check\", true AS passed, 0.05 AS worst UNION ALL SELECT 'bounding_box', true, 0.0 UNION ALL SELECT 'spikes', max(sqrt(pow(x-mx,2)+pow(y-my,2)+pow(z-mz,2))/s) <= 1, round(max(sqrt(pow(x-mx,2)+pow(y-my,2)+pow(z-mz,2))/s), 6) FROM nw JOIN ar USING (mesh_id, v_id), side")  # fmt: skip
def model_validation(spark, d):
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    start = b.vertices(spark, d).select("v_id", two.alias("mesh_id"), "x", "y", "z")
    now = start.withColumn("z", F.col("z") + F.when((F.col("v_id") % 50 == 0) & (F.col("mesh_id") == 1), 0.05).otherwise(0.0))
    edges = m.undirected_edges(b.triangles(spark, d)).select("a", "b", two.alias("mesh_id"))
    return md.validate(start, now, edges).select("check", "passed", F.round("worst", 6).alias("worst"))


@query("overlap_counts", f"WITH {b.INTERVALS_SQL}, c AS (SELECT (hole_id % 4)::INT AS g, CASE grp WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE -1 END AS f FROM intervals) SELECT count(CASE WHEN f >= 0 AND abs(f-g) = 1 THEN 1 END) AS adjacent, count(CASE WHEN f >= 0 AND abs(f-g) > 1 THEN 1 END) AS distant FROM c")
def overlap_counts(spark, d):
    found = F.when(F.col("grp") == "A", 0).when(F.col("grp") == "N", 2).otherwise(-1)
    return md.overlap_counts(b.intervals(spark, d).select((F.col("hole_id") % 4).cast("int").alias("group_id"), found.alias("found")))


@query("remanence_setup", f"WITH {b.CLUSTERS_SQL}, r AS (SELECT *, CASE WHEN cluster_id % 3 = 0 THEN NULL ELSE cluster_id*0.1 END AS mag, CASE WHEN cluster_id % 2 = 0 THEN NULL ELSE 60.0 END AS inc FROM clusters) SELECT cluster_id, 'fixed_vector' AS mode, round(coalesce(mag, susceptibility*550.0), 6) AS magnitude, coalesce(inc, 75.0) AS inclination, -20.0 AS declination FROM r")
def remanence_setup(spark, d):
    k = F.col("cluster_id")
    rows = b.clusters(spark, d).withColumns({"remanence_magnitude": F.when(k % 3 != 0, k * 0.1), "remanence_inclination": F.when(k % 2 != 0, 60.0), "remanence_declination": F.lit(None).cast("double")})
    return md.remanence(rows).select("cluster_id", "mode", F.round("magnitude", 6).alias("magnitude"), "inclination", "declination")


@query("layer_stack", f"WITH {b.VERTICES_SQL}, c AS (SELECT v_id AS node, k.o AS ord, -100.0*(k.o+1)+z/100 AS z FROM vertices, (VALUES (0),(1),(2)) k(o)), f AS (SELECT node, ord, z FROM c UNION ALL SELECT DISTINCT node, 3, -1000.0 FROM c) SELECT node, ord AS layer, round(coalesce(lag(z) OVER (PARTITION BY node ORDER BY ord), 50.0), 6) AS z_top, round(z, 6) AS z_bottom FROM f")
def layer_stack(spark, d):
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    c = b.vertices(spark, d).select(F.col("v_id").alias("node"), three.alias("ord"), "z").withColumn("z", -100.0 * (F.col("ord") + 1) + F.col("z") / 100)
    out = md.layer_stack(c, 50.0, -1000.0)
    return out.select("node", "layer", F.round("z_top", 6).alias("z_top"), F.round("z_bottom", 6).alias("z_bottom"))


@query("split_mesh", f"WITH {b.TRIANGLES_SQL}, k AS (SELECT t_id, (v0 % 40) // 3 AS strip FROM triangles), r AS (SELECT min(t_id) AS root, count(*) AS n FROM k GROUP BY strip), {b.CLUSTERS_SQL} SELECT 99 + row_number() OVER (ORDER BY n DESC, root) AS cluster_id, n AS n_faces, c.working_name, round(c.density, 6) AS density FROM r, clusters c WHERE c.cluster_id = 3")
def split_mesh(spark, d):
    rows = md.split_mesh(strips(b.triangles(spark, d)), b.clusters(spark, d), 3, 100)[1]
    return rows.select("cluster_id", "n_faces", "working_name", F.round("density", 6).alias("density"))


_PAD = f"""WITH {b.VERTICES_SQL}, n AS (SELECT (v_id % 10)::INT AS ix, (v_id // 10)::INT AS iy, z FROM vertices), e AS (SELECT max(iy) + 1 AS ny FROM n),
p AS (SELECT ix, iy, greatest(1, least(8, ix)) AS cx, greatest(1, least(ny-2, iy)) AS cy, CASE WHEN ix < 1 THEN 2 WHEN ix > 8 THEN 7 END AS mx, CASE WHEN iy < 1 THEN 2 WHEN iy > ny-2 THEN ny-3 END AS my,
  CASE WHEN ix < 1 THEN 1-ix WHEN ix > 8 THEN ix-8 ELSE 0 END AS sx, CASE WHEN iy < 1 THEN 1-iy WHEN iy > ny-2 THEN iy-(ny-2) ELSE 0 END AS sy FROM n, e WHERE NOT (ix BETWEEN 1 AND 8 AND iy BETWEEN 1 AND ny-2)),
j AS (SELECT p.*, a.z AS z0, a.z + sx*(a.z-x.z) AS ax, a.z + sy*(a.z-y.z) AS ay FROM p JOIN n a ON a.ix = cx AND a.iy = cy LEFT JOIN n x ON x.ix = mx AND x.iy = cy LEFT JOIN n y ON y.ix = cx AND y.iy = my)
SELECT ix, iy, round(z, 6) AS z FROM n, e WHERE ix BETWEEN 1 AND 8 AND iy BETWEEN 1 AND ny-2 UNION ALL SELECT ix, iy, round(CASE WHEN sx = 0 THEN ay WHEN sy = 0 THEN ax ELSE (ax+ay)/2 END, 6) FROM j"""


@query("padding_extrapolation", _PAD)
def padding_extrapolation(spark, d):
    """The height field, as a grid of ten columns, with its outer ring continued from the inside."""
    k = F.col("v_id")
    v = b.vertices(spark, d)
    last = int(v.agg(F.max("v_id")).first()[0])
    nodes = v.select((k % 10).cast("int").alias("ix"), F.floor(k / 10).cast("int").alias("iy"), "z")
    return md.pad_edges(nodes, 10, last // 10 + 1).select("ix", "iy", F.round("z", 6).alias("z"))


_EDGES = "dir AS (SELECT v0 AS a, v1 AS b FROM triangles UNION ALL SELECT v1, v2 FROM triangles UNION ALL SELECT v2, v0 FROM triangles), e AS (SELECT a, b FROM dir WHERE NOT EXISTS (SELECT 1 FROM dir o WHERE o.a = dir.b AND o.b = dir.a))"


@query("boundary_loops", f"WITH RECURSIVE {b.TRIANGLES_SQL}, {_EDGES}, walk AS (SELECT a AS start, 0 AS ord, a AS v FROM e UNION ALL SELECT start, ord + 1, e.b FROM walk JOIN e ON e.a = walk.v WHERE e.b <> start),"
       " low AS (SELECT start FROM walk GROUP BY start HAVING min(v) = start) SELECT 1 AS mesh_id, (dense_rank() OVER (ORDER BY start) - 1)::INT AS loop, ord, v AS v_id FROM walk JOIN low USING (start)")
def boundary_loops(spark, d):
    """The height field's outline, ranked by pointer doubling."""
    tri = b.triangles(spark, d).withColumn("mesh_id", F.lit(1))
    return md.boundary_loops(m.boundary_edges(tri, ["mesh_id"]))


@query("stitched_wall")
def stitched_wall(spark, d):
    loops = boundary_loops(spark, d).join(b.vertices(spark, d).select("v_id", "x", "y"), "v_id")
    low = loops.withColumns({"side": F.lit(1), "v_id": F.col("v_id") + 1_000_000})
    return md.stitch_loops(loops.withColumn("side", F.lit(0)).unionByName(low))


@query("ordered_surfaces", f"""WITH {b.VERTICES_SQL}, two AS (SELECT v_id, x, y, z - 3 AS upper, z - v_id % 7 AS lower FROM vertices),
 first AS (SELECT u.v_id, u.x, u.y, u.upper, u.lower, arg_min(l.lower, (u.x-l.x)*(u.x-l.x)+(u.y-l.y)*(u.y-l.y)) AS met FROM two u JOIN two l ON abs(u.x-l.x) <= 100 AND abs(u.y-l.y) <= 100 GROUP BY ALL),
 raised AS (SELECT v_id, x, y, greatest(upper, met + 5.0) AS upper, lower FROM first)
 SELECT 0 AS surface_id, v_id, x, y, upper AS z FROM raised
 UNION ALL SELECT 1, l.v_id, l.x, l.y, least(l.lower, arg_min(u.upper, (u.x-l.x)*(u.x-l.x)+(u.y-l.y)*(u.y-l.y)) - 5.0) FROM raised l JOIN raised u ON abs(u.x-l.x) <= 100 AND abs(u.y-l.y) <= 100 GROUP BY l.v_id, l.x, l.y, l.lower""")
def ordered_surfaces(spark, d):
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = b.vertices(spark, d).select(two.alias("surface_id"), "v_id", "x", "y", "z")
    return md.enforce_order(rows.withColumn("z", F.col("z") - F.when(F.col("surface_id") == 1, F.col("v_id") % 7).otherwise(3)), [0, 1], 5.0)


def _unit(spark, d):
    stations = b.obs(spark, d)
    unit = fw.gravity(stations, fw.box_facets(b.boxes(spark, d)), ["group_id"], density=None).withColumnRenamed("response", "u")
    return unit.cache(), b.boxes(spark, d).select("group_id", "density")


@query("property_solve", "SELECT n_nationkey AS group_id, round(2.3 + 0.1 * n_regionkey, 3) AS density FROM nation")
def property_solve(spark, d):
    """Densities recovered from noise-free data of known boxes, within bounds."""
    unit, truth = _unit(spark, d)
    data = unit.join(truth, "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("density")).alias("value")).withColumn("std", F.lit(0.01))
    names, a, rhs = inv.normal_equations(unit, data)
    start = np.full(len(names), 2.5)
    x = inv.bounded_least_squares(a, rhs, start, start - 0.5, start + 0.5)
    return spark.createDataFrame([(int(n), round(float(v), 3)) for n, v in zip(names, x, strict=True)], "group_id int, density double")


@query("data_balance")
def data_balance(spark, d):
    unit, truth = _unit(spark, d)
    data = unit.groupBy("obs_id").agg(F.sum("u").alias("value")).withColumn("std", F.lit(0.01))
    _, a, _ = inv.normal_equations(unit, data)
    return spark.createDataFrame([(inv.largest_eigenvalue(a), inv.balance(a, 4.0 * a))], "top double, alpha double")


@query("bounded_descent")
def bounded_descent(spark, d):
    """History of quasi-Newton descent on the densities, misfit and gradient from Spark sums."""
    unit, truth = _unit(spark, d)
    data = unit.join(truth, "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("density")).alias("value")).withColumn("std", F.lit(0.01))
    names, a, rhs = inv.normal_equations(unit, data)
    scale = float(np.trace(a)) or 1.0
    opt = inv.Bounded(lambda x: float(0.5 * x @ a @ x - rhs @ x) / scale, lambda x: (a @ x - rhs) / scale, np.full(len(names), 2.0), np.full(len(names), 3.0), rounds=30)
    opt.minimise(np.full(len(names), 2.5))
    return spark.createDataFrame([(h["iteration"], h["objective"], h["projected_gradient"]) for h in opt.history], "iteration int, objective double, projected_gradient double")


@query("custom_regulariser", f"WITH {b.OBS_SQL} SELECT 'reference' AS term, round(0.3*sum(0.5*pow(value-2.0, 2)), 6) AS penalty FROM obs UNION ALL SELECT 'total_variation', round(0.1*sum(abs(value-before)), 6) FROM (SELECT value, lag(value) OVER (PARTITION BY line ORDER BY obs_id) AS before FROM obs)")
def custom_regulariser(spark, d):
    """A penalty added by name beside a built-in one: steps along each line, summed."""
    w = Window.partitionBy("line").orderBy("dof_id")
    hooks.register("regulariser", "total_variation", lambda p: p.select(F.abs(F.col("p") - F.lag("p").over(w)).alias("s")).agg(F.sum("s").alias("penalty")))
    p = b.obs(spark, d).select(F.col("obs_id").alias("dof_id"), F.col("value").alias("p"), F.lit(2.0).alias("p0"), "line")
    return hooks.penalties(p, {"reference": 0.3, "total_variation": 0.1}).select("term", F.round("penalty", 6).alias("penalty"))


@query("custom_validator", f"WITH {b.VERTICES_SQL}, m AS (SELECT z, z + (v_id % 7)*0.5 AS nz FROM vertices) SELECT 1 AS place, 'largest_step' AS \"check\", max(abs(nz-z)) <= 2.0 AS passed, round(max(abs(nz-z)), 6) AS worst FROM m UNION ALL SELECT 2, 'stays_below', max(nz) <= 1e4, round(max(nz), 6) FROM m")
def custom_validator(spark, d):
    """Two checks added by name, of a model against its start."""
    step = lambda start, now: start.select("v_id", F.col("z").alias("z0")).join(now, "v_id").agg(F.max(F.abs(F.col("z") - F.col("z0"))).alias("worst")).select((F.col("worst") <= 2.0).alias("passed"), "worst")
    hooks.register("validator", "largest_step", step)
    hooks.register("validator", "stays_below", lambda start, now: now.agg(F.max("z").alias("worst")).select((F.col("worst") <= 1e4).alias("passed"), "worst"))
    start = b.vertices(spark, d).select("v_id", "z")
    now = start.withColumn("z", F.col("z") + (F.col("v_id") % 7) * 0.5)
    return hooks.checks(start, now, ["largest_step", "stays_below"]).select("place", "check", "passed", F.round("worst", 6).alias("worst"))


@query("custom_optimiser", f"WITH {b.OBS_SQL} SELECT 'steepest' AS optimiser, segment, round(least(5.0, avg(value)), 4) AS level FROM obs GROUP BY segment UNION ALL SELECT 'bounded', segment, round(least(5.0, avg(value)), 4) FROM obs GROUP BY segment")
def custom_optimiser(spark, d):
    """Level of each segment by least squares: steepest descent added by name, and the built-in descent; every evaluation is a Spark sum."""
    rows = b.obs(spark, d).select("segment", "value")
    names = sorted(r[0] for r in rows.select("segment").distinct().collect())

    def sums(x):
        level = F.element_at(F.create_map(*[c for n, v in zip(names, x, strict=True) for c in (F.lit(n), F.lit(float(v)))]), F.col("segment"))
        found = {r.segment: r for r in rows.groupBy("segment").agg(F.avg(F.pow(F.col("value") - level, 2)).alias("f"), F.avg(level - F.col("value")).alias("g")).collect()}
        return [found[n] for n in names]

    value = lambda x: 0.5 * sum(r.f for r in sums(x))
    gradient = lambda x: np.array([r.g for r in sums(x)])

    def steepest(value, gradient, x, lower, upper, rounds):
        for _ in range(rounds):
            new = np.clip(x - gradient(x), lower, upper)
            if np.abs(new - x).max() < 1e-9:
                break
            x = new
        return x

    hooks.register("optimiser", "steepest", steepest)
    n = len(names)
    out = []
    for name in ("steepest", "bounded"):
        x = hooks.minimise(name, value, gradient, np.zeros(n), np.full(n, -50.0), np.full(n, 5.0), 20)
        out += [(name, s, round(float(v), 4) + 0.0) for s, v in zip(names, x, strict=True)]
    return spark.createDataFrame(out, "optimiser string, segment string, level double")


@query("depth_inversion")
def depth_inversion(spark, d):
    """One shared depth shift recovered by bounded descent; every evaluation is a Spark forward model.

    Stations carry their datum past the bodies, so a misfit is one pass with one sum and no join;
    both sides of a central difference are one pass.
    """
    boxes = b.boxes(spark, d).cache()
    observed, path = stored_at(fw.gravity(b.obs(spark, d).select("obs_id", "x", "y", "z"), fw.box_facets(boxes), keep=["x", "y", "z"]).withColumnRenamed("response", "value"))
    top = float(observed.agg(F.max(F.abs("value"))).first()[0])

    def misfits(shifts):
        moved = boxes.withColumn("shift", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s) * 100.0).alias("m")) for i, s in enumerate(shifts)])))
        moved = moved.select("cx", "cy", (F.col("cz") + F.col("shift.m")).alias("cz"), "half", "density", F.col("shift.i").alias("side"))
        got = fw.gravity(observed, fw.box_facets(moved), ["side"], keep=["value"]).groupBy("side").agg(F.sum(F.pow((F.col("response") - F.col("value")) / top, 2)).alias("f"))
        return [r["f"] for r in got.orderBy("side").collect()]

    def value(p):
        return float(misfits([p[0]])[0])

    def gradient(p):
        above, below = misfits([p[0] + 1e-4, p[0] - 1e-4])
        return np.array([(above - below) / 2e-4])

    opt = inv.Bounded(value, gradient, np.array([-1.0]), np.array([1.0]), rounds=4)
    found = opt.minimise(np.array([0.3]))
    discard(spark, path)
    return spark.createDataFrame([(h["iteration"], h["objective"], float(found[0])) for h in opt.history], "iteration int, objective double, shift double")
