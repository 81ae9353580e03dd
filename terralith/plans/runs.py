"""Queries on whole inversion runs: Jacobians, property solves, constraints, gates, the loop."""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.functions.geometry import G_MGAL
from terralith.operators import forward as fw
from terralith.operators import inversion as inv
from terralith.operators import isosurface as iso
from terralith.operators import locate
from terralith.operators import runs
from terralith.operators.storage import stored
from terralith.plans import bindings as b
from terralith.plans import shapes
from terralith.plans import sqlgen as s
from terralith.plans.registry import query

_MOVED = "moved AS (SELECT group_id, sgn, cx, cy, cz + 5.0*sgn AS cz, half, density, susceptibility FROM boxes, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) m(sgn))"


@query("depth_jacobian", f"WITH {b.OBS_SQL},\n{b.BOXES_SQL},\n{_MOVED},\n{s.box_facets('moved', 'group_id, sgn, density')},\npair AS (SELECT * FROM obs, facets),\n{s.pair_ctes()}\n SELECT obs_id, group_id AS dof, round(sum(sgn*{G_MGAL}::DOUBLE*density*{s.gravity_term()})/10.0*1e6, 3) AS j FROM k4 GROUP BY 1, 2")
def depth_jacobian(spark, d):
    """Change of gravity (in 1e-6 mGal/m) by the depth of each box, all boxes in one job."""
    boxes, stations = b.boxes(spark, d), b.obs(spark, d)

    def response(moves):
        moved = boxes.join(F.broadcast(moves), boxes["group_id"] == moves["dof"]).withColumn("cz", F.col("cz") + F.col("delta"))
        return fw.gravity(stations, fw.box_facets(moved), ["dof", "sign"])

    dofs = boxes.select(F.col("group_id").alias("dof"))
    return runs.central_jacobian(response, dofs, 5.0).select("obs_id", "dof", F.round(F.col("j") * 1e6, 3).alias("j"))


@query("tmi_facet_gradient")
def tmi_facet_gradient(spark, d):
    """Derivatives of the magnetic facet factor by every corner coordinate."""
    field = (0.3, 0.2, -0.93)
    facets = fw.box_facets(b.boxes(spark, d)).withColumns({f"m_{a}": F.lit(x) for a, x in zip("xyz", field, strict=True)})
    return fw.facet_gradient(b.obs(spark, d), facets, kind="tmi", field=field)


_KEPT = f"WITH {b.OBS_SQL},\n{b.BOXES_SQL},\n{s.box_facets()},\npair AS (SELECT * FROM obs, facets),\n{s.pair_ctes()}\n"


@query("custom_kernel", f"{_KEPT} SELECT obs_id, round(sum(om*nz*density), 6) + 0.0 AS response FROM k4 GROUP BY obs_id")
def custom_kernel(spark, d):
    """A kernel added by name, summed like the built-in ones."""
    fw.register_kernel("upward_angle", lambda: F.col("om") * F.col("nz"), lambda p: p["om"] * p["n"][None, :, 2])
    out = fw.forward(b.obs(spark, d), fw.box_facets(b.boxes(spark, d)), "upward_angle", F.col("density"))
    return out.select("obs_id", (F.round("response", 6) + 0.0).alias("response"))


@query("observation_grid", "WITH n AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM customer) SELECT i AS obs_id, (i % n)*250.0-875.0 AS x, (i // n)*250.0-875.0 AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS value, 0.01::DOUBLE AS std FROM n, unnest(range(n*n)) t(i)")
def observation_grid(spark, d):
    """The largest square grid that has no more stations than there are customers."""
    return runs.observation_grid(spark, isqrt(b.read(spark, d, "customer").count()), 875.0, 250.0)


def _near_boxes(spark, d):
    """Five boxes side by side, one for each region, with their properties."""
    r = F.col("r_regionkey")
    return b.read(spark, d, "region").select(r.alias("group_id"), (r * 400.0 - 800.0).alias("cx"), (r * 100.0 - 200.0).alias("cy"), (-150.0 - r * 20.0).alias("cz"), F.lit(100.0).alias("half"),
                                             (0.2 + 0.1 * r).alias("density"), (0.02 + 0.01 * r).alias("susceptibility"))


def _stations(spark):
    return runs.observation_grid(spark, 12, 1100.0, 200.0)


@query("susceptibility_solve", "SELECT r_regionkey AS group_id, 'chi' AS part, round(0.02+0.01*r_regionkey, 6) AS value FROM region")
def susceptibility_solve(spark, d):
    """Susceptibilities recovered from noise-free data: they are the boxes' own."""
    boxes, stations = _near_boxes(spark, d), _stations(spark)
    units = runs.unit_magnetics(stations, fw.box_facets(boxes), -68.0, 0.5, 58874.0)
    data = units.join(boxes.select("group_id", "susceptibility"), "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("susceptibility")).alias("value")).withColumn("std", F.lit(5.0))
    found = runs.solve_properties(units, data, {"chi": 0.01}, {"chi": 0.0}, {"chi": 1.0})
    return spark.createDataFrame([(int(g), p, round(v, 6) + 0.0) for (g, p), v in found.items()], "group_id int, part string, value double")


@query("remanence_solve")
def remanence_solve(spark, d):
    """Susceptibility and remanence vector of each box, damped: induced and remanent parts overlap."""
    boxes, stations = _near_boxes(spark, d), _stations(spark)
    units = runs.unit_magnetics(stations, fw.box_facets(boxes), -68.0, 0.5, 58874.0, "vector")
    data = units.filter("part = 'chi'").join(boxes.select("group_id", "susceptibility"), "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("susceptibility")).alias("value")).withColumn("std", F.lit(5.0))
    start, low, high = {"chi": 0.03, "mx": 0.0, "my": 0.0, "mz": 0.0}, {"chi": 0.0, "mx": -10.0, "my": -10.0, "mz": -10.0}, {"chi": 1.0, "mx": 10.0, "my": 10.0, "mz": 10.0}
    found = runs.solve_properties(units, data, start, low, high, damping=1e-4)
    return spark.createDataFrame([(int(g), p, v) for (g, p), v in found.items()], "group_id int, part string, value double")


@query("conductivity_solve", "SELECT r_regionkey AS group_id, round(0.001*(r_regionkey+1), 4) AS sigma FROM region")
def conductivity_solve(spark, d):
    """Conductivities of the bodies from their decays at the customers' places, errors of 1e-5 included.

    Responses fall with the root of the conductivity, so the solve is a damped Gauss-Newton loop.
    """
    boxes = _near_boxes(spark, d).select("group_id", "cx", "cy", "cz")
    k = F.col("c_custkey")
    visits = b.read(spark, d, "customer").select((k % 144).alias("place"), ((F.col("c_acctbal") * 100) % 101 / 50.0 - 1.0).alias("e"))
    places = visits.groupBy("place").agg(F.avg("e").alias("e")).select("place", ((F.col("place") % 12) * 200.0 - 1100.0).alias("x"), (F.floor(F.col("place") / 12) * 200.0 - 1100.0).alias("y"), "e")
    gates = F.explode(F.array(*[F.struct(F.lit(i).alias("gate"), F.lit(x).alias("t")) for i, x in enumerate((1e-4, 4e-4, 1.6e-3))]))
    at = places.withColumn("g", gates).select((F.col("place") * 3 + F.col("g.gate")).alias("obs_id"), "x", "y", "e", F.col("g.t").alias("time"))
    far = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow("cz", 2))
    pairs = stored(at.crossJoin(F.broadcast(boxes)).select("obs_id", "group_id", "time", far.alias("distance"), "e"))
    truth = pairs.withColumn("r", g.active_response(0.001 * (F.col("group_id") + 1), F.col("time"), F.col("distance")))
    data = stored(truth.groupBy("obs_id").agg(F.sum("r").alias("r"), F.first("e").alias("e")).select("obs_id", (F.col("r") * (1 + 1e-5 * F.col("e"))).alias("value"), (F.col("r") * 1e-3).alias("std")))
    found = runs.solve_conductivities(pairs, data, 0.01, 1e-6, 1.0)
    return spark.createDataFrame([(int(n), round(v, 4) + 0.0) for n, v in found.items()], "group_id int, sigma double")


_CONS = """cons AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity::INT) AS obs_id, (l_suppkey*37 % 5000)::DOUBLE AS x, (l_partkey*7 % 1400)::DOUBLE AS y, 200.0+l_linenumber*20.0 AS z_top, 200.0+l_linenumber*20.0+l_quantity::DOUBLE AS z_bottom, (l_suppkey % 27 - 1)::INT AS want FROM lineitem)"""
_IN = "x >= cx-50 AND x < cx+50 AND y+1.234567e-6 BETWEEN cy-50 AND cy+50 AND z+2.345678e-6 BETWEEN cz-50 AND cz+50"


def _constraints(spark, d):
    k, li = F.col("l_orderkey"), F.col("l_linenumber")
    own = F.concat_ws("/", k, li, "l_suppkey", "l_partkey", F.col("l_quantity").cast("int"))
    return b.read(spark, d, "lineitem").select(own.alias("obs_id"), (F.col("l_suppkey") * 37 % 5000).cast("double").alias("x"), (F.col("l_partkey") * 7 % 1400).cast("double").alias("y"),
                                               (200.0 + li * 20.0).alias("z_top"), (200.0 + li * 20.0 + F.col("l_quantity").cast("double")).alias("z_bottom"), (F.col("l_suppkey") % 27 - 1).cast("int").alias("litho_group_id")).distinct()


@query("borehole_penalty", f"WITH {b.BOXES_SQL}, {_CONS}, mid AS (SELECT *, -(z_top+z_bottom)/2 AS z, abs(z_bottom-z_top) AS t FROM cons), f AS (SELECT mid.obs_id, any_value(t) AS t, any_value(want) AS want, coalesce(min(group_id), -1) AS g FROM mid LEFT JOIN boxes ON {_IN} GROUP BY 1) SELECT round(sum(CASE WHEN g <> want THEN 0.5*t*t ELSE 0 END), 3) AS penalty FROM f")
def borehole_penalty(spark, d):
    """Penalty of intervals whose middle lies in another body than the log says."""
    return runs.constraint_penalty(_constraints(spark, d), fw.box_facets(b.boxes(spark, d)), 0.5).select(F.round("penalty", 3).alias("penalty"))


_GRAD = f"""v AS (SELECT r.r_regionkey AS dof, sgn, group_id, cx, cy, cz + CASE WHEN group_id % 5 = r.r_regionkey THEN 40.0*sgn ELSE 0 END AS cz FROM boxes, region r, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) m(sgn)),
mid AS (SELECT *, -(z_top+z_bottom)/2 AS z, abs(z_bottom-z_top) AS t FROM cons), hit AS (SELECT dof, sgn, obs_id, min(group_id) AS g FROM mid JOIN v ON {_IN} GROUP BY ALL),
p AS (SELECT r_regionkey AS dof, s.sgn, sum(CASE WHEN coalesce(h.g, -1) <> want THEN t*t ELSE 0 END) AS p FROM mid CROSS JOIN region r CROSS JOIN (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(sgn) LEFT JOIN hit h ON h.dof = r_regionkey AND h.sgn = s.sgn AND h.obs_id = mid.obs_id GROUP BY ALL)"""


@query("borehole_gradient", f"WITH {b.BOXES_SQL}, {_CONS}, {_GRAD} SELECT dof, round(sum(sgn*p)/80.0, 3) AS gradient FROM p GROUP BY dof")
def borehole_gradient(spark, d):
    """Its change with the depth of every fifth body, all model variants in one job."""
    boxes = b.boxes(spark, d)

    def moved(moves):
        shift = F.when(F.col("group_id") % 5 == F.col("dof"), F.col("delta")).otherwise(0.0)
        return fw.box_facets(boxes.crossJoin(F.broadcast(moves)).withColumn("cz", F.col("cz") + shift).select("group_id", "variant", "cx", "cy", "cz", "half"))

    dofs = b.read(spark, d, "region").select(F.col("r_regionkey").alias("dof"))
    return runs.constraint_gradient(_constraints(spark, d), moved, dofs, 40.0).select("dof", F.round("gradient", 3).alias("gradient"))


def _crowded(spark, d):
    """The nations' boxes widened until neighbours overlap, with their corners as vertices."""
    boxes = b.boxes(spark, d).select("group_id", "cx", "cy", "cz", F.lit(110.0).alias("half"))
    signs = F.explode(F.array(*[F.struct(F.lit(i).alias("v_id"), *[F.lit(float((i >> k & 1) * 2 - 1)).alias(a) for k, a in zip((2, 1, 0), "xyz", strict=True)]) for i in range(8)]))
    corner = boxes.select("group_id", "cx", "cy", "cz", signs.alias("s"))
    vertices = corner.select("group_id", F.col("s.v_id").alias("v_id"), *[(F.col(f"c{a}") + 110.0 * F.col(f"s.{a}")).alias(a) for a in "xyz"])
    return vertices, fw.box_facets(boxes)


_CROWD = f"""WITH {b.BOXES_SQL}, corners AS (SELECT group_id, i AS v_id, cx+110*((i//4)*2-1) AS x, cy+110*((i//2%2)*2-1) AS y, cz+110*((i%2)*2-1) AS z FROM boxes, range(8) t(i)),
cls AS (SELECT c.group_id AS own, c.v_id, min(o.group_id) AS g FROM corners c JOIN boxes o ON c.x >= o.cx-110 AND c.x < o.cx+110 AND c.y+1.234567e-6 BETWEEN o.cy-110 AND o.cy+110 AND c.z+2.345678e-6 BETWEEN o.cz-110 AND o.cz+110 GROUP BY 1, 2),
n AS (SELECT count(CASE WHEN abs(g-own) = 1 THEN 1 END) AS adjacent, count(CASE WHEN abs(g-own) > 1 THEN 1 END) AS far FROM cls)"""


@query("vertex_overlaps", f"{_CROWD} SELECT adjacent, far AS distant FROM n")
def vertex_overlaps(spark, d):
    return runs.vertex_overlaps(*_crowded(spark, d))


@query("model_gate", f"{_CROWD} SELECT * FROM (SELECT 1 AS place, 'shared_gap' AS \"check\", true AS passed, 0.0::DOUBLE AS worst UNION ALL SELECT 2, 'adjacent_overlap', adjacent <= 2, adjacent FROM n UNION ALL SELECT 3, 'distant_overlap', far <= 120, far FROM n UNION ALL SELECT 4, 'tearing', true, 0.0 UNION ALL SELECT 5, 'bounding_box', true, 0.0 UNION ALL SELECT 6, 'spikes', false, round(sqrt(3*pow(220.0*4/7, 2))/((SELECT greatest(max(cx)-min(cx), max(cy)-min(cy))+220 FROM boxes)*0.02), 6))")
def model_gate(spark, d):
    """All six checks of a model of overlapping boxes, with a strict allowance and spike limit."""
    vertices, facets = _crowded(spark, d)
    mesh = vertices.withColumnRenamed("group_id", "mesh_id")
    now = mesh.withColumn("freedom", F.when(F.col("v_id") % 2 == 0, "FIXED").otherwise("XYZ_FREE"))
    ids = F.array(*[F.lit(i) for i in range(8)])
    edges = mesh.select("mesh_id", F.col("v_id").alias("a"), F.explode(ids).alias("b")).filter("a <> b")
    three = runs.gate(mesh, now, edges, facets, adjacent_more=2)
    # spikes of a box are its corners: a tenth of the usual limit shows them
    tight = F.when(F.col("check") == "spikes", F.col("worst") * 10).otherwise(F.col("worst"))
    return three.select("place", "check", F.when(F.col("check") == "spikes", tight <= 1).otherwise(F.col("passed")).alias("passed"), F.round(tight, 6).alias("worst"))


@query("model_bottom", "SELECT -100.0*(count(*)-1)-50-100 AS bottom, round(-50-0.01*100, 6) AS x_lo, round(50+0.01*100, 6) AS x_hi, round(-100.0*(count(*)-1)-50-0.01*(100.0*count(*)), 6) AS z_lo FROM nation")
def model_bottom(spark, d):
    """Bottom and box of the finished model of stacked boxes."""
    done = _finished(spark, d)
    return done.bounds.select(F.lit(done.bottom).alias("bottom"), *[F.round(c, 6).alias(c) for c in ("x_lo", "x_hi", "z_lo")])


@query("finished_model")
def finished_model(spark, d):
    """Freedom of every vertex of the stacked boxes after set-up."""
    return _finished(spark, d).freedom


def _finished(spark, d):
    facets = shapes._stack(spark, d).withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "cz": -100.0 * F.col("group_id")})
    rows = facets.select(F.col("group_id").alias("mesh_id"), "t_id", *shapes._corner_ids(), *fw.CORNERS)
    corner = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("v_id"), *[F.col(f"{c}{a}").alias(a) for a in "xyz"]) for i, c in enumerate("pqr")]))
    vertices = rows.select("mesh_id", corner.alias("v")).select("mesh_id", "v.*").distinct()
    return runs.finalise(vertices, rows)


_ALONG = f"WITH {b.VERTICES_SQL}, k AS (SELECT *, v_id % 3 AS m, x*0.6 + z*0.8 AS along FROM vertices)"


@query("applied_parameters", f"{_ALONG} SELECT v_id, CASE m WHEN 0 THEN x+10*0.6 ELSE x END AS x, CASE m WHEN 1 THEN y+4.0 ELSE y END AS y, round(CASE m WHEN 0 THEN z+10*0.8 WHEN 1 THEN z+7.0 ELSE z END, 6) AS z FROM k")
def applied_parameters(spark, d):
    """Vertices moved along a direction, along axes with scales, or not at all."""
    v = _free(spark, d)
    scales = {"x": 2.0, "y": 2.0, "z": 0.5}
    step = F.when(F.col("axis") == "v", 10.0).when(F.col("axis") == "y", 4.0 / 2.0).when(F.col("axis") == "z", 7.0 / 0.5).otherwise(0.0)
    moved = runs.extract_parameters(v, scales).withColumn("value", F.col("value") + step)
    return runs.apply_parameters(v, moved, scales).select("v_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("extracted_parameters", f"{_ALONG} SELECT v_id, 'v' AS axis, round(along, 6) AS value FROM k WHERE m = 0 UNION ALL SELECT v_id, a, round(CASE a WHEN 'x' THEN x/2 WHEN 'y' THEN y/2 ELSE z/0.5 END, 6) FROM k, (VALUES ('x'), ('y'), ('z')) t(a) WHERE m = 1")
def extracted_parameters(spark, d):
    out = runs.extract_parameters(_free(spark, d), {"x": 2.0, "y": 2.0, "z": 0.5})
    return out.select("v_id", "axis", F.round("value", 6).alias("value"))


def _free(spark, d):
    k = F.col("v_id") % 3
    v = b.vertices(spark, d).select(F.lit(0).alias("mesh_id"), "v_id", "x", "y", "z", F.when(k == 0, "ALONG_VECTOR").when(k == 1, "XYZ_FREE").otherwise("FIXED").alias("freedom"))
    return v.withColumns({"dx": F.lit(3.0), "dy": F.lit(0.0), "dz": F.lit(4.0)})


@query("contact_surface", "WITH h AS (SELECT l_suppkey AS hole, min(l_extendedprice)/100 AS depth FROM lineitem GROUP BY 1), c AS (SELECT (hole*131 % 3000)::DOUBLE AS x, (hole*17 % 2000)::DOUBLE AS y, -depth AS z FROM h), o AS (SELECT i AS obs_id, (i % 8)*250.0-875.0 AS gx, (i // 8)*250.0-875.0 AS gy FROM range(64) t(i)), w AS (SELECT obs_id, z, 1.0/greatest(pow(gx-x, 2)+pow(gy-y, 2), 1.0) AS w FROM o, c) SELECT obs_id, round(sum(w*z)/sum(w), 6) AS z FROM w GROUP BY 1")
def contact_surface(spark, d):
    """A contact's height on a grid from the depths where drill holes meet it."""
    holes = b.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("hole")).agg((F.min("l_extendedprice") / 100).alias("depth"))
    contacts = holes.select((F.col("hole") * 131 % 3000).cast("double").alias("sx"), (F.col("hole") * 17 % 2000).cast("double").alias("sy"), (-F.col("depth")).alias("sz"))
    return locate.idw(runs.observation_grid(spark, 8, 875.0, 250.0), contacts).select("obs_id", F.round("z", 6).alias("z"))


@query("gradient_balance", "WITH g AS (SELECT sum(c_acctbal) AS a, sum(c_nationkey) AS b FROM customer) SELECT 'eigenvalues' AS rule, 0.25::DOUBLE AS alpha UNION ALL SELECT 'clipped', 1e6 UNION ALL SELECT 'gradients', round(sqrt(a*a+b*b)/abs(a), 9) FROM g UNION ALL SELECT 'neither', 1.0")
def gradient_balance(spark, d):
    """Weight of the second data set by each of its rules: normal matrices of the boxes, gradients from the customers' sums."""
    units = fw.gravity(_stations(spark), fw.box_facets(_near_boxes(spark, d)), ["group_id"], density=None).withColumnRenamed("response", "u")
    data = units.groupBy("obs_id").agg(F.sum("u").alias("value")).withColumn("std", F.lit(0.01))
    _, one, _ = inv.normal_equations(units, data)
    a, c = b.read(spark, d, "customer").agg(F.sum("c_acctbal"), F.sum("c_nationkey")).first()
    none = 0 * one
    rows = [("eigenvalues", inv.balance(one, 4 * one)), ("clipped", inv.balance(1e9 * one, one)), ("gradients", inv.balance(one, none, (np.array([a, c], float), np.array([0.0, a])))), ("neither", inv.balance(one, none))]
    return spark.createDataFrame([(n, round(float(v), 9)) for n, v in rows], "rule string, alpha double")


@query("density_clusters", f"WITH {b.VOXELS_SQL}, bare AS (SELECT * EXCLUDE (label) FROM voxels), {s.mixture('bare', ['density'], 4, 'fitted')} SELECT label, count(*) AS n FROM fitted GROUP BY label")
def density_clusters(spark, d):
    """Clusters by density alone."""
    from terralith.operators import clustering as cl

    return cl.mixture_labels(b.voxels(spark, d), ["density"], 4).groupBy("label").agg(F.count("*").alias("n"))


def _descent(spark, d):
    boxes, stations = _near_boxes(spark, d), _stations(spark)
    units = fw.gravity(stations, fw.box_facets(boxes), ["group_id"], density=None).withColumnRenamed("response", "u")
    data = units.join(boxes.select("group_id", "density"), "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("density")).alias("value")).withColumn("std", F.lit(0.01))
    names, a, rhs = inv.normal_equations(units, data)
    scale = float(np.trace(a)) / len(names)
    return names, (lambda x: float(0.5 * x @ a @ x - rhs @ x) / scale), (lambda x: (a @ x - rhs) / scale)


_TRUE = "SELECT r_regionkey AS group_id, round(0.2+0.1*r_regionkey, 3) AS density FROM region"


@query("newton_descent", _TRUE)
def newton_descent(spark, d):
    """Densities by Newton steps from gradient differences, both sides of a difference in one job: the boxes' own.

    The data carry errors of up to 1e-4 of their size from the customers' balances.
    """
    boxes, stations = _near_boxes(spark, d), _stations(spark)
    units = stored(fw.gravity(stations, fw.box_facets(boxes), ["group_id"], density=None).withColumnRenamed("response", "u"))
    errors = b.read(spark, d, "customer").groupBy((F.col("c_custkey") % 144).alias("obs_id")).agg(F.avg((F.col("c_acctbal") * 100) % 101 / 50.0 - 1.0).alias("e"))
    true = units.join(boxes.select("group_id", "density"), "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("density")).alias("v"))
    data = stored(true.join(errors, "obs_id").select("obs_id", (F.col("v") * (1 + 1e-4 * F.col("e"))).alias("value"), F.lit(0.01).alias("std")))
    names = sorted(r["group_id"] for r in boxes.select("group_id").collect())

    def at(points):
        return inv.misfit_gradients(units, data, names, points)

    n = len(names)
    x = inv.newton_cg(lambda p: at([p])[0][0], lambda p: at([p])[1][0], np.full(n, 0.3), np.zeros(n), np.ones(n), rounds=8, inner=8, gradients=lambda points: at(points)[1])
    return spark.createDataFrame([(int(m), round(float(v), 3) + 0.0) for m, v in zip(names, x, strict=True)], "group_id int, density double")


@query("plain_steps")
def plain_steps(spark, d):
    """Quasi-Newton descent whose projected steps are taken whole, without line search."""
    names, value, gradient = _descent(spark, d)
    opt = inv.Bounded(value, gradient, np.zeros(len(names)), np.ones(len(names)), rounds=60, line_search=False)
    x = opt.minimise(np.full(len(names), 0.3))
    return spark.createDataFrame([(int(n), float(v)) for n, v in zip(names, x, strict=True)], "group_id int, density double")


@query("alternating_inversion", "SELECT r_regionkey AS group_id, round(0.2+0.1*r_regionkey, 2) AS density, 'within half a metre' AS state FROM region")
def alternating_inversion(spark, d):
    """Depth shift and densities in turn, each geometry step behind a validation gate.

    Starts 30 m too deep with equal densities; the data are the true model's, so both come back
    (to half a metre and two places after fourteen turns).
    """
    boxes, stations = _near_boxes(spark, d).cache(), _stations(spark).cache()
    names = sorted(r["group_id"] for r in boxes.select("group_id").collect())

    def units(shift):
        moved = boxes.withColumn("cz", F.col("cz") + float(shift) * 100.0)
        return fw.gravity(stations, fw.box_facets(moved), ["group_id"], density=None).withColumnRenamed("response", "u")

    data = units(0.0).join(boxes.select("group_id", "density"), "group_id").groupBy("obs_id").agg(F.sum(F.col("u") * F.col("density")).alias("value")).withColumn("std", F.lit(0.01)).cache()
    size = float(data.agg(F.sum(F.col("value") * F.col("value"))).first()[0])

    def solve(parameters, _properties):
        found = runs.solve_properties(units(parameters[0]).withColumn("part", F.lit("rho")), data, {"rho": 0.4}, {"rho": 0.0}, {"rho": 1.0})
        return {g: v for (g, _), v in found.items()}

    def minimise(parameters, properties, rounds):
        density = F.element_at(F.create_map(*[x for g, v in properties.items() for x in (F.lit(g), F.lit(v))]), F.col("group_id"))

        def value(p):
            got = units(p[0]).withColumn("v", F.col("u") * density).groupBy("obs_id").agg(F.sum("v").alias("p")).join(data, "obs_id")
            return float(got.agg(F.sum(F.pow(F.col("p") - F.col("value"), 2))).first()[0]) / size

        # one parameter: the misfit's parabola through three points gives its lowest point
        h = 0.05
        low, mid, high = value(parameters - h), value(parameters), value(parameters + h)
        bend = low - 2 * mid + high
        move = -h * (high - low) / (2 * bend) if bend > 0 else -np.sign(high - low) * h
        new = np.clip(parameters + np.clip(move, -0.5, 0.5), -1.0, 1.0)
        return new, 0 if abs(float(new[0] - parameters[0])) < 1e-5 else 1, False

    loop = runs.Alternating(minimise, lambda p: bool(abs(p[0]) <= 0.35), solve, most=14, interval=1)
    shift, properties = loop.run(np.array([-0.3]), {g: 0.4 for g in names})
    state = "within half a metre" if abs(float(shift[0])) < 5e-3 else f"shift {float(shift[0]):.4f}"
    return spark.createDataFrame([(int(g), round(properties[g], 2) + 0.0, state) for g in names], "group_id int, density double, state string")




_NEAR27 = "step(a, b, c) AS (SELECT a.a-1, b.a-1, c.a-1 FROM range(3) a(a), range(3) b(a), range(3) c(a))"
_CLOSED = f"""WITH col AS (SELECT p_size % 4 AS label, p_partkey % 5 AS ix, p_partkey // 5 % 5 AS iy, p_partkey // 25 AS iz FROM part), {_NEAR27}, top AS (SELECT max(iz) AS nz FROM col),
wide AS (SELECT DISTINCT label, ix+a AS ix, iy+b AS iy, iz+c AS iz FROM col, step, top WHERE ix+a BETWEEN 0 AND 4 AND iy+b BETWEEN 0 AND 4 AND iz+c BETWEEN 0 AND nz)"""


@query("closed_labels", f"{_CLOSED} SELECT w.label, w.ix, w.iy, w.iz FROM wide w, step JOIN wide o ON o.label = w.label AND o.ix = w.ix+a AND o.iy = w.iy+b AND o.iz = w.iz+c GROUP BY ALL HAVING count(*) = 27")
def closed_labels(spark, d):
    """Each label's cells after a morphological closing, in a column five cells wide."""
    k = F.col("p_partkey")
    cells = b.read(spark, d, "part").select((F.col("p_size") % 4).alias("label"), (k % 5).alias("ix"), (F.floor(k / 5) % 5).alias("iy"), F.floor(k / 25).alias("iz"))
    return iso.closing(cells, (5, 5, int(cells.agg(F.max("iz")).first()[0]) + 1))


@query("label_surfaces", f"WITH {b.VOXELS_SQL}, {_NEAR27}, s AS (SELECT DISTINCT label, ix, iy, iz FROM voxels), dir AS (SELECT * FROM step WHERE (a >= 0 AND b >= 0 AND c >= 0 OR a <= 0 AND b <= 0 AND c <= 0) AND NOT (a = 0 AND b = 0 AND c = 0)) SELECT s.label, count(*) AS n_vertices, 0 AS n_open_edges FROM s, dir LEFT JOIN s o ON o.label = s.label AND o.ix = s.ix+a AND o.iy = s.iy+b AND o.iz = s.iz+c WHERE o.label IS NULL GROUP BY 1")
def label_surfaces(spark, d):
    """Vertices of the closed surface of each label, and how many of its edges are not shared by two faces."""
    v, t = iso.surfaces(b.voxels(spark, d))
    # every directed edge must be met by as many opposite ones
    odd = F.coalesce("n_open_edges", F.lit(0)).alias("n_open_edges")
    return v.groupBy("label").agg(F.count("*").alias("n_vertices")).join(iso.open_edges(t), "label", "left").select("label", "n_vertices", odd)


@query("label_surface_text")
def label_surface_text(spark, d):
    """TSurf text of every label's surface with its mean properties."""
    cells = b.voxels(spark, d)
    v, t = iso.surfaces(cells, (0.0, 0.0, 100.0), (50.0, 50.0, 20.0))
    means = cells.groupBy("label").agg(F.avg("density").alias("density"), F.avg("susceptibility").alias("susceptibility"))
    return iso.surface_lines(v, t, means, "ts")
