"""Queries on survey rows, residuals and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import residual as r
from terralith.plans import bindings as b
from terralith.plans.registry import query

_PRED = "pred AS (SELECT *, 0.5::DOUBLE * value + 0.1 AS predicted FROM obs)"
_W = "(CASE WHEN std > 0 THEN 1.0/std ELSE 1.0 END)"


def _pred(spark, d):
    return b.obs(spark, d).withColumn("predicted", 0.5 * F.col("value") + 0.1)


@query("local_coordinates", f"WITH {b.OBS_SQL} SELECT obs_id, x-2000.0 AS lx, y-1000.0 AS ly, z-250.0 AS lz, (x-2000.0)+2000.0 AS ux FROM obs")
def local_coordinates(spark, d):
    x, y, z = r.local(F.col("x"), F.col("y"), F.col("z"), (2000.0, 1000.0, 250.0))
    back = r.local(x, y, z, (2000.0, 1000.0, 250.0), inverse=True)
    return b.obs(spark, d).select("obs_id", x.alias("lx"), y.alias("ly"), z.alias("lz"), back[0].alias("ux"))


@query("survey_frame", f"WITH {b.OBS_SQL} SELECT (min(x)+max(x))/2 AS x0, (min(y)+max(y))/2 AS y0, avg(z) AS datum FROM obs")
def survey_frame(spark, d):
    return r.survey_frame(b.obs(spark, d))


@query("sign_and_rmi", "SELECT o_orderkey AS obs_id, -o_totalprice AS g, o_totalprice - 58874.0 AS rmi FROM orders")
def sign_and_rmi(spark, d):
    return b.read(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id"), (-F.col("o_totalprice")).alias("g"), (F.col("o_totalprice") - 58874.0).alias("rmi"))


@query("default_uncertainty", f"WITH {b.OBS_SQL} SELECT obs_id, CASE WHEN std <= 0 THEN 0.005::DOUBLE ELSE std END AS std FROM obs")
def default_uncertainty(spark, d):
    return b.obs(spark, d).select("obs_id", r.default_uncertainty(F.col("std"), 0.005).alias("std"))


@query("weighted_residuals", f"WITH {b.OBS_SQL}, {_PRED} SELECT obs_id, round({_W}*(value-predicted), 9) AS wr FROM pred")
def weighted_residuals(spark, d):
    return _pred(spark, d).select("obs_id", F.round(r.weight(F.col("std")) * (F.col("value") - F.col("predicted")), 9).alias("wr"))


@query("weighted_misfit", f"WITH {b.OBS_SQL}, {_PRED} SELECT round(sum(0.5*pow({_W}*(value-predicted),2)), 6) AS misfit, round(sqrt(avg(pow(value-predicted,2))), 6) AS rms, count(*) AS n FROM pred")
def weighted_misfit(spark, d):
    m = r.misfit(_pred(spark, d))
    return m.select(F.round("misfit", 6).alias("misfit"), F.round("rms", 6).alias("rms"), "n")


@query("rms_by_segment", f"WITH {b.OBS_SQL}, {_PRED} SELECT segment, round(sum(0.5*pow({_W}*(value-predicted),2)), 6) AS misfit, round(sqrt(avg(pow(value-predicted,2))), 6) AS rms, count(*) AS n FROM pred GROUP BY segment")
def rms_by_segment(spark, d):
    m = r.misfit(_pred(spark, d), ["segment"])
    return m.select("segment", F.round("misfit", 6).alias("misfit"), F.round("rms", 6).alias("rms"), "n")


@query("misfit_gradient", f"WITH {b.OBS_SQL}, {_PRED}, j AS (SELECT o_custkey AS obs_id, o_orderkey % 50 AS dof, sum(o_totalprice/1e5) AS j FROM orders GROUP BY 1, 2) SELECT dof, round(sum(-j*{_W}*{_W}*(value-predicted)), 6) AS gradient FROM j JOIN pred USING (obs_id) GROUP BY dof")
def misfit_gradient(spark, d):
    j = b.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_id"), (F.col("o_orderkey") % 50).alias("dof")).agg(F.sum(F.col("o_totalprice") / 1e5).alias("j"))
    rows = r.misfit_gradient(j, _pred(spark, d).select("obs_id", (F.col("value") - F.col("predicted")).alias("r"), "std"))
    return rows.select("dof", F.round("gradient", 6).alias("gradient"))


@query("jacobian_norms", "WITH j AS (SELECT o_custkey AS obs_id, o_orderkey % 50 AS dof, sum(o_totalprice/1e5) AS j FROM orders GROUP BY 1, 2), g AS (SELECT dof, sum(j*(obs_id % 7)) AS g FROM j GROUP BY dof) SELECT (SELECT round(max(abs(j)), 6) FROM j) AS j_max, (SELECT round(avg(abs(j)), 6) FROM j) AS j_mean, round(sqrt(sum(g*g)), 4) AS gradient_norm FROM g")
def jacobian_norms(spark, d):
    j = b.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_id"), (F.col("o_orderkey") % 50).alias("dof")).agg(F.sum(F.col("o_totalprice") / 1e5).alias("j"))
    per = j.groupBy("dof").agg(F.sum(F.col("j") * (F.col("obs_id") % 7)).alias("g"), F.max(F.abs("j")).alias("top"), F.sum(F.abs("j")).alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.max("top"), 6).alias("j_max"), F.round(F.sum("s") / F.sum("n"), 6).alias("j_mean"), F.round(F.sqrt(F.sum(F.col("g") ** 2)), 4).alias("gradient_norm"))


@query("joint_objective", f"WITH {b.OBS_SQL}, {_PRED}, c AS (SELECT 'gravity' AS component, 1.0::DOUBLE AS alpha, sum(0.5*pow({_W}*(value-predicted),2)) AS value FROM pred UNION ALL SELECT 'tmi', 0.25, sum(0.5*pow(value-2*predicted,2)) FROM pred) SELECT component, alpha, round(value, 6) AS value FROM c UNION ALL SELECT 'total', 1.0, round(sum(alpha*value), 6) FROM c")
def joint_objective(spark, d):
    first = r.misfit(_pred(spark, d))
    second = r.misfit(_pred(spark, d).withColumn("predicted", 2 * F.col("predicted")).withColumn("std", F.lit(1.0)))
    return r.joint_objective([("gravity", 1.0, first), ("tmi", 0.25, second)]).select("component", "alpha", F.round("value", 6).alias("value"))


_DW = "CASE WHEN count(*) < 2 OR sum(r*r) < 1e-30 THEN 2.0 ELSE sum(pow({}, 2))/sum(r*r) END"


@query(
    "durbin_watson_xy",
    f"WITH {b.OBS_SQL}, s AS (SELECT value-0.5 AS r, (value-0.5)-lag(value-0.5) OVER (ORDER BY x,y,obs_id) AS dx, (value-0.5)-lag(value-0.5) OVER (ORDER BY y,x,obs_id) AS dy FROM obs)"
    f" SELECT round({_DW.format('dx')}, 9) AS dw_x, round({_DW.format('dy')}, 9) AS dw_y, count(*) AS n FROM s",
)
def durbin_watson_xy(spark, d):
    rows = r.durbin_watson(b.obs(spark, d).withColumn("r", F.col("value") - 0.5))
    return rows.select(F.round("dw_x", 9).alias("dw_x"), F.round("dw_y", 9).alias("dw_y"), "n")


@query(
    "durbin_watson_by_type",
    "WITH m AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS r FROM events), s AS (SELECT event_type, r, r-lag(r) OVER (PARTITION BY event_type ORDER BY user_id, epoch_us(ts::TIMESTAMP), event_id) AS dx FROM m)"
    f" SELECT event_type, round({_DW.format('dx')}, 6) AS dw, count(*) AS n FROM s GROUP BY event_type",
)
def durbin_watson_by_type(spark, d):
    e = b.read(spark, d, "events")
    means = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    rows = e.join(means, "event_type").select("event_type", F.col("user_id").alias("x"), F.unix_micros(F.col("ts").cast("timestamp")).alias("y"), F.col("event_id").alias("obs_id"), (F.col("value") - F.col("m")).alias("r"))
    return r.durbin_watson(rows, ["event_type"]).select("event_type", F.round("dw_x", 6).alias("dw"), "n")


_PLANE = """p AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, (o_orderkey % 1000)::DOUBLE AS y, o_totalprice AS z FROM orders),
m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x,x) xx, covar_pop(y,y) yy, covar_pop(x,y) xy, covar_pop(x,z) xz, covar_pop(y,z) yz FROM p),
k AS (SELECT (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b, mx, my, mz FROM m)"""


def _plane(spark, d):
    return b.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), (F.col("o_orderkey") % 1000).cast("double").alias("y"), F.col("o_totalprice").alias("z"))


@query("planar_trend", f"WITH {_PLANE} SELECT round(a, 6) AS a, round(b, 6) AS b, round(mz-a*mx-b*my, 4) AS c FROM k")
def planar_trend(spark, d):
    return r.planar_trend(_plane(spark, d), "x", "y", "z").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"))


@query("planar_detrend", f"WITH {_PLANE} SELECT o_orderkey, round(z-(a*x+b*y+mz-a*mx-b*my), 4) AS detrended FROM p, k")
def planar_detrend(spark, d):
    return r.detrend(_plane(spark, d), "x", "y", "z").select("o_orderkey", F.round("detrended", 4).alias("detrended"))


@query("standardise", f"WITH {b.VOXELS_SQL}, s AS (SELECT avg(density) m1, stddev_pop(density) s1, avg(susceptibility) m2, stddev_pop(susceptibility) s2 FROM voxels) SELECT cell_id, round((density-m1)/s1, 6) AS density_z, round((susceptibility-m2)/s2, 6) AS susceptibility_z FROM voxels, s")
def standardise(spark, d):
    z = r.standardise(b.voxels(spark, d), ["density", "susceptibility"])
    return z.select("cell_id", F.round("density_z", 6).alias("density_z"), F.round("susceptibility_z", 6).alias("susceptibility_z"))


@query("median_depth", f"WITH {b.VERTICES_SQL} SELECT freedom, median(z) AS median_z FROM vertices GROUP BY freedom")
def median_depth(spark, d):
    return b.vertices(spark, d).groupBy("freedom").agg(F.median("z").alias("median_z"))


@query("map_range_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def map_range_percentiles(spark, d):
    # equal prices are counted first, so a group's task reads each of them once, not once a task that met it
    counted = b.read(spark, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("n"))
    return counted.groupBy("l_returnflag").agg(*[F.percentile("l_extendedprice", p, F.col("n")).alias(name) for p, name in ((0.05, "p05"), (0.95, "p95"))])


@query("label_histogram", f"WITH {b.VOXELS_SQL}, e AS (SELECT min(density) lo, max(density) hi FROM voxels) SELECT label, least(49, floor((density-lo)/((hi-lo)/50)))::INT AS bin, count(*) AS n FROM voxels, e GROUP BY 1, 2")
def label_histogram(spark, d):
    return r.histogram(b.voxels(spark, d), "density", 50, ["label"])


@query("upper_median_depth", f"WITH {b.INTERVALS_SQL}, f AS (SELECT hole_id, grp, -min(from_m) AS top FROM intervals GROUP BY 1, 2), k AS (SELECT grp, top, row_number() OVER (PARTITION BY grp ORDER BY top) AS i, count(*) OVER (PARTITION BY grp) AS n FROM f) SELECT grp, top AS upper_median, n FROM k WHERE i = n // 2 + 1")
def upper_median_depth(spark, d):
    firsts = b.intervals(spark, d).groupBy("hole_id", "grp").agg((-F.min("from_m")).alias("top"))
    return r.upper_median(firsts, "top", ["grp"])


@query("data_scale", f"WITH {b.OBS_SQL} SELECT round(sqrt(greatest(avg(value*value), 1.0)), 9) AS scale FROM obs")
def data_scale(spark, d):
    return r.data_scale(b.obs(spark, d), "value").select(F.round("scale", 9).alias("scale"))


@query("down_sample_500")
def down_sample_500(spark, d):
    return r.down_sample(b.obs(spark, d), "obs_id", 500)


@query("name_perturbation", "SELECT n_nationkey, round(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a*31+c) % 4294967296), 0)::BIGINT AS h FROM nation")
def name_perturbation(spark, d):
    return b.read(spark, d, "nation").select("n_nationkey", r.name_hash(F.col("n_name")).alias("h"))


@query("box_projection", f"WITH {b.OBS_SQL} SELECT obs_id, greatest(-1.0, least(5.0, value)) AS projected, greatest(-3.0, value-2.0) AS lower, least(8.0, value+2.0) AS upper FROM obs")
def box_projection(spark, d):
    v = F.col("value")
    return b.obs(spark, d).select("obs_id", r.box_project(v, F.lit(-1.0), F.lit(5.0)).alias("projected"), F.greatest(F.lit(-3.0), v - 2.0).alias("lower"), F.least(F.lit(8.0), v + 2.0).alias("upper"))


@query("absolute_density", f"WITH {b.VOXELS_SQL} SELECT cell_id, round((density-3.0)+2.67, 9) AS absolute FROM voxels")
def absolute_density(spark, d):
    return b.voxels(spark, d).select("cell_id", F.round(F.col("density") - 3.0 + 2.67, 9).alias("absolute"))


@query("station_union", "SELECT DISTINCT x, y FROM (SELECT (c_custkey % 40)*100.0::DOUBLE AS x, (c_custkey // 40)*100.0::DOUBLE AS y FROM customer UNION ALL SELECT (s_suppkey % 30)*100.0, (s_suppkey // 30)*100.0 FROM supplier)")
def station_union(spark, d):
    k = F.col("s_suppkey")
    other = b.read(spark, d, "supplier").select(((k % 30) * 100.0).alias("x"), (F.floor(k / 30) * 100.0).alias("y"))
    return b.obs(spark, d).select("x", "y").union(other).distinct()


@query("plot_bounds", f"WITH {b.OBS_SQL} SELECT min(x) AS x_lo, max(x) AS x_hi, min(CASE WHEN value > 0 THEN value END) AS log_lo, max(value) AS log_hi FROM obs")
def plot_bounds(spark, d):
    v = F.col("value")
    return b.obs(spark, d).agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min(F.when(v > 0, v)).alias("log_lo"), F.max("value").alias("log_hi"))


@query("tensor_mesh_size", f"WITH {b.OBS_SQL} SELECT (floor(min(x)/200.0)-2)*200.0 AS x0, (ceil(max(x)/200.0)+2)*200.0 AS x1, ((ceil(max(x)/200.0)+2)-(floor(min(x)/200.0)-2))::BIGINT AS nx, ((ceil(max(y)/200.0)+2)-(floor(min(y)/200.0)-2))::BIGINT AS ny, ceil(1000.0/200.0)::BIGINT AS nz FROM obs")
def tensor_mesh_size(spark, d):
    lo = lambda c: F.floor(F.min(c) / 200.0) - 2
    hi = lambda c: F.ceil(F.max(c) / 200.0) + 2
    return b.obs(spark, d).agg((lo("x") * 200.0).alias("x0"), (hi("x") * 200.0).alias("x1"), (hi("x") - lo("x")).alias("nx"), (hi("y") - lo("y")).alias("ny"), F.ceil(F.lit(1000.0 / 200.0)).alias("nz"))
