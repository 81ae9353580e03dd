"""Queries on gating, clusters, groups and drill intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith.operators import clustering as c
from terralith.operators import drill as dr
from terralith.plans import bindings as b
from terralith.plans import sqlgen as s
from terralith.plans.registry import query

GATES = [(1.8, 2.4, 0.0, 0.02), (2.2, 3.0, 0.01, 0.03), (2.4, 3.6, 0.0, 0.05), (3.0, 4.0, 0.03, 0.05)]
_CASE = "CASE " + " ".join(f"WHEN density BETWEEN {d0} AND {d1} AND susceptibility BETWEEN {s0} AND {s1} THEN {i}" for i, (d0, d1, s0, s1) in enumerate(GATES)) + " ELSE -1 END"
_GATED = f"WITH {b.VOXELS_SQL}, gated AS (SELECT *, {_CASE} AS g FROM voxels)"


def _gated(spark, d):
    return b.voxels(spark, d).withColumn("label", c.gate(F.col("density"), F.col("susceptibility"), GATES))


@query("gate_first_match", f"{_GATED} SELECT cell_id, g AS label FROM gated")
def gate_first_match(spark, d):
    return _gated(spark, d).select("cell_id", "label")


@query("gate_table_join", f"{_GATED} SELECT cell_id, g AS label FROM gated")
def gate_table_join(spark, d):
    gates = spark.createDataFrame([(i, *g) for i, g in enumerate(GATES)], "ord int, d_min double, d_max double, s_min double, s_max double")
    return c.gate_join(b.voxels(spark, d), gates)


@query("gate_contrast", f"{_GATED.replace('density BETWEEN', '(density-2.67)+2.67 BETWEEN')} SELECT g AS label, count(*) AS n FROM gated GROUP BY g".replace("(density-2.67)+2.67", "density"))
def gate_contrast(spark, d):
    cells = b.voxels(spark, d)
    shifted = c.shift_gates([(x - 1e-9, y + 1e-9, s, t) for x, y, s, t in GATES], 2.67)
    return cells.select(c.gate(F.col("density") - 2.67, F.col("susceptibility"), shifted).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


_SUM = "count(*) AS n, round(avg(density), 6) AS density_mean, round(stddev_pop(density), 6) AS density_std, round(avg(susceptibility), 6) AS susceptibility_mean, round(stddev_pop(susceptibility), 6) AS susceptibility_std"
_SUMS = ["density_mean", "density_std", "susceptibility_mean", "susceptibility_std"]


def _rounded(df):
    return df.select("label", "n", *[F.round(x, 6).alias(x) for x in _SUMS])


@query("cluster_stats", f"WITH {b.VOXELS_SQL} SELECT label, {_SUM} FROM voxels WHERE density >= -9998 AND abs(density) > 1e-12 GROUP BY label")
def cluster_stats(spark, d):
    return _rounded(c.summary(b.voxels(spark, d).filter(c.valid(F.col("density")) & c.active(F.col("density")))))


@query(
    "gate_summary_left",
    f"{_GATED}, s AS (SELECT g AS label, {_SUM} FROM gated GROUP BY g) SELECT e.label, coalesce(n, 0) AS n, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _SUMS)} FROM (SELECT unnest(range(-1, 8))::INT AS label) e LEFT JOIN s USING (label)",
)
def gate_summary_left(spark, d):
    return _rounded(c.gated_summary(_gated(spark, d), spark.range(-1, 8).select(F.col("id").cast("int").alias("label"))))


@query("cluster_rank", f"WITH {b.VOXELS_SQL}, s AS (SELECT label, avg(density) AS m FROM voxels GROUP BY label) SELECT label, round(m, 6) AS density_mean, row_number() OVER (ORDER BY m, label) AS rank FROM s")
def cluster_rank(spark, d):
    return c.ranked_by_density(c.summary(b.voxels(spark, d))).select("label", F.round("density_mean", 6).alias("density_mean"), "rank")


@query(
    "density_stretch",
    f"WITH {b.VOXELS_SQL}, s AS (SELECT label, avg(density-3) AS m, stddev_pop(density) AS sd FROM voxels GROUP BY label), r AS (SELECT max(m)-min(m) AS r FROM s)"
    " SELECT label, round(m*(CASE WHEN r > 0 AND r < 5 THEN 5/r ELSE 1 END)+2.67, 6) AS density_mean, round(sd*(CASE WHEN r > 0 AND r < 5 THEN 5/r ELSE 1 END), 6) AS density_std FROM s, r",
)
def density_stretch(spark, d):
    rows = b.voxels(spark, d).groupBy("label").agg(F.avg(F.col("density") - 3).alias("density_mean"), F.stddev_pop("density").alias("density_std"))
    out = c.stretch(rows, 5.0)
    return out.select("label", F.round("density_mean", 6).alias("density_mean"), F.round("density_std", 6).alias("density_std"))


@query("intersection_labels", f"WITH {b.VOXELS_SQL}, p AS (SELECT cell_id, floor(density)::INT AS d, (cell_id % 3)::INT AS s FROM voxels) SELECT cell_id, dense_rank() OVER (ORDER BY d*3+s) - 1 AS label FROM p")
def intersection_labels(spark, d):
    cells = b.voxels(spark, d).select("cell_id", F.floor("density").cast("int").alias("d"), (F.col("cell_id") % 3).cast("int").alias("s"))
    return c.intersection_labels(cells, 3).select("cell_id", "label")


_TERC = "pos AS (SELECT *, row_number() OVER (ORDER BY density, cluster_id)-1 AS p, count(*) OVER () AS n FROM clusters), terc AS (SELECT *, CASE WHEN p/(n-1)::DOUBLE >= 0.67 THEN 2 WHEN p/(n-1)::DOUBLE >= 0.33 THEN 1 ELSE 0 END AS litho_group FROM pos)"


@query("tercile_groups", f"WITH {b.CLUSTERS_SQL}, {_TERC} SELECT cluster_id, litho_group FROM terc")
def tercile_groups(spark, d):
    return c.tercile_groups(b.clusters(spark, d)).select("cluster_id", "litho_group")


@query("half_groups", f"WITH {b.CLUSTERS_SQL}, {_TERC} SELECT cluster_id, CASE WHEN p >= n // 2 THEN 1 ELSE 0 END AS litho_group FROM terc")
def half_groups(spark, d):
    return c.tercile_groups(b.clusters(spark, d), 2).select("cluster_id", "litho_group")


_MAP = "map AS (SELECT cluster_id, (cluster_id % 5) * 2 + 1 AS litho_group FROM clusters)"


def _mapping(cl):
    return cl.select("cluster_id", (F.col("cluster_id") % 5 * 2 + 1).alias("litho_group"))


@query("group_properties", f"WITH {b.CLUSTERS_SQL}, {_MAP} SELECT litho_group, round(avg(density), 6) AS density, round(avg(susceptibility), 6) AS susceptibility, count(*) AS n_clusters FROM clusters JOIN map USING (cluster_id) GROUP BY 1")
def group_properties(spark, d):
    cl = b.clusters(spark, d)
    return c.group_properties(cl, _mapping(cl)).select("litho_group", F.round("density", 6).alias("density"), F.round("susceptibility", 6).alias("susceptibility"), "n_clusters")


@query("weighted_group_properties", f"WITH {b.CLUSTERS_SQL}, {_MAP} SELECT litho_group, round(sum(sample_count*density)/sum(sample_count), 6) AS density, round(sum(sample_count*susceptibility)/sum(sample_count), 6) AS susceptibility FROM clusters JOIN map USING (cluster_id) GROUP BY 1")
def weighted_group_properties(spark, d):
    cl = b.clusters(spark, d)
    return c.weighted_properties(cl, _mapping(cl)).select("litho_group", F.round("density", 6).alias("density"), F.round("susceptibility", 6).alias("susceptibility"))


_FILL = "coalesce(g.{0}, (a.{0}+z.{0})/2, a.{0}*{1}, z.{0}*{2}, {3})"


@query(
    "fill_empty_groups",
    f"WITH {b.CLUSTERS_SQL}, {_MAP}, g AS (SELECT litho_group, avg(density) AS density, avg(susceptibility) AS susceptibility FROM clusters JOIN map USING (cluster_id) GROUP BY 1), e AS (SELECT unnest(range(0, 12))::INT AS litho_group)"
    f" SELECT e.litho_group, round({_FILL.format('density', 1.05, 0.95, 2.67)}, 6) AS density, round({_FILL.format('susceptibility', 1.5, 0.5, 0.0)}, 6) AS susceptibility, g.litho_group IS NULL AS interpolated"
    " FROM e LEFT JOIN g ON g.litho_group = e.litho_group LEFT JOIN g a ON a.litho_group = (SELECT max(litho_group) FROM g x WHERE x.litho_group < e.litho_group)"
    " LEFT JOIN g z ON z.litho_group = (SELECT min(litho_group) FROM g x WHERE x.litho_group > e.litho_group)",
)
def fill_empty_groups(spark, d):
    cl = b.clusters(spark, d)
    expected = spark.range(0, 12).select(F.col("id").cast("int").alias("litho_group"))
    out = c.fill_empty_groups(c.group_properties(cl, _mapping(cl)), expected)
    return out.select("litho_group", F.round("density", 6).alias("density"), F.round("susceptibility", 6).alias("susceptibility"), "interpolated")


@query("nearest_cluster_1d", f"WITH {b.INTERVALS_SQL}, {b.CLUSTERS_SQL} SELECT hole_id, from_m, arg_min(cluster_id, struct_pack(a := abs(i.density-c.density), b := cluster_id)) AS cluster_id FROM intervals i, clusters c GROUP BY hole_id, from_m")
def nearest_cluster_1d(spark, d):
    return c.nearest_cluster(b.intervals(spark, d), b.clusters(spark, d), ["hole_id", "from_m"])


@query("nearest_cluster_2d", f"WITH {b.INTERVALS_SQL}, {b.CLUSTERS_SQL} SELECT hole_id, from_m, arg_min(cluster_id, struct_pack(a := abs(i.density-c.density)+10*abs(i.susceptibility-c.susceptibility), b := cluster_id)) AS cluster_id FROM intervals i, clusters c WHERE c.density <> 0 GROUP BY hole_id, from_m")
def nearest_cluster_2d(spark, d):
    return c.nearest_cluster(b.intervals(spark, d), b.clusters(spark, d), ["hole_id", "from_m"], 10.0)


_RUN = "n AS (SELECT *, CASE WHEN lag(grp) OVER w IS NULL OR grp <> lag(grp) OVER w {} THEN 1 ELSE 0 END AS new FROM intervals WINDOW w AS (PARTITION BY hole_id ORDER BY from_m, to_m)), r AS (SELECT *, sum(new) OVER (PARTITION BY hole_id ORDER BY from_m, to_m ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT hole_id, grp, min(from_m) AS z_top, max(to_m) AS z_bottom, count(*) AS n FROM r GROUP BY hole_id, run, grp"


@query("merge_intervals", f"WITH {b.INTERVALS_SQL}, {_RUN.format('OR abs(from_m - lag(to_m) OVER w) >= 0.1')}")
def merge_intervals(spark, d):
    return dr.merge_intervals(b.intervals(spark, d))


@query("merge_intervals_in_order", f"WITH {b.INTERVALS_SQL}, {_RUN.format('')}")
def merge_intervals_in_order(spark, d):
    return dr.merge_intervals(b.intervals(spark, d), gap=None)


@query("strat_order", f"WITH {b.INTERVALS_SQL}, e AS (SELECT unnest(['A','N','R','X']) AS grp), f AS (SELECT grp, min(from_m) AS s FROM intervals GROUP BY 1), k AS (SELECT e.grp, coalesce(s, 1e18) AS shallowest FROM e LEFT JOIN f USING (grp)) SELECT grp, shallowest, row_number() OVER (ORDER BY shallowest, grp) AS ordinal FROM k")
def strat_order(spark, d):
    expected = spark.createDataFrame([("A",), ("N",), ("R",), ("X",)], "grp string")
    return dr.stratigraphic_order(b.intervals(spark, d), expected)


@query("first_depths", f"WITH {b.INTERVALS_SQL}, f AS (SELECT hole_id, grp, min(from_m) AS depth FROM intervals GROUP BY 1, 2) SELECT s.s_suppkey AS hole_id, e.grp, coalesce(depth, 9999.0) AS depth FROM supplier s CROSS JOIN (SELECT unnest(['A','N','R','X']) AS grp) e LEFT JOIN f ON f.hole_id = s.s_suppkey AND f.grp = e.grp")
def first_depths(spark, d):
    groups = spark.createDataFrame([("A",), ("N",), ("R",), ("X",)], "grp string")
    return dr.first_depths(b.intervals(spark, d), b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("hole_id")), groups)


@query("anomalous_holes", "WITH c AS (SELECT s_suppkey AS hole_id, s_acctbal/50.0 AS contact FROM supplier), l AS (SELECT CASE WHEN max(contact-40) > 50 THEN 50.0 ELSE 10.0 END AS lv FROM c) SELECT hole_id, contact, contact-40 AS rise, greatest(100.0, (contact-40)*2) AS a, greatest(50.0, contact-40) AS b, greatest(20.0, abs(contact-40)) AS c FROM c, l WHERE contact-40 > lv")
def anomalous_holes(spark, d):
    contacts = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("hole_id"), (F.col("s_acctbal") / 50.0).alias("contact"))
    return dr.anomalous_holes(contacts, 40.0)


@query("ellipsoid_envelope", f"WITH {b.OBS_SQL}, e AS (SELECT n_nationkey*160.0 AS cx, n_regionkey*300.0 AS cy FROM nation), t AS (SELECT obs_id, CASE WHEN pow((x-cx)/400,2)+pow((y-cy)/300,2) > 1 THEN -500 ELSE -480+90*sqrt(1-(pow((x-cx)/400,2)+pow((y-cy)/300,2))) END AS z FROM obs, e) SELECT obs_id, round(max(greatest(-500.0, z)), 6) AS z FROM t GROUP BY obs_id")
def ellipsoid_envelope(spark, d):
    from terralith.operators.locate import envelope

    bodies = b.read(spark, d, "nation").select((F.col("n_nationkey") * 160.0).alias("cx"), (F.col("n_regionkey") * 300.0).alias("cy"))
    return envelope(b.obs(spark, d), bodies, -480.0, 400.0, 300.0, 90.0, -500.0).select("obs_id", F.round("z", 6).alias("z"))


@query("cluster_mean_valid", f"WITH {b.INTERVALS_SQL} SELECT grp, round(avg(density), 6) AS density, round(avg(susceptibility), 6) AS susceptibility, count(*) AS n FROM intervals WHERE density > 2.0 AND susceptibility >= 0 GROUP BY grp")
def cluster_mean_valid(spark, d):
    rows = b.intervals(spark, d).filter("density > 2.0 and susceptibility >= 0")
    return rows.groupBy("grp").agg(F.round(F.avg("density"), 6).alias("density"), F.round(F.avg("susceptibility"), 6).alias("susceptibility"), F.count("*").alias("n"))


@query("interval_penalty", f"WITH {b.INTERVALS_SQL} SELECT sum(CASE WHEN grp <> 'N' THEN 2.0*pow(to_m-from_m, 2) ELSE 0 END) AS penalty, count(CASE WHEN grp <> 'N' THEN 1 END) AS n_wrong, count(*) AS n FROM intervals")
def interval_penalty(spark, d):
    rows = b.intervals(spark, d).select(F.col("from_m").alias("z_top"), F.col("to_m").alias("z_bottom"), F.col("grp").alias("found"), F.lit("N").alias("expected"))
    return dr.interval_penalty(rows, 2.0)


@query("true_vs_recovered", f"WITH {b.CLUSTERS_SQL}, {b.BOXES_SQL} SELECT group_id, round(b.density, 6) AS true_density, round(c.density, 6) AS recovered_density, round(c.density-b.density, 6) AS difference FROM boxes b JOIN clusters c ON c.cluster_id = b.group_id")
def true_vs_recovered(spark, d):
    joined = b.boxes(spark, d).join(b.clusters(spark, d).withColumnRenamed("density", "found"), F.col("group_id") == F.col("cluster_id"))
    return joined.select("group_id", F.round("density", 6).alias("true_density"), F.round("found", 6).alias("recovered_density"), F.round(F.col("found") - F.col("density"), 6).alias("difference"))


@query("label_remap", f"WITH {b.VOXELS_SQL} SELECT cell_id, dense_rank() OVER (ORDER BY label*3) AS new_label FROM voxels")
def label_remap(spark, d):
    cells = b.voxels(spark, d).withColumn("label", F.col("label") * 3)
    names = cells.select("label").distinct().withColumn("new_label", F.dense_rank().over(Window.orderBy("label")))
    return cells.join(F.broadcast(names), "label").select("cell_id", "new_label")


@query("present_labels", f"{_GATED} SELECT DISTINCT g AS label FROM gated WHERE g <> -1")
def present_labels(spark, d):
    return _gated(spark, d).select("label").distinct().exceptAll(spark.createDataFrame([(-1,)], "label int"))


@query("missing_contacts", f"WITH {b.VOXELS_SQL}, have AS (SELECT DISTINCT label AS above, (label+2) % 4 AS below FROM voxels) SELECT e.i AS above, e.i+1 AS below FROM (SELECT unnest(range(0, 3))::INT AS i) e WHERE NOT EXISTS (SELECT 1 FROM have WHERE above = e.i AND below = e.i+1)")
def missing_contacts(spark, d):
    have = b.voxels(spark, d).select(F.col("label").alias("above"), ((F.col("label") + 2) % 4).alias("below")).distinct()
    expected = spark.range(0, 3).select(F.col("id").cast("int").alias("above"), (F.col("id") + 1).cast("int").alias("below"))
    return expected.join(have, ["above", "below"], "left_anti")


_CELLS = f"WITH {b.VOXELS_SQL}, bare AS (SELECT * EXCLUDE (label) FROM voxels)"


@query("mixture_2d", f"{_CELLS}, {s.mixture('bare', ['density', 'susceptibility'], 3, 'fitted')} SELECT label, {_SUM} FROM fitted GROUP BY label")
def mixture_2d(spark, d):
    return _rounded(c.summary(c.mixture_labels(b.voxels(spark, d), ["density", "susceptibility"], 3)))


@query(
    "mixture_intersection",
    f"{_CELLS}, {s.mixture('bare', ['density'], 3, 'one', 'd')}, {s.mixture('one', ['susceptibility'], 2, 'two', 's')}, "
    f"every AS (SELECT dense_rank() OVER (ORDER BY (d-1)*2+s-1) - 1 AS label, density, susceptibility FROM two) SELECT label, {_SUM} FROM every GROUP BY label",
)
def mixture_intersection(spark, d):
    cells = b.voxels(spark, d).drop("label")
    one = c.mixture_labels(cells, ["density"], 3).withColumnRenamed("label", "d").withColumn("d", F.col("d") - 1)
    two = c.mixture_labels(one, ["susceptibility"], 2).withColumnRenamed("label", "s").withColumn("s", F.col("s") - 1)
    return _rounded(c.summary(c.intersection_labels(two, 2)))


@query(
    "gate_then_cluster",
    f"{_GATED}, rest AS (SELECT * EXCLUDE (label, g) FROM gated WHERE g = -1), {s.mixture('rest', ['density'], 2, 'fitted')}, "
    f"every AS (SELECT g AS label, density, susceptibility FROM gated WHERE g <> -1 UNION ALL SELECT label + {len(GATES) - 1}, density, susceptibility FROM fitted) SELECT label, {_SUM} FROM every GROUP BY label",
)
def gate_then_cluster(spark, d):
    gated = _gated(spark, d)
    rest = c.mixture_labels(gated.filter("label = -1").drop("label"), ["density"], 2).withColumn("label", F.col("label") + len(GATES) - 1)
    return _rounded(c.summary(gated.filter("label <> -1").unionByName(rest.select(*gated.columns))))
