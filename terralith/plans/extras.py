"""Queries on control points, sides, windows, stations and remaining text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import control as ct
from terralith.operators import forward as fw
from terralith.operators import locate
from terralith.plans import bindings as b
from terralith.plans.exchange import place
from terralith.plans.registry import query
from terralith.plans.shapes import _meshes, _SHARED
from terralith.sources import text as t
from terralith.sources import write as w


@query("control_grid_weights", "WITH n AS (SELECT DISTINCT (p_partkey % 21)::INT AS ix, (p_partkey // 21 % 21)::INT AS iy FROM part), c AS (SELECT ix, iy, least(ix // 4 * 4, 19) AS x0, least(iy // 4 * 4, 19) AS y0 FROM n), e AS (SELECT *, least(x0+4, 20) AS x1, least(y0+4, 20) AS y1 FROM c), t AS (SELECT *, (ix-x0)/(x1-x0)::DOUBLE AS tx, (iy-y0)/(y1-y0)::DOUBLE AS ty FROM e),"
       " u AS (SELECT ix, iy, x0 AS cx, y0 AS cy, (1-tx)*(1-ty) AS w FROM t UNION ALL SELECT ix, iy, x1, y0, tx*(1-ty) FROM t UNION ALL SELECT ix, iy, x0, y1, (1-tx)*ty FROM t UNION ALL SELECT ix, iy, x1, y1, tx*ty FROM t) SELECT * FROM u WHERE w > 0")  # fmt: skip
def control_grid_weights(spark, d):
    """Weights of the nodes where parts lie on a grid 21 wide."""
    k = F.col("p_partkey")
    nodes = b.read(spark, d, "part").select((k % 21).cast("int").alias("ix"), (F.floor(k / 21) % 21).cast("int").alias("iy")).distinct()
    return ct.grid_weights(nodes, 21, 4)


@query("shared_control_points", f"WITH {b.VERTICES_SQL}, {_SHARED}, k AS (SELECT mesh_id, v_id, round(x*1e6)::BIGINT AS qx, round(y*1e6)::BIGINT AS qy, round(z*1e6)::BIGINT AS qz, floor(x/350) AS cx, floor(y/350) AS cy, floor(z/350) AS cz, round(pow(x-(floor(x/350)+0.5)*350,2)+pow(y-(floor(y/350)+0.5)*350,2)+pow(z-(floor(z/350)+0.5)*350,2), 9) AS d2 FROM meshes), bst AS (SELECT cx, cy, cz, min(struct_pack(d2 := d2, qx := qx, qy := qy, qz := qz)) AS p FROM k GROUP BY ALL) SELECT mesh_id, v_id FROM k WHERE EXISTS (SELECT 1 FROM bst WHERE p.qx = k.qx AND p.qy = k.qy AND p.qz = k.qz)")
def shared_control_points(spark, d):
    return ct.control_points(_meshes(spark, d), 350.0)


@query("surface_side", "WITH pts AS (SELECT s_suppkey AS obs_id, s_suppkey*1.7 % 90 AS x, s_suppkey*2.3 % 90 AS y, (s_suppkey % 5 - 2)*10.0 AS z FROM supplier) SELECT obs_id, CASE WHEN abs(z) <= 1e-9 THEN 0 WHEN z > 0 THEN 1 ELSE -1 END AS side FROM pts")
def surface_side(spark, d):
    k = F.col("s_suppkey")
    pts = b.read(spark, d, "supplier").select(k.alias("obs_id"), (k * 1.7 % 90).alias("x"), (k * 2.3 % 90).alias("y"), ((k % 5 - 2) * 10.0).alias("z"))
    facet = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 100.0, 100.0, 0.0)], "t_id int, " + ", ".join(f"{c} double" for c in fw.CORNERS))
    return ct.side(pts, facet)


_CORNERS3 = ", ".join(f"{c}.{a} AS {c}{a}" for c in "pqr" for a in "xyz")
_MESH_SIDE = f"""WITH {b.VERTICES_SQL},
{b.TRIANGLES_SQL}, pts AS (SELECT s_suppkey AS obs_id, (s_suppkey*37 % 61)*100.0 - 1000.0 AS x, (s_suppkey*23 % 59)*100.0 - 950.0 AS y, (s_suppkey % 9 - 4)*250.0 AS z FROM supplier),
f AS (SELECT t_id, {_CORNERS3} FROM triangles JOIN vertices p ON p.v_id = v0 JOIN vertices q ON q.v_id = v1 JOIN vertices r ON r.v_id = v2),
e AS (SELECT *, qx-px AS ax, qy-py AS ay, qz-pz AS az, rx-px AS bx, ry-py AS b_y, rz-pz AS bz FROM f),
n AS (SELECT *, ay*bz-az*b_y AS ux, az*bx-ax*bz AS uy, ax*b_y-ay*bx AS uz FROM e),
u AS (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS size, (qy-ry)*(px-rx)+(rx-qx)*(py-ry) AS d FROM n),
m AS (SELECT obs_id, x, y, z, u.*, ((qy-ry)*(x-rx)+(rx-qx)*(y-ry))/d AS wa, ((ry-py)*(x-rx)+(px-rx)*(y-ry))/d AS wb, ax*ax+ay*ay+az*az AS aa, ax*bx+ay*b_y+az*bz AS ab, bx*bx+b_y*b_y+bz*bz AS bb,
  ax*(x-px)+ay*(y-py)+az*(z-pz) AS av, bx*(x-px)+b_y*(y-py)+bz*(z-pz) AS bv FROM pts, u),
s AS (SELECT *, greatest(0, (bb*av-ab*bv)/(aa*bb-ab*ab)) AS s0, greatest(0, (aa*bv-ab*av)/(aa*bb-ab*ab)) AS t0 FROM m),
w AS (SELECT *, x-(px+(s0*ax+t0*bx)/greatest(1, s0+t0)) AS fx, y-(py+(s0*ay+t0*b_y)/greatest(1, s0+t0)) AS fy, z-(pz+(s0*az+t0*bz)/greatest(1, s0+t0)) AS fz FROM s),
g AS (SELECT obs_id, t_id, wa >= -1e-9 AND wb >= -1e-9 AND 1-wa-wb >= -1e-9 AS over_it, ((x-px)*ux+(y-py)*uy+(z-pz)*uz)/size AS h, (fx*ux+fy*uy+fz*uz)/size AS away, fx*fx+fy*fy+fz*fz AS d2 FROM w),
c AS (SELECT obs_id, arg_min(h, t_id) AS h FROM g WHERE over_it GROUP BY 1), o AS (SELECT obs_id, first(away ORDER BY d2, t_id) AS h FROM g GROUP BY 1)
SELECT obs_id, c.obs_id IS NOT NULL AS covered, (CASE WHEN abs(coalesce(c.h, o.h)) <= 1e-9 THEN 0 ELSE sign(coalesce(c.h, o.h)) END)::INT AS side FROM o LEFT JOIN c USING (obs_id)"""


@query("mesh_side", _MESH_SIDE)
def mesh_side(spark, d):
    """Which side of the height field places over, under and beside it lie on."""
    k = F.col("s_suppkey")
    points = b.read(spark, d, "supplier").select(k.alias("obs_id"), ((k * 37 % 61) * 100.0 - 1000.0).alias("x"), ((k * 23 % 59) * 100.0 - 950.0).alias("y"), ((k % 9 - 4) * 250.0).alias("z"))
    facets = fw.mesh_facets(b.vertices(spark, d).select("v_id", "x", "y", "z"), b.triangles(spark, d))
    covered = locate.surface_z(points, facets).select(F.col("obs_id").alias("o"))
    return ct.side(points, facets).join(covered, F.col("obs_id") == F.col("o"), "left").select("obs_id", F.col("o").isNotNull().alias("covered"), "side")


@query("body_windows", f"WITH {b.VOXELS_SQL}, e AS (SELECT max(ix) AS hx, max(iy) AS hy, max(iz) AS hz FROM voxels) SELECT CASE WHEN ix/hx BETWEEN 0.5 AND 1.0 AND iy/hy BETWEEN 0.0 AND 0.6 THEN 2 WHEN ix/hx BETWEEN 0.1 AND 0.6 AND iy/hy BETWEEN 0.2 AND 0.8 THEN 1 ELSE 0 END AS body, count(*) AS n FROM voxels, e GROUP BY 1")
def body_windows(spark, d):
    cells = b.voxels(spark, d).select(F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("iz").cast("double").alias("z"))
    return ct.body_labels(cells, [((0.1, 0.6), (0.2, 0.8), (0.0, 1.0)), ((0.5, 1.0), (0.0, 0.6), (0.0, 1.0))]).groupBy("body").agg(F.count("*").alias("n"))


@query("constraint_gradient", f"WITH {b.INTERVALS_SQL}, p AS (SELECT hole_id AS dof, sum(2.0*pow(to_m-from_m+1, 2)) AS a, sum(2.0*pow(to_m-from_m-1, 2)) AS z FROM intervals WHERE grp <> 'N' GROUP BY 1) SELECT dof, round((a-z)/2.0, 6) AS gradient FROM p")
def constraint_gradient(spark, d):
    wrong = b.intervals(spark, d).filter("grp <> 'N'")
    side = lambda s: wrong.groupBy(F.col("hole_id").alias("dof")).agg(F.sum(2.0 * F.pow(F.col("to_m") - F.col("from_m") + s, 2)).alias("penalty"))
    return ct.penalty_gradient(side(1.0), side(-1.0), 1.0).select("dof", F.round("gradient", 6).alias("gradient"))


@query("station_frequencies", "SELECT s_suppkey AS station, (s_suppkey % 3)::INT AS number, pow(10.0, s_suppkey % 3) AS f FROM supplier WHERE s_suppkey % 4 <> 0")
def station_frequencies(spark, d):
    k = F.col("s_suppkey")
    base = b.read(spark, d, "supplier")
    stations = base.select(k.alias("station"), F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0)).alias("frequencies"))
    data = base.select(k.alias("station"), (F.pow(F.lit(10.0), (k % 3).cast("double")) + F.when(k % 4 == 0, 0.5).otherwise(0.0)).alias("f"))
    return ct.stations_at(stations, data)


@query("iteration_displacement", f"WITH {b.VERTICES_SQL} SELECT count(CASE WHEN v_id % 4 <> 0 THEN 1 END) AS moved, count(CASE WHEN v_id % 4 = 0 THEN 1 END) AS unmoved, max((v_id % 4)*1.5) AS largest FROM vertices")
def iteration_displacement(spark, d):
    v = b.vertices(spark, d).select("v_id", "x", "y", "z")
    return ct.displacement(v, v.withColumn("z", F.col("z") + (F.col("v_id") % 4) * 1.5)).select("moved", "unmoved", F.round("largest", 6).alias("largest"))


@query("padded_grid", "WITH n AS (SELECT max(c_custkey) // 40 + 1 AS ny FROM customer) SELECT c_custkey AS v_id, (c_custkey % 40)*25.0 AS x, (c_custkey // 40)*25.0 AS y, -10.0 AS z, CASE WHEN c_custkey % 40 < 2 OR c_custkey % 40 >= 38 OR c_custkey // 40 < 2 OR c_custkey // 40 >= ny - 2 THEN 'FIXED' ELSE 'Z_ONLY' END AS freedom FROM customer, n")
def padded_grid(spark, d):
    """Customers as nodes of a flat grid 40 wide whose outer two rings are padding."""
    nodes = b.read(spark, d, "customer").select(F.col("c_custkey").alias("v_id"))
    return ct.padded_nodes(nodes, 40, int(nodes.agg(F.max("v_id")).first()[0]) // 40 + 1, 25.0, -10.0, 2)


@query("flat_contact", f"WITH {b.OBS_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, median(value) AS z FROM obs) SELECT i AS v_id, round(x0+(x1-x0)*(i % 11)/10.0, 6) AS x, round(y0+(y1-y0)*(i // 11)/10.0, 6) AS y, round(z, 6) AS z FROM e, range(0, 121) r(i)")
def flat_contact(spark, d):
    ends = b.obs(spark, d).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.median("value").alias("m"))
    i = F.col("v_id")
    rows = spark.range(121).withColumnRenamed("id", "v_id").crossJoin(F.broadcast(ends))
    return rows.select("v_id", F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * (i % 11) / 10.0, 6).alias("x"), F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * F.floor(i / 11) / 10.0, 6).alias("y"), F.round("m", 6).alias("z"))


@query("history_changes", "WITH h AS (SELECT n_regionkey AS run_id, n_nationkey AS iteration, (n_nationkey // 3)::DOUBLE AS norm FROM nation), s AS (SELECT *, pow(norm-lag(norm) OVER (PARTITION BY run_id ORDER BY iteration), 2) AS d FROM h) SELECT run_id, iteration, norm FROM s WHERE d IS NULL OR d > 1e-14")
def history_changes(spark, d):
    h = b.read(spark, d, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("iteration"), F.floor(F.col("n_nationkey") / 3).cast("double").alias("norm"))
    return ct.history_changes(h)


@query("active_cell_mesh", f"WITH {b.VOXELS_SQL} SELECT (row_number() OVER (ORDER BY cell_id))::INT AS cell, ix+1 AS ix, iy+1 AS iy, iz+1 AS iz, 100.0+(ix+0.5)*50.0 AS x, 25.0-(iz+0.5)*10.0 AS z FROM voxels WHERE label > 0")
def active_cell_mesh(spark, d):
    """The voxels of a label written as one active-cell mesh file and read back in splits."""
    cells = b.voxels(spark, d).filter("label > 0")
    top, n = cells.agg(F.max("iz"), F.count("*")).first()
    head = spark.createDataFrame(list(enumerate([f"10 10 {top + 1}", "100 200 25", "50 50 10", str(n)])), "ord long, line string").withColumn("part", F.lit(0))
    body = cells.select(F.col("cell_id").cast("long").alias("ord"), F.concat_ws(" ", F.col("ix") + 1, F.col("iy") + 1, F.col("iz") + 1).alias("line"), F.lit(1).alias("part"))
    path = place(spark, "a.msh")
    w.write_lines(head.unionByName(body), path)
    return t.active_cells(t.read_lines(spark, path)).select("cell", "ix", "iy", "iz", "x", "z")


@query("strict_model", "SELECT s_suppkey || '.mod' AS path, i::INT AS place, (s_suppkey+i)*0.5 AS value FROM supplier, range(0, 24) r(i)")
def strict_model(spark, d):
    """One model text for each supplier, three values to a line."""
    k = F.col("s_suppkey")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.concat(((k + i) * 0.5).cast("string"), F.when(i % 3 == 2, "\n").otherwise(" ")))
    texts = b.read(spark, d, "supplier").select(F.concat(k.cast("string"), F.lit(".mod")).alias("path"), F.concat(F.lit("2 3 4\n"), F.array_join(numbers, "")).alias("text"))
    return t.strict_model(texts)


@query("mesh_and_config_text", f"WITH {b.VOXELS_SQL}, e AS (SELECT max(ix)+1 AS nx, max(iy)+1 AS ny, max(iz)+1 AS nz FROM voxels), r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS n, r_name FROM region)"
       " SELECT 'ini' AS kind, 0 AS ord, '[data]' AS line UNION ALL SELECT 'ini', n, lower(r_name) || ' = ' || lower(r_name) || '.csv' FROM r"
       " UNION ALL SELECT 'msh', o, CASE o WHEN 0 THEN nx || ' ' || ny || ' ' || nz WHEN 1 THEN '0.000 0.000 25.000' WHEN 2 THEN nx || '*50.000' WHEN 3 THEN ny || '*50.000' ELSE nz || '*10.000' END FROM e, range(5) q(o)")
def mesh_and_config_text(spark, d):
    """Mesh text of the voxels' extent, and a configuration with one file a region."""
    shape = b.voxels(spark, d).agg(*[F.max(c) + 1 for c in ("ix", "iy", "iz")]).first()
    names = [r.r_name.lower() for r in b.read(spark, d, "region").orderBy("r_regionkey").collect()]
    msh = w.mesh_text(tuple(shape), (0.0, 0.0, 25.0), (50.0, 50.0, 10.0))
    ini = w.ini_text({"data": {n: f"{n}.csv" for n in names}})
    return spark.createDataFrame([("msh", i, x) for i, x in enumerate(msh)] + [("ini", i, x) for i, x in enumerate(ini)], "kind string, ord int, line string")


@query("observed_csv", f"WITH {b.OBS_SQL} SELECT obs_id AS ord, printf('%.3f,%.3f,%.3f,%.6f,%.6f', x, y, z, value, std) AS line FROM obs")
def observed_csv(spark, d):
    return w.observed_lines(b.obs(spark, d))
