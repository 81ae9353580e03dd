"""Queries on text formats: lines are built from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions.geometry import G_MGAL
from terralith.operators import clustering as c
from terralith.operators import mesh as m
from terralith.operators.locate import classify
from terralith.operators.forward import box_facets, gravity
from terralith.operators.mesh import dense_number
from terralith.operators.storage import partitions
from terralith.plans import bindings as b
from terralith.plans import sqlgen as s
from terralith.plans.registry import query
from terralith.sources import text as t
from terralith.sources import write as w

_K = "s_suppkey"


def _lines(spark, d, expr):
    return b.read(spark, d, "supplier").select(F.lit("f").alias("path"), (F.col(_K) + 1).cast("int").alias("line_no"), F.expr(expr).alias("line"))


def _lines_sql(expr):
    return f"lines AS (SELECT 'f' AS path, (s_suppkey+1)::INT AS line_no, {expr} AS line FROM supplier)"


#: The same expression text runs in both engines.
_SURVEY = "CASE s_suppkey % 7 WHEN 0 THEN '# note' WHEN 1 THEN 'x,y,z,g_obs' WHEN 2 THEN concat(' ', s_suppkey, ', 2 ,,3,4') WHEN 3 THEN concat(s_suppkey, ',1,bad,2') WHEN 4 THEN '' ELSE concat(s_suppkey*10, ',', s_suppkey*20, ',0,', s_suppkey % 13, '.5,0.25') END"
_FLD = "list_filter(list_transform(string_split(line, ','), lambda x: trim(x, ' ' || chr(9) || chr(13) || '\"')), lambda x: x <> '')"
_GOOD = f"rws AS (SELECT *, {_FLD} AS f FROM lines), kept AS (SELECT * FROM rws WHERE len(f) > 0 AND NOT starts_with(ltrim(line), '#') AND NOT regexp_matches(f[1], '^[A-Za-z]')), fine AS (SELECT * FROM kept WHERE len(f) >= 4 AND list_bool_and(list_transform(f[1:5], lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL)))"


@query("survey_csv", f"WITH {_lines_sql(_SURVEY)}, {_GOOD} SELECT line_no, 'gravity' AS kind, f[1]::DOUBLE AS x, f[2]::DOUBLE AS y, f[3]::DOUBLE AS z, f[4]::DOUBLE AS value, coalesce(f[5]::DOUBLE, 0) AS std FROM fine")
def survey_csv(spark, d):
    return t.survey(_lines(spark, d, _SURVEY), "gravity")[0].drop("path")


@query("survey_csv_bad_rows", f"WITH {_lines_sql(_SURVEY)}, {_GOOD} SELECT line_no, line FROM kept WHERE line_no NOT IN (SELECT line_no FROM fine)")
def survey_csv_bad_rows(spark, d):
    return t.survey(_lines(spark, d, _SURVEY), "gravity")[1].drop("path")


_MAG = "concat(s_suppkey*5, ',', s_suppkey*7, ',', 100, ',', s_suppkey % 90 + 58000, CASE WHEN s_suppkey % 2 = 0 THEN ',5' ELSE '' END)"


@query("magnetic_csv", f"WITH {_lines_sql(_MAG)}, {_GOOD} SELECT line_no, 'tmi' AS kind, f[1]::DOUBLE AS x, f[4]::DOUBLE AS value, coalesce(f[5]::DOUBLE, 0) AS std FROM fine")
def magnetic_csv(spark, d):
    return t.survey(_lines(spark, d, _MAG), "tmi")[0].select("line_no", "kind", "x", "value", "std")


_CON = "CASE WHEN s_suppkey = 0 THEN 'x,y,z_top,z_bottom,group' ELSE concat(s_suppkey, ',2,', s_suppkey % 5, ',', s_suppkey % 5 + 10, ',', s_suppkey % 3, '.9') END"


@query("constraint_csv", f"WITH {_lines_sql(_CON)}, rws AS (SELECT *, {_FLD} AS f FROM lines) SELECT line_no, f[1]::DOUBLE AS x, f[3]::DOUBLE AS z_top, f[4]::DOUBLE AS z_bottom, trunc(f[5]::DOUBLE)::INT AS litho_group_id FROM rws WHERE line_no > 1")
def constraint_csv(spark, d):
    return t.constraints(_lines(spark, d, _CON)).select("line_no", "x", "z_top", "z_bottom", "litho_group_id")


_CLU = """CASE WHEN s_suppkey = 0 THEN 'cluster_id,name,count,a,b,c,d,e,f,g,h' ELSE concat(s_suppkey, ',"unit ', s_suppkey, '",', s_suppkey*3, ',2.7,2.6,2.8,0.01,0.0,0.02,', CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'no' END, ',TRUE,', CASE WHEN s_suppkey % 3 = 0 THEN 'n/a' WHEN s_suppkey % 3 = 1 THEN '' ELSE '0.5' END, ',NA,12,', s_suppkey % 2) END"""


@query("cluster_csv", f"WITH {_lines_sql(_CLU)}, f AS (SELECT line_no, list_transform(string_split(line, ','), lambda x: trim(x, ' \"')) AS f FROM lines WHERE line_no > 1) SELECT f[1]::INT AS cluster_id, f[2] AS working_name, f[3]::BIGINT AS sample_count, f[4]::DOUBLE AS density_median, lower(f[10]) IN ('yes','true','1') AS has_density, TRY_CAST(f[12] AS DOUBLE) AS remanence_magnitude, TRY_CAST(f[14] AS DOUBLE) AS remanence_declination, lower(f[15]) IN ('yes','true','1') AS has_remanence FROM f")
def cluster_csv(spark, d):
    return t.clusters(_lines(spark, d, _CLU)).select("cluster_id", "working_name", "sample_count", "density_median", "has_density", "remanence_magnitude", "remanence_declination", "has_remanence")


@query("flag_parsing", "SELECT n_nationkey, lower(substr(n_name, 1, 1)) IN ('y','t','1') AS flag, TRY_CAST(CASE WHEN n_nationkey % 3 = 0 THEN 'n/a' ELSE n_nationkey::VARCHAR || '.5' END AS DOUBLE) AS v FROM nation")
def flag_parsing(spark, d):
    raw = F.when(F.col("n_nationkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(".5")))
    first = F.lower(F.substring("n_name", 1, 1))
    word = F.when(first == "y", "yes").when(first == "t", "true").when(first == "1", "1").otherwise(F.col("n_name"))
    return b.read(spark, d, "nation").select("n_nationkey", t.yes(word).alias("flag"), t.number_or_null(raw).alias("v"))


_GAT = "CASE WHEN s_suppkey = 0 THEN 'cluster_name,density_min,density_max,susc_max' ELSE concat('g', s_suppkey, ',2.', s_suppkey % 7, ',3.0,', CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '0.05' END) END"


@query("gate_csv", f"WITH {_lines_sql(_GAT)}, f AS (SELECT line_no, string_split(line, ',') AS f FROM lines WHERE line_no > 1) SELECT line_no-2 AS ord, f[1] AS name, f[2]::DOUBLE AS d_min, f[3]::DOUBLE AS d_max, '-inf'::DOUBLE AS s_min, coalesce(TRY_CAST(f[4] AS DOUBLE), 'inf'::DOUBLE) AS s_max FROM f")
def gate_csv(spark, d):
    return t.gates(_lines(spark, d, _GAT))


_HDR = "CASE WHEN s_suppkey = 0 THEN 'hole_id,from_m,to_m,lith,density_gcc' WHEN s_suppkey % 5 = 0 THEN 'short,1' ELSE concat('H', s_suppkey % 4, ',', s_suppkey, ',', s_suppkey+2, ',X,2.', s_suppkey % 9) END"


@query("deposit_csv_by_header", f"WITH {_lines_sql(_HDR)}, f AS (SELECT string_split(line, ',') AS f FROM lines WHERE line_no > 1) SELECT f[1] AS hole_id, f[2]::DOUBLE AS from_m, f[5]::DOUBLE AS density_gcc FROM f WHERE len(f) >= 5")
def deposit_csv_by_header(spark, d):
    return t.by_header(_lines(spark, d, _HDR), {"hole_id": "string", "from_m": "double", "density_gcc": "double"})


@query("borehole_csv_by_position", f"WITH {_lines_sql(_HDR)}, f AS (SELECT string_split(line, ',') AS f FROM lines WHERE line_no > 1) SELECT f[2]::DOUBLE AS from_m, f[3]::DOUBLE AS to_m, f[5]::DOUBLE AS density FROM f WHERE len(f) >= 5")
def borehole_csv_by_position(spark, d):
    return t.by_position(_lines(spark, d, _HDR), {1: ("from_m", "double"), 2: ("to_m", "double"), 4: ("density", "double")})


@query("surface_points_csv", f"WITH {_lines_sql(_SURVEY)}, rws AS (SELECT *, {_FLD} AS f FROM lines) SELECT line_no, TRY_CAST(f[1] AS DOUBLE) AS x, TRY_CAST(f[2] AS DOUBLE) AS y, TRY_CAST(f[3] AS DOUBLE) AS z FROM rws WHERE len(f) >= 3 AND NOT starts_with(line, '#') AND TRY_CAST(f[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(f[3] AS DOUBLE) IS NOT NULL")
def surface_points_csv(spark, d):
    return t.points(_lines(spark, d, _SURVEY)).drop("path")


_DEM = "CASE WHEN s_suppkey % 9 = 0 THEN '; note' WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey % 5, ' ', s_suppkey % 4, '  ', s_suppkey) ELSE concat(s_suppkey % 5, ',', s_suppkey % 4, ',', s_suppkey) END"


@query("dem_xyz", f"WITH {_lines_sql(_DEM)}, f AS (SELECT line_no, regexp_split_to_array(line, '[ ,]+') AS f FROM lines WHERE line NOT LIKE ';%') SELECT f[1]::DOUBLE AS x, f[2]::DOUBLE AS y, arg_max(f[3]::DOUBLE, line_no) AS z FROM f GROUP BY 1, 2")
def dem_xyz(spark, d):
    return t.dem(_lines(spark, d, _DEM))


_INI = "CASE s_suppkey % 5 WHEN 0 THEN concat('[s', s_suppkey % 15, ']') WHEN 1 THEN concat('key = ', s_suppkey, ' # note') WHEN 2 THEN concat('other: v', s_suppkey) WHEN 3 THEN '; comment' ELSE '' END"


@query("ini_rows", f"WITH {_lines_sql(_INI)}, k AS (SELECT line_no, (line_no-1)//5*5 % 15 AS sec, (line_no-1) % 5 AS r, line_no-1 AS n FROM lines) SELECT 's' || sec AS section, CASE r WHEN 1 THEN 'key' ELSE 'other' END AS key, arg_max(CASE r WHEN 1 THEN n::VARCHAR ELSE 'v' || n END, line_no) AS value FROM k WHERE r IN (1, 2) GROUP BY 1, 2")
def ini_rows(spark, d):
    return t.ini(_lines(spark, d, _INI)).drop("path")


@query("group_json", "SELECT -1000.0::DOUBLE AS bottom_depth, n_nationkey AS id, n_name AS name, 2.5 + n_nationkey AS density FROM nation")
def group_json(spark, d):
    rows = b.read(spark, d, "nation").agg(F.to_json(F.struct(F.lit(-1000.0).alias("bottom_depth"), F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 2.5).alias("density"))).alias("groups"))).alias("text"))
    return t.group_json(rows)


_VAL = "CASE WHEN s_suppkey = 0 THEN '2 3 4' ELSE concat(s_suppkey, '.25') END"


@query("property_file", f"WITH {_lines_sql(_VAL)} SELECT (line_no-2)::INT AS cell, line::DOUBLE AS value FROM lines WHERE line_no > 1")
def property_file(spark, d):
    return t.property_values(_lines(spark, d, _VAL))


@query("cell_properties_join", f"WITH {_lines_sql(_VAL)}, p AS (SELECT (line_no-2)::INT AS cell, line::DOUBLE AS v FROM lines WHERE line_no > 1) SELECT a.cell, a.v AS density, bb.v/100 AS susceptibility, (a.cell % 4)*50.0+25 AS x FROM p a JOIN p bb USING (cell)")
def cell_properties_join(spark, d):
    one = t.property_values(_lines(spark, d, _VAL))
    two = t.property_values(_lines(spark, d, _VAL)).select("cell", (F.col("value") / 100).alias("susceptibility"))
    return one.join(two, "cell").select("cell", F.col("value").alias("density"), "susceptibility", ((F.col("cell") % 4) * 50.0 + 25).alias("x"))


_LOG = "CASE WHEN s_suppkey % 3 = 0 THEN 'noise' ELSE concat('Iter ', s_suppkey, ': objective=', s_suppkey*2, '.5 gravity=1.5e', s_suppkey % 4, ' rms: 0.', s_suppkey % 9) END"


@query("convergence_log", f"WITH {_lines_sql(_LOG)} SELECT line_no, (line_no-1)::INT AS iteration, (line_no-1)*2+0.5::DOUBLE AS objective, 1.5*pow(10, (line_no-1) % 4) AS gravity, NULL::DOUBLE AS magnetic, ((line_no-1) % 9)/10.0 AS rms FROM lines WHERE (line_no-1) % 3 <> 0")
def convergence_log(spark, d):
    return t.convergence(_lines(spark, d, _LOG)).drop("path")


@query("raw_survey", "SELECT o_orderkey AS obs_id, (o_orderkey % 300)*10.0 AS x, -o_totalprice AS value, 'gravity' AS kind FROM orders UNION ALL SELECT o_orderkey, (o_orderkey % 300)*10.0, o_totalprice-58874.0, 'tmi' FROM orders")
def raw_survey(spark, d):
    o = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id"), ((F.col("o_orderkey") % 300) * 10.0).alias("x"), "o_totalprice")
    grav = o.select("obs_id", "x", (-F.col("o_totalprice")).alias("value"), F.lit("gravity").alias("kind"))
    return grav.unionByName(o.select("obs_id", "x", (F.col("o_totalprice") - 58874.0).alias("value"), F.lit("tmi").alias("kind")))


def _ring(spark):
    """A small OBJ text with a quad and a triangle."""
    text = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\n# c\nf 1/1/1 2/2 3 4\nfo 1 2 3\n"
    return t.number_lines(spark.createDataFrame([("a.obj", text)], "path string, text string"))


@query("obj_mesh", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1::BIGINT, 2::BIGINT), (1, 0, 2, 3), (2, 0, 1, 2)) x(t_id, v0, v1, v2)")
def obj_mesh(spark, d):
    return t.obj(_ring(spark))[1].drop("path")


@query("tsurf_round_trip", f"WITH {b.VERTICES_SQL},\n{b.TRIANGLES_SQL}, v AS (SELECT v_id, row_number() OVER (ORDER BY v_id)-1 AS n FROM vertices) SELECT p.n AS v0, q.n AS v1, r.n AS v2 FROM triangles JOIN v p ON p.v_id = v0 JOIN v q ON q.v_id = v1 JOIN v r ON r.v_id = v2")
def tsurf_round_trip(spark, d):
    v, tri = b.vertices(spark, d), b.triangles(spark, d)
    lines = w.tsurf_lines(v, tri, "patch")
    numbered = dense_number(lines, ["part", "ord"], "line_no", 1, partitions(lines)).select(F.lit("x.ts").alias("path"), "line_no", "line")
    return t.tsurf(numbered)[1].select("v0", "v1", "v2")


@query("vertex_text", f"WITH {b.VERTICES_SQL} SELECT v_id AS ord, printf('%d %.3f %.3f %.3f', v_id, x, y, z) AS line FROM vertices")
def vertex_text(spark, d):
    return w.vertex_lines(b.vertices(spark, d))


@query("triangle_text", f"WITH {b.TRIANGLES_SQL} SELECT t_id AS ord, printf('%d %d %d %d', t_id, v0, v1, v2) AS line FROM triangles")
def triangle_text(spark, d):
    return w.triangle_lines(b.triangles(spark, d))


@query("obj_text", f"WITH {b.VERTICES_SQL},\n{b.TRIANGLES_SQL} SELECT 0 AS part, v_id AS ord, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM vertices UNION ALL SELECT 1, t_id, printf('f %d %d %d', v0+1, v1+1, v2+1) FROM triangles")
def obj_text(spark, d):
    return w.obj_lines(b.vertices(spark, d), b.triangles(spark, d), places=6)


@query("tsurf_text", f"""WITH {b.VERTICES_SQL},
{b.TRIANGLES_SQL} SELECT * FROM (VALUES (0, 0::BIGINT, 'GOCAD TSurf 1'), (0, 1, 'HEADER {{'), (0, 2, 'name:volume_group_1'), (0, 3, '}}'), (0, 4, 'TFACE'), (3, 0, 'END')) h(part, ord, line)
 UNION ALL SELECT 1, v_id, printf('VRTX %d %.8e %.8e %.8e', v_id+1, x, y, z) FROM vertices UNION ALL SELECT 2, t_id, printf('TRGL %d %d %d', v0+1, v1+1, v2+1) FROM triangles""")
def tsurf_text(spark, d):
    return w.tsurf_lines(b.vertices(spark, d), b.triangles(spark, d), "volume_group_1")


@query("group_file_names", "SELECT n_nationkey, regexp_replace(n_name || ' (v1.0-a)', '[ \\-.()]', '_', 'g') AS name FROM nation")
def group_file_names(spark, d):
    return b.read(spark, d, "nation").select("n_nationkey", w.safe_name(F.concat("n_name", F.lit(" (v1.0-a)"))).alias("name"))


@query("natural_sort", "SELECT s_suppkey, row_number() OVER (ORDER BY regexp_extract(s_name, '(\\d+)$', 1)::BIGINT DESC, s_suppkey) AS place FROM supplier")
def natural_sort(spark, d):
    trailing = F.regexp_extract("s_name", r"(\d+)$", 1).cast("bigint")
    keyed = b.read(spark, d, "supplier").select("s_suppkey", (-trailing).alias("last"))
    return m.dense_number(keyed, ["last", "s_suppkey"], "place", 1).select("s_suppkey", "place")


@query("positional_join", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i FROM supplier), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) SELECT s_suppkey, c_custkey FROM a JOIN c USING (i)")
def positional_join(spark, d):
    one = m.dense_number(b.read(spark, d, "supplier").select("s_acctbal", "s_suppkey"), ["s_acctbal", "s_suppkey"], "i")
    two = m.dense_number(b.read(spark, d, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"], "i")
    return one.join(two, "i").select("s_suppkey", "c_custkey")


_PAIR = f"WITH {b.OBS_SQL},\n{b.BOXES_SQL},\n{s.box_facets()},\npair AS (SELECT * FROM obs, facets),\n{s.pair_ctes()}\n"


_PREDICTED = f"p AS (SELECT obs_id, any_value(value) AS value, sum({s.gravity_term()} * {G_MGAL!r}::DOUBLE * density) AS predicted FROM k4 GROUP BY obs_id)"


@query("predicted_table", f"{_PAIR}, {_PREDICTED} SELECT obs_id, value AS observed, round(predicted, 6) AS predicted, round(value-predicted, 6) AS residual FROM p")
def predicted_table(spark, d):
    pts = b.obs(spark, d)
    p = gravity(pts, box_facets(b.boxes(spark, d))).withColumnRenamed("response", "predicted")
    return w.predicted(pts, p).select("obs_id", "observed", F.round("predicted", 6).alias("predicted"), F.round("residual", 6).alias("residual"))


@query("cell_table", f"WITH {b.VOXELS_SQL}, g AS (SELECT r_regionkey + 1 AS label, r_name AS name, 2.5+r_regionkey AS gd FROM region) SELECT cell_id, label, coalesce(name, '') AS name, coalesce(gd, 0) AS group_density FROM voxels LEFT JOIN g USING (label)")
def cell_table(spark, d):
    groups = b.read(spark, d, "region").select((F.col("r_regionkey") + 1).alias("group_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 2.5).alias("density"))
    return w.cell_table(b.voxels(spark, d), groups).select("cell_id", "label", "name", "group_density")


@query("cluster_table", f"WITH {b.VOXELS_SQL}, s AS (SELECT label, count(*) AS n, avg(density) AS m, stddev_pop(density) AS sd, avg(susceptibility) AS c, stddev_pop(susceptibility) AS sc FROM voxels GROUP BY label) SELECT label, n, round(m-sd, 6) AS density_p10, round(m+sd, 6) AS density_p90, round(greatest(0, c-sc), 6) AS susceptibility_p10, abs(c) > 1e-12 AS has_susceptibility FROM s")
def cluster_table(spark, d):
    rows = w.cluster_table(c.summary(b.voxels(spark, d)))
    return rows.select("label", "n", *[F.round(x, 6).alias(x) for x in ("density_p10", "density_p90", "susceptibility_p10")], "has_susceptibility")


@query("model_file", f"WITH {b.VOXELS_SQL} SELECT row_number() OVER (ORDER BY iy, ix, iz) AS place, printf('%.6f', CASE WHEN label = 0 THEN -9999.0 ELSE density END) AS line FROM voxels")
def model_file(spark, d):
    cells = b.voxels(spark, d).select("ix", "iy", "iz", F.when(F.col("label") != 0, F.col("density")).alias("value"))
    rows = w.model_values(cells)
    return m.dense_number(rows, ["ord"], "place", start=1).select("place", "line")


@query("history_log", "SELECT n_nationkey AS ord, concat_ws(chr(9), n_nationkey::VARCHAR, printf('%.6f', n_regionkey*1.5), printf('%.6f', n_nationkey/4.0)) AS line FROM nation")
def history_log(spark, d):
    h = b.read(spark, d, "nation").select(F.col("n_nationkey").alias("iteration"), (F.col("n_regionkey") * 1.5).alias("objective"), (F.col("n_nationkey") / 4.0).alias("rms"))
    return w.log_lines(h, ["objective", "rms"])


@query("classified_grid", f"WITH {b.BOXES_SQL}, g AS (SELECT i*1000+j AS obs_id, i*37.0+5 AS x, j*37.0+5 AS y, -300.0::DOUBLE AS z FROM range(0, 140) a(i), range(0, 36) c(j)) SELECT coalesce(group_id, -1) AS label, count(*) AS n FROM g LEFT JOIN boxes ON x < cx+50 AND x >= cx-50 AND y+1.234567e-6 BETWEEN cy-50 AND cy+50 GROUP BY 1")
def classified_grid(spark, d):
    i = spark.range(0, 140).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(35))).alias("j"))
    grid = i.select((F.col("i") * 1000 + F.col("j")).alias("obs_id"), (F.col("i") * 37.0 + 5).alias("x"), (F.col("j") * 37.0 + 5).alias("y"), F.lit(-300.0).alias("z"))
    return classify(grid, box_facets(b.boxes(spark, d))).groupBy(F.col("group_id").alias("label")).agg(F.count("*").alias("n"))


@query("merged_meshes", f"WITH {b.VERTICES_SQL}, m AS (SELECT k.m, v_id, row_number() OVER (PARTITION BY k.m ORDER BY v_id)-1 AS i FROM vertices, (VALUES (0),(1),(2)) k(m)), n AS (SELECT m, count(*) AS n FROM m GROUP BY m), o AS (SELECT m, coalesce(sum(n) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n) SELECT m AS mesh_id, v_id, (i+off)::BIGINT AS merged_id FROM m JOIN o USING (m)")
def merged_meshes(spark, d):
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = b.vertices(spark, d).select("v_id", three.alias("mesh_id"))
    return m.dense_number(rows, ["mesh_id", "v_id"], "merged_id").select("mesh_id", "v_id", "merged_id")
