"""Queries that write files to the shared folder and read them back, and on whole text files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terralith.operators.forward import box_facets
from terralith.operators.storage import shared_dir
from terralith.plans import bindings as b
from terralith.plans import sqlgen as sql
from terralith.plans.registry import query
from terralith.sources import grids
from terralith.sources import text as t
from terralith.sources import write as w


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}/{name}"


@query("mesh_by_extension", f"WITH {b.VERTICES_SQL},\n{b.TRIANGLES_SQL}, n AS (SELECT (SELECT count(*) FROM vertices) AS v, (SELECT count(*) FROM triangles) AS t, (SELECT sum(v0) FROM (SELECT p.n AS v0 FROM triangles JOIN (SELECT v_id, row_number() OVER (ORDER BY v_id)-1 AS n FROM vertices) p ON p.v_id = v0)) AS s) SELECT f AS format, v AS n_vertices, t AS n_triangles, s AS first_corners FROM n, (VALUES ('obj'), ('ts')) x(f)")
def mesh_by_extension(spark, d):
    """The height field written as OBJ and TSurf and loaded by the folder's extension."""
    from terralith.operators.mesh import dense_number

    number = dense_number(b.vertices(spark, d).select("v_id", "x", "y", "z"), ["v_id"], "n").select("v_id", "n", "x", "y", "z")
    tri = b.triangles(spark, d).select("t_id", "v0", "v1", "v2")
    for c in ("v0", "v1", "v2"):
        tri = tri.join(number.select(F.col("v_id").alias(c), F.col("n").alias(f"n{c}")), c).drop(c).withColumnRenamed(f"n{c}", c)
    v = number.select(F.col("n").alias("v_id"), "x", "y", "z")
    out = []
    for form, lines in (("obj", w.obj_lines(v, tri)), ("ts", w.tsurf_lines(v, tri, "patch"))):
        path = place(spark, f"mesh.{form.upper()}")
        w.write_lines(lines, path)
        vertices, triangles = t.load_mesh(spark, path)
        row = vertices.agg(F.count("*").alias("n_vertices")).crossJoin(triangles.agg(F.count("*").alias("n_triangles"), F.sum("v0").alias("first_corners")))
        out.append(row.select(F.lit(form).alias("format"), "n_vertices", "n_triangles", "first_corners"))
    return out[0].unionByName(out[1])


_TS = "CASE s_suppkey % 10 WHEN 0 THEN 'GOCAD TSurf 1' WHEN 1 THEN 'HEADER {' WHEN 2 THEN concat(' *name: body ', s_suppkey, ' ') WHEN 3 THEN '}' WHEN 4 THEN 'name:late' ELSE concat('VRTX ', s_suppkey, ' 0 0 0') END"


@query("tsurf_names", "SELECT concat('f', (s_suppkey // 10)) AS path, concat('body ', s_suppkey) AS name FROM supplier WHERE s_suppkey % 10 = 2 AND EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey // 10 = supplier.s_suppkey // 10 AND o.s_suppkey % 10 < 2)")
def tsurf_names(spark, d):
    """One TSurf text for ten suppliers: names in the header count, those behind it do not."""
    k = F.col("s_suppkey")
    lines = b.read(spark, d, "supplier").select(F.concat(F.lit("f"), F.floor(k / 10).cast("string")).alias("path"), (k % 10 + 1).cast("int").alias("line_no"), F.expr(_TS).alias("line"))
    return t.tsurf_names(lines).filter("name <> ''").join(lines.filter("line_no <= 2").select("path").distinct(), "path", "left_semi")


@query("tensor_mesh_text", "SELECT n_nationkey || '.msh' AS path, n_nationkey+1 AS nx, 3 AS ny, n_regionkey+2 AS nz, n_nationkey*10.0 AS x0, -5.0 AS y0, 100.0 AS z0, n_nationkey+0.5 AS dx, 25.0 AS dy, 10.0 AS dz FROM nation")
def tensor_mesh_text(spark, d):
    """A mesh text for each nation: dimensions, origin, widths with and without counts."""
    n = b.read(spark, d, "nation")
    text = F.concat_ws("\n", F.concat_ws(" ", F.col("n_nationkey") + 1, F.lit(3), F.col("n_regionkey") + 2), F.concat_ws("  ", F.col("n_nationkey") * 10, F.lit("-5"), F.lit("100.0")),
                       F.concat(F.col("n_nationkey") + 1, F.lit("*"), F.col("n_nationkey") + 0.5), F.lit("25 25 25"), F.concat(F.col("n_regionkey") + 2, F.lit("*10")), F.lit(""))
    return t.tensor_mesh(t.number_lines(n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".msh")).alias("path"), text.alias("text"))))


@query("label_grid_file", f"WITH {b.VOXELS_SQL}, z AS (SELECT max(iz) AS top FROM voxels) SELECT i.i::INT AS ix, j.j::INT AS iy, k.k::INT AS iz, coalesce(label, -1)::INT AS label FROM range(10) i(i), range(10) j(j), z, unnest(range(0, top+1)) k(k) LEFT JOIN voxels v ON v.ix = i.i AND v.iy = j.j AND v.iz = k.k")
def label_grid_file(spark, d):
    """Voxel labels written as one binary file, slab by slab, and read back; absent cells are -1."""
    cells = b.voxels(spark, d)
    path = place(spark, "labels.bin")
    w.write_label_grid(cells, (10, 10, int(cells.agg(F.max("iz")).first()[0]) + 1), path)
    return t.label_grid(spark, path)


@query("label_grid_ranges", f"WITH {b.VOXELS_SQL}, z AS (SELECT max(iz) AS top FROM voxels) SELECT i.i::INT AS ix, j.j::INT AS iy, k.k::INT AS iz, coalesce(label, -1)::INT AS label FROM range(10) i(i), range(10) j(j), z, unnest(range(0, top+1)) k(k) LEFT JOIN voxels v ON v.ix = i.i AND v.iy = j.j AND v.iz = k.k")
def label_grid_ranges(spark, d):
    """The same file read in byte ranges by the data source, a thousand labels a partition."""
    cells = b.voxels(spark, d)
    path = place(spark, "labels.bin")
    w.write_label_grid(cells, (10, 10, int(cells.agg(F.max("iz")).first()[0]) + 1), path)
    return grids.read_label_grid(spark, path, 4000)


@query("strict_model_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_retailprice AS value FROM part")
def strict_model_lines(spark, d):
    """One model file with a value for every part, seven to a line, read in splits and numbered by ranges."""
    part = b.read(spark, d, "part")
    n = part.count()
    body = part.groupBy(F.floor(F.col("p_partkey") / 7).alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))), lambda x: x["p_retailprice"].cast("string")), " ").alias("line"))
    head = spark.createDataFrame([(0, 0, f"{n} 1 1")], "part int, ord long, line string")
    path = place(spark, "a.mod")
    w.write_lines(head.unionByName(body.withColumn("part", F.lit(1))), path)
    return t.strict_model_lines(t.read_lines(spark, path))


_CLU = "CASE WHEN s_suppkey = 1 THEN 'cluster_id,name,density,note' ELSE concat(s_suppkey, ',n', s_suppkey, ',2.5,', CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE '' END) END"


@query("cluster_csv_rewrite", "SELECT 'f' AS path, s_suppkey::INT AS line_no, CASE WHEN s_suppkey = 1 THEN 'cluster_id,name,density,note' ELSE concat(s_suppkey, ',', CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE concat('n', s_suppkey) END, ',', CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 6 = 0 THEN '3.1' ELSE '2.5' END, ',', CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE '' END) END AS line FROM supplier WHERE s_suppkey > 0")
def cluster_csv_rewrite(spark, d):
    """Some fields of a cluster file change; other columns, their order and empty fields stay."""
    k = F.col("s_suppkey")
    s = b.read(spark, d, "supplier").filter(k > 0)
    lines = s.select(F.lit("f").alias("path"), k.cast("int").alias("line_no"), F.expr(_CLU).alias("line"))
    names = s.filter(k % 4 == 0).select(k.cast("string").alias("key"), F.lit("name").alias("column"), F.lit("new").alias("value"))
    densities = s.filter((k % 4 == 0) | (k % 6 == 0)).select(k.cast("string").alias("key"), F.lit("density").alias("column"), F.lit("3.1").alias("value"))
    return t.rewrite_rows(t.cluster_rows(lines), names.unionByName(densities), "cluster_id")


@query("observed_reload", f"WITH {b.OBS_SQL} SELECT 'file' AS source, count(*) AS n, round(sum(value), 3) AS total FROM obs UNION ALL SELECT 'absent', 1, 0.0")
def observed_reload(spark, d):
    """Observations written with a header and read back; an absent file is one row of zeros."""
    o = b.obs(spark, d)
    path = place(spark, "observed.csv")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit("x,y,z,value,std").alias("line"))
    w.write_lines(head.unionByName(w.observed_lines(o)), path)
    of = lambda name, where: t.observed(spark, where).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.lit(name).alias("source"), "n", "total")
    return of("file", path).unionByName(of("absent", path + ".none"))


@query("missing_columns", "SELECT n_name AS path, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'density_min' ELSE 'cluster_name,density_max' END AS missing FROM nation")
def missing_columns(spark, d):
    head = F.when(F.col("n_nationkey") % 3 == 0, ' Cluster_Name,"density_min",density_max,x').when(F.col("n_nationkey") % 3 == 1, "density_max,cluster_name").otherwise("density_min")
    lines = b.read(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit(1).alias("line_no"), head.alias("line"))
    return t.missing_columns(lines, ["cluster_name", "density_min", "density_max"]).select("path", F.array_join("missing", ",").alias("missing"))


@query("line_numbers", "SELECT count(*) AS n, min(s_suppkey+1)::INT AS first, max(s_suppkey+1)::INT AS last, sum(s_suppkey+1)::BIGINT AS total FROM supplier")
def line_numbers(spark, d):
    """Lines of a file numbered across its splits: line n holds supplier n - 1."""
    path = place(spark, "numbers.txt")
    rows = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") + 1).cast("string").alias("line"))
    w.write_lines(rows, path)
    read = t.read_lines(spark, path).filter(F.col("line_no") == F.col("line").cast("int"))
    return read.agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.sum("line_no").alias("total"))


@query("volume_text", f"WITH {b.VERTICES_SQL},\n{b.TRIANGLES_SQL} SELECT 1 AS part, v_id AS ord, printf('VRTX %d %.6f %.6f %.6f', v_id+1, x, y, z) AS line FROM vertices UNION ALL SELECT 2, t_id, printf('TRGL %d %d %d', v0+1, v1+1, v2+1) FROM triangles UNION ALL SELECT * FROM (VALUES (0, 0, 'GOCAD TSurf 1'), (0, 1, 'HEADER {{'), (0, 2, 'name:volume_group_1_comp_0'), (0, 3, '}}'), (0, 4, 'TFACE'), (3, 0, 'END'))")
def volume_text(spark, d):
    return w.tsurf_lines(b.vertices(spark, d), b.triangles(spark, d), "volume_group_1_comp_0", places=6)


@query("surface_csv", f"WITH {b.VERTICES_SQL} SELECT 1 AS part, v_id AS ord, printf('%.3f,%.3f,%.3f', x, y, z) AS line FROM vertices UNION ALL SELECT 0, 0, 'x,y,z'")
def surface_csv(spark, d):
    return w.surface_csv(b.vertices(spark, d))


@query("convergence_csv", "SELECT 1 AS part, n_nationkey::BIGINT AS ord, printf('%d,%.6e,%.6e,%.6e,%.6e', n_nationkey, n_nationkey*0.5+1.0, n_regionkey*3.0+0.25, 2.0, 1000.0/(n_nationkey+1)) AS line FROM nation UNION ALL SELECT 0, 0, 'iter,beta,phi_d,phi_m,f'")
def convergence_csv(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return w.convergence_csv(b.read(spark, d, "nation").select(n.alias("iteration"), (n * 0.5 + 1.0).alias("beta"), (r * 3.0 + 0.25).alias("phi_d"), F.lit(2.0).alias("phi_m"), (1000.0 / (n + 1)).alias("f")))


@query("export_bundle", "SELECT f AS format, n_nationkey::INT AS \"group\", k::BIGINT AS n_lines FROM nation, (VALUES ('obj', 48), ('csv', 37), ('ts', 54)) x(f, k)")
def export_bundle(spark, d):
    """All boxes written as OBJ, TSurf and CSV in one job; lines by format and group, read back."""
    facets = box_facets(b.boxes(spark, d))
    corners = F.array(*[F.struct((F.col("t_id") * 3 + i).alias("v_id"), *[F.col(f"{c}{a}").alias(a) for a in "xyz"]) for i, c in enumerate("pqr")])
    vertices = facets.select("group_id", F.explode(corners).alias("v")).select("group_id", "v.*")
    triangles = facets.select("group_id", "t_id", *[(F.col("t_id") * 3 + i).alias(f"v{i}") for i in range(3)])
    path = place(spark, "bundle")
    w.bundle(vertices, triangles, path)
    return spark.read.text(path).groupBy("format", "group").agg(F.count("*").alias("n_lines"))


_SET = f"""WITH {b.BOXES_SQL}, {sql.box_facets()}, c AS (SELECT group_id, t_id*3+i AS v_id, CASE i WHEN 0 THEN px WHEN 1 THEN qx ELSE rx END AS x, CASE i WHEN 0 THEN py WHEN 1 THEN qy ELSE ry END AS y, CASE i WHEN 0 THEN pz WHEN 1 THEN qz ELSE rz END AS z FROM facets, range(3) k(i)),
k AS (SELECT group_id, n_name AS name, density, susceptibility FROM boxes JOIN nation ON n_nationkey = group_id),
l AS (SELECT 'volume_group_' || group_id || '.ts' AS file, unnest(['GOCAD TSurf 1', 'HEADER {{', 'name:' || regexp_replace(name, '[ .()-]', '_', 'g'), printf('*density:%.6f', density), printf('*susceptibility:%.6f', susceptibility), '}}', 'TFACE', 'END']) AS line FROM k
 UNION ALL SELECT 'volume_group_' || group_id || '.ts', printf('VRTX %d %.3f %.3f %.3f', v_id+1, x, y, z) FROM c UNION ALL SELECT 'volume_group_' || group_id || '.ts', printf('TRGL %d %d %d', t_id*3+1, t_id*3+2, t_id*3+3) FROM facets
 UNION ALL SELECT 'surface_group_' || group_id || '.csv', 'x,y,z' FROM k UNION ALL SELECT 'surface_group_' || group_id || '.csv', printf('%.3f,%.3f,%.3f', x, y, z) FROM c
 UNION ALL SELECT 'starting_model.csv', 'group_id,name,density,susceptibility' UNION ALL SELECT 'starting_model.csv', printf('%d,%s,%.6f,%.6f', group_id, name, density, susceptibility) FROM k)
SELECT * FROM l UNION ALL SELECT 'manifest.csv', file || ',' || count(*) || ',' || sum(len(line))::BIGINT FROM l GROUP BY file"""


@query("export_set", _SET)
def export_set(spark, d):
    """Closed volumes, surfaces, starting model and manifest of all boxes, written as one set and read back line by line."""
    boxes = b.boxes(spark, d)
    facets = box_facets(boxes)
    corners = F.array(*[F.struct((F.col("t_id") * 3 + i).alias("v_id"), *[F.col(f"{c}{a}").alias(a) for a in "xyz"]) for i, c in enumerate("pqr")])
    vertices = facets.select("group_id", F.explode(corners).alias("v")).select("group_id", "v.*")
    triangles = facets.select("group_id", "t_id", *[(F.col("t_id") * 3 + i).alias(f"v{i}") for i in range(3)])
    names = b.read(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    path = place(spark, "set")
    lines = w.export_lines(vertices, triangles, boxes.select("group_id", "density", "susceptibility").join(names, "group_id"))
    w.export_set(lines, path)
    w.export_set(lines, path)  # a second run takes the first one's place
    return spark.read.text(path).select("file", F.col("value").alias("line"))


@query("resolved_ini", "WITH r AS (SELECT string_agg(CASE WHEN r_regionkey % 2 = 0 THEN 'm/' ELSE '../' END || lower(r_name) || '.ts', ',' ORDER BY r_regionkey) AS m FROM region)"
       " SELECT * FROM (VALUES (0, '[data]'), (1, 'real_data = true'), (2, 'cluster_csv = ../in/clusters.csv'), (4, ''), (5, '[inversion]'), (6, 'omega = 0.5')) x(ord, line) UNION ALL SELECT 3, 'group_meshes = ' || m FROM r")
def resolved_ini(spark, d):
    """A configuration whose meshes are the regions', with paths as seen from its folder."""
    meshes = [f"/runs/{'one/m/' if r.r_regionkey % 2 == 0 else ''}{r.r_name.lower()}.ts" for r in b.read(spark, d, "region").orderBy("r_regionkey").collect()]
    options = {"data": {"real_data": True, "cluster_csv": "/runs/in/clusters.csv", "observed_gravity_csv": None, "group_meshes": meshes}, "inversion": {"omega": 0.5}}
    lines = w.ini_text(options, "/runs/one/run.ini", ("cluster_csv", "observed_gravity_csv", "group_meshes"))
    return spark.createDataFrame(list(enumerate(lines)), "ord int, line string")



