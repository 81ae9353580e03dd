"""Queries on meshes, voxels, graphs and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import forward as fw
from terralith.operators import graph as gr
from terralith.operators import locate as lo
from terralith.operators import mesh as m
from terralith.operators import voxel as vx
from terralith.plans import bindings as b
from terralith.plans import sqlgen as s
from terralith.plans.registry import query

_MESH = f"WITH RECURSIVE {b.VERTICES_SQL},\n{b.TRIANGLES_SQL},\n dir AS (SELECT t_id, v0 AS a, v1 AS b FROM triangles UNION ALL SELECT t_id, v1, v2 FROM triangles UNION ALL SELECT t_id, v2, v0 FROM triangles),\n edges AS (SELECT a, b FROM dir UNION SELECT b, a FROM dir)"
_VOX = f"WITH RECURSIVE {b.VOXELS_SQL}"
_NBR = "nbr AS (SELECT c.cell_id, c.label, o.cell_id AS other, o.label AS other_label FROM voxels c JOIN voxels o ON abs(c.ix-o.ix)+abs(c.iy-o.iy)+abs(c.iz-o.iz) = 1)"


def _mesh(spark, d):
    t = b.triangles(spark, d)
    return b.vertices(spark, d), t, m.undirected_edges(t)


@query("grid_triangles", f"{_MESH} SELECT t_id, v0, v1, v2 FROM triangles")
def grid_triangles(spark, d):
    return b.triangles(spark, d)


@query("triangle_corners", f"{_MESH} SELECT t_id, p.x AS px, p.z AS pz, q.x AS qx, q.z AS qz, r.x AS rx, r.z AS rz FROM triangles JOIN vertices p ON p.v_id = v0 JOIN vertices q ON q.v_id = v1 JOIN vertices r ON r.v_id = v2")
def triangle_corners(spark, d):
    v, t, _ = _mesh(spark, d)
    return fw.mesh_facets(v.drop("freedom"), t).select("t_id", "px", "pz", "qx", "qz", "rx", "rz")


@query("boundary_edges", f"{_MESH} SELECT arg_min(a, t_id) AS a, arg_min(b, t_id) AS b FROM dir GROUP BY least(a, b), greatest(a, b) HAVING count(*) = 1")
def boundary_edges(spark, d):
    return m.boundary_edges(b.triangles(spark, d))


_MEAN = "mean AS (SELECT e.a AS v_id, avg(o.x) AS mx, avg(o.y) AS my, avg(o.z) AS mz, count(*) AS n_same FROM edges e JOIN vertices v ON v.v_id = e.a JOIN vertices o ON o.v_id = e.b WHERE v.freedom = o.freedom AND v.freedom <> 'FIXED' GROUP BY e.a)"
_LAP = (
    _MEAN
    + ", lap AS (SELECT v_id, freedom, n_same, CASE WHEN freedom LIKE '%X%' AND freedom <> 'FIXED' THEN x-mx ELSE 0 END AS dx, CASE WHEN freedom LIKE '%Y\\_FREE' ESCAPE '\\' OR freedom LIKE 'XYZ%' THEN y-my ELSE 0 END AS dy, CASE WHEN freedom LIKE '%Z%' THEN z-mz ELSE 0 END AS dz FROM vertices JOIN mean USING (v_id))"
)


@query("neighbor_mean_laplacian", f"{_MESH}, {_LAP} SELECT v_id, round(dx, 6)+0.0 AS dx, round(dy, 6)+0.0 AS dy, round(dz, 6)+0.0 AS dz, n_same FROM lap")
def neighbor_mean_laplacian(spark, d):
    v, _, e = _mesh(spark, d)
    return m.laplacian(v, e).select("v_id", *[(F.round(f"d{c}", 6) + 0.0).alias(f"d{c}") for c in "xyz"], "n_same")


@query("smoothness_penalty", f"{_MESH}, {_LAP} SELECT round(sum(0.5*0.1*(dx*dx+dy*dy+dz*dz)), 4) AS penalty, count(*) AS n_vertices FROM lap")
def smoothness_penalty(spark, d):
    v, _, e = _mesh(spark, d)
    return m.smoothness_penalty(v, e, 0.1).select(F.round("penalty", 4).alias("penalty"), "n_vertices")


@query("smoothness_gradient", f"{_MESH}, {_LAP}, back AS (SELECT e.b AS v_id, sum(l.dx/l.n_same) AS sx, sum(l.dy/l.n_same) AS sy, sum(l.dz/l.n_same) AS sz FROM edges e JOIN lap l ON l.v_id = e.a JOIN vertices o ON o.v_id = e.b WHERE o.freedom = l.freedom GROUP BY e.b) SELECT v_id, round(dx-coalesce(sx,0), 9)+0.0 AS gx, round(dy-coalesce(sy,0), 9)+0.0 AS gy, round(dz-coalesce(sz,0), 9)+0.0 AS gz FROM lap LEFT JOIN back USING (v_id)")
def smoothness_gradient(spark, d):
    v, _, e = _mesh(spark, d)
    return m.smoothness_gradient(v, e).select("v_id", *[(F.round(f"g{c}", 9) + 0.0).alias(f"g{c}") for c in "xyz"])


@query("gradient_smoothing", f"{_MESH}, g AS (SELECT v_id, z/100.0 AS g FROM vertices), n AS (SELECT e.a AS v_id, avg(g.g) AS m FROM edges e JOIN g ON g.v_id = e.b GROUP BY e.a) SELECT v_id, round(0.7*g+0.3*m, 9) AS g FROM g JOIN n USING (v_id)")
def gradient_smoothing(spark, d):
    from terralith.operators.inversion import smooth_gradient

    v, _, e = _mesh(spark, d)
    return smooth_gradient(v.select("v_id", (F.col("z") / 100.0).alias("g")), e, 0.3).select("v_id", F.round("g", 9).alias("g"))


_OFF = "around AS (SELECT e.a AS v_id, avg(o.x) AS mx, avg(o.y) AS my, avg(o.z) AS mz FROM edges e JOIN vertices o ON o.v_id = e.b GROUP BY e.a), off AS (SELECT v_id, sqrt(pow(x-mx,2)+pow(y-my,2)+pow(z-mz,2)) AS o FROM vertices JOIN around USING (v_id)), side AS (SELECT greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM vertices)"


@query("spike_check", f"{_MESH}, {_OFF} SELECT v_id, round(o, 6) AS \"offset\" FROM off, side WHERE o > s*0.1")
def spike_check(spark, d):
    v, _, e = _mesh(spark, d)
    return m.spikes(v, e, 0.1).select("v_id", F.round("offset", 6).alias("offset"))


_SHARED = "meshes AS (SELECT v.v_id, k.m AS mesh_id, x + CASE WHEN v_id % 3 = 0 THEN 0.0 ELSE k.m*0.25 END AS x, y, z, freedom FROM vertices v, (VALUES (0),(1),(2)) k(m))"


def _meshes(spark, d):
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    rows = b.vertices(spark, d).withColumn("mesh_id", three)
    return rows.withColumn("x", F.col("x") + F.when(F.col("v_id") % 3 == 0, 0.0).otherwise(F.col("mesh_id") * 0.25))


_Q = ", ".join(f"round({c}*1e6)::BIGINT AS q{c}" for c in "xyz")


@query("shared_vertices", f"WITH {b.VERTICES_SQL}, {_SHARED}, q AS (SELECT mesh_id, {_Q} FROM meshes) SELECT qx, qy, qz, count(DISTINCT mesh_id) AS n_meshes, count(*) AS n_vertices FROM q GROUP BY ALL HAVING count(*) >= 2")
def shared_vertices(spark, d):
    return m.shared_vertices(_meshes(spark, d))


@query("shared_vertex_average", f"WITH {b.VERTICES_SQL}, {_SHARED} SELECT mesh_id, v_id, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y, round(avg(z) OVER w, 6) AS z FROM meshes WINDOW w AS (PARTITION BY round(x)::BIGINT, round(y)::BIGINT, round(z)::BIGINT)")
def shared_vertex_average(spark, d):
    return m.shared_vertex_average(_meshes(spark, d)).select("mesh_id", "v_id", *[F.round(c, 6).alias(c) for c in "xyz"])


_AX = "dofs AS (SELECT mesh_id, v_id, x, y, z, unnest(CASE freedom WHEN 'Z_ONLY' THEN ['z'] WHEN 'XY_FREE' THEN ['x','y'] WHEN 'XYZ_FREE' THEN ['x','y','z'] ELSE [] END) AS axis FROM meshes)"


@query("dof_expansion", f"WITH {b.VERTICES_SQL}, {_SHARED}, {_AX} SELECT mesh_id, v_id, axis FROM dofs")
def dof_expansion(spark, d):
    return m.dof_rows(_meshes(spark, d)).select("mesh_id", "v_id", "axis")


@query("global_dof_dedup", f"WITH {b.VERTICES_SQL}, {_SHARED}, {_AX}, q AS (SELECT *, {_Q} FROM dofs), f AS (SELECT qx, qy, qz, axis, min(struct_pack(m := mesh_id, v := v_id, a := axis)) AS first, count(*) AS n_refs FROM q GROUP BY ALL) SELECT row_number() OVER (ORDER BY first) - 1 AS dof_id, first.m AS mesh_id, first.v AS v_id, axis, n_refs FROM f")
def global_dof_dedup(spark, d):
    return m.global_dofs(_meshes(spark, d))


@query("dof_bounds", f"WITH {b.VERTICES_SQL}, {_SHARED}, {_AX}, q AS (SELECT *, {_Q}, CASE WHEN axis = 'z' THEN -1000.0-mesh_id ELSE 0.0 END AS lo, CASE WHEN axis = 'z' THEN 0.0-mesh_id ELSE 4000.0-mesh_id END AS hi FROM dofs) SELECT qx, qy, qz, axis, max(lo) AS lower, min(hi) AS upper FROM q GROUP BY ALL")
def dof_bounds(spark, d):
    rows = m.dof_rows(_meshes(spark, d)).withColumns({f"q{c}": m.lattice(F.col(c)) for c in "xyz"})
    z = F.col("axis") == "z"
    lower = F.when(z, -1000.0 - F.col("mesh_id")).otherwise(0.0)
    upper = F.when(z, 0.0 - F.col("mesh_id")).otherwise(4000.0 - F.col("mesh_id"))
    return rows.groupBy("qx", "qy", "qz", "axis").agg(F.max(lower).alias("lower"), F.min(upper).alias("upper"))


@query("model_bounds", f"WITH {b.VERTICES_SQL} SELECT " + ", ".join(f"round(min({c})-greatest(max({c})-min({c}),1)*0.02, 6) AS {c}_lo, round(max({c})+greatest(max({c})-min({c}),1)*0.02, 6) AS {c}_hi" for c in "xyz") + " FROM vertices")
def model_bounds(spark, d):
    rows = m.model_bounds(b.vertices(spark, d), 2.0)
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


_CELL = "least(11, floor(({0}-lo_{0})/greatest(hi_{0}-lo_{0}, 1e-12)*12))"
_BIN = f"box AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in 'xyz')} FROM vertices), bins AS (SELECT v_id, x, y, z, ({_CELL.format('x')}*144+{_CELL.format('y')}*12+{_CELL.format('z')})::BIGINT AS bin FROM vertices, box)"


@query("vertex_cluster_decimate", f"{_MESH}, {_BIN} SELECT bin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n_merged FROM bins GROUP BY bin")
def vertex_cluster_decimate(spark, d):
    v, t, _ = _mesh(spark, d)
    return m.decimate(v, t, 12)[0].select("bin", *[F.round(c, 6).alias(c) for c in "xyz"], "n_merged")


@query("decimated_faces", f"{_MESH}, {_BIN} SELECT t_id, p.bin AS v0, q.bin AS v1, r.bin AS v2 FROM triangles JOIN bins p ON p.v_id = v0 JOIN bins q ON q.v_id = v1 JOIN bins r ON r.v_id = v2 WHERE p.bin <> q.bin AND q.bin <> r.bin AND p.bin <> r.bin")
def decimated_faces(spark, d):
    v, t, _ = _mesh(spark, d)
    return m.decimate(v, t, 12)[1]


@query("closed_mesh_volume", f"{_MESH}, solid AS (SELECT count(*)*2 + 2*(SELECT count(*) FROM (SELECT 1 FROM dir GROUP BY least(a,b), greatest(a,b) HAVING count(*) = 1)) AS n FROM triangles), cellvol AS (SELECT sum((p.z+q.z+r.z)/3.0+2000.0)*5000.0 AS v FROM triangles JOIN vertices p ON p.v_id = v0 JOIN vertices q ON q.v_id = v1 JOIN vertices r ON r.v_id = v2) SELECT n AS n_triangles, round(v, 2) AS volume FROM solid, cellvol")
def closed_mesh_volume(spark, d):
    v, t, _ = _mesh(spark, d)
    offset = 1 << 30
    closed = m.closed_between(v, -2000.0, t, offset).withColumn("t_id", F.monotonically_increasing_id())
    flat = v.select((F.col("v_id") + offset).alias("v_id"), "x", "y", F.lit(-2000.0).alias("z"))
    facets = fw.mesh_facets(v.select("v_id", "x", "y", "z").unionByName(flat), closed)
    return fw.mesh_volume(facets.withColumn("body", F.lit(1)), ["body"]).crossJoin(F.broadcast(closed.agg(F.count("*").alias("n_triangles")))).select("n_triangles", F.round("volume", 2).alias("volume"))


@query("interior_submesh", f"{_MESH}, keep AS (SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM vertices WHERE v_id % 40 BETWEEN 1 AND 38 AND v_id >= 40) SELECT t_id, p.new_id AS v0, q.new_id AS v1, r.new_id AS v2 FROM triangles JOIN keep p ON p.v_id = v0 JOIN keep q ON q.v_id = v1 JOIN keep r ON r.v_id = v2")
def interior_submesh(spark, d):
    v, t, _ = _mesh(spark, d)
    keep = m.dense_number(v.filter("v_id % 40 between 1 and 38 and v_id >= 40").select("v_id"), ["v_id"], "new_id")
    for i in range(3):
        t = t.join(keep.select(F.col("v_id").alias(f"v{i}"), F.col("new_id").alias(f"n{i}")), f"v{i}")
    return t.select("t_id", *[F.col(f"n{i}").alias(f"v{i}") for i in range(3)])


_EXT = (
    "stack AS (SELECT n_nationkey AS group_id, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, -100.0*n_nationkey AS cz, 50.0::DOUBLE AS half FROM nation),\n"
    + s.box_facets("stack", "group_id")
    + """, crn AS (SELECT *, list_sort([struct_pack(z := round(pz*1e6)::BIGINT, y := round(py*1e6)::BIGINT, x := round(px*1e6)::BIGINT), struct_pack(z := round(qz*1e6)::BIGINT, y := round(qy*1e6)::BIGINT, x := round(qx*1e6)::BIGINT), struct_pack(z := round(rz*1e6)::BIGINT, y := round(ry*1e6)::BIGINT, x := round(rx*1e6)::BIGINT)]) AS face FROM facets),
 use AS (SELECT *, count(*) OVER (PARTITION BY face) AS uses FROM crn)"""
)


def _stack(spark, d):
    n = F.col("n_nationkey")
    boxes = b.read(spark, d, "nation").select(n.alias("group_id"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), (-100.0 * n).alias("cz"), F.lit(50.0).alias("half"))
    return fw.box_facets(boxes)


@query("shared_faces", f"WITH {_EXT} SELECT group_id, t_id, uses FROM use")
def shared_faces(spark, d):
    keyed = m.face_keys(_stack(spark, d))
    return keyed.join(keyed.groupBy("face").agg(F.count("*").alias("uses")), "face").select("group_id", "t_id", "uses")


def _corner_ids():
    """Ids of box corners by their signs, so that facets have vertex numbers."""
    return [sum((F.when(F.col(f"{c}{a}") > F.col(f"c{a}"), 1).otherwise(0) * k for a, k in zip("xyz", (4, 2, 1), strict=True)), F.lit(0)).alias(f"v{i}") for i, c in enumerate("pqr")]


_VOTES = f"""WITH {_EXT}, n AS (SELECT group_id, uses, {', '.join(f'{e} AS n{a}' for a, e in zip('xyz', s.cross(s.minus(s.v('q'), s.v('p')), s.minus(s.v('r'), s.v('p'))), strict=True))},
 unnest([{', '.join(f"(CASE WHEN {c}x > 0 THEN 4 ELSE 0 END + CASE WHEN {c}y > 0 THEN 2 ELSE 0 END + CASE WHEN {c}z > -100.0*group_id THEN 1 ELSE 0 END)" for c in 'pqr')}]) AS v_id FROM use)
 SELECT group_id AS mesh_id, v_id, count(CASE WHEN uses = 1 AND abs(nz) >= abs(nx) AND abs(nz) >= abs(ny) THEN 1 END) AS top_bottom,
 count(CASE WHEN uses = 1 AND NOT (abs(nz) >= abs(nx) AND abs(nz) >= abs(ny)) AND abs(ny) >= abs(nx) THEN 1 END) AS north_south,
 count(CASE WHEN uses = 1 AND NOT (abs(nz) >= abs(nx) AND abs(nz) >= abs(ny)) AND abs(ny) < abs(nx) THEN 1 END) AS east_west, bool_or(uses > 1) AS touches_shared FROM n GROUP BY 1, 2"""


@query("exterior_face_votes", _VOTES)
def exterior_face_votes(spark, d):
    facets = _stack(spark, d).withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "cz": -100.0 * F.col("group_id")})
    return m.exterior_votes(facets.select(F.col("group_id").alias("mesh_id"), "t_id", *_corner_ids(), *fw.CORNERS))


@query("exterior_freedom", f"""WITH votes AS ({_VOTES}), sides AS (SELECT *, top_bottom > 0 AS t, north_south > 0 AS s, east_west > 0 AS e FROM votes),
 seen AS (SELECT *, CASE t::INT * 4 + s::INT * 2 + e::INT WHEN 7 THEN 'FIXED' WHEN 6 THEN 'X_ONLY' WHEN 5 THEN 'Y_ONLY' WHEN 4 THEN 'XY_FREE' WHEN 3 THEN 'Z_ONLY' WHEN 2 THEN 'X_ONLY' WHEN 1 THEN 'Y_ONLY' ELSE 'XYZ_FREE' END AS own FROM sides)
 SELECT mesh_id, v_id, CASE WHEN NOT touches_shared OR t THEN own WHEN own IN ('FIXED', 'XY_FREE') THEN 'XYZ_FREE' WHEN own = 'X_ONLY' THEN 'XZ_FREE' WHEN own = 'Y_ONLY' THEN 'YZ_FREE' ELSE own END AS freedom FROM seen""")
def exterior_freedom(spark, d):
    return m.exterior_freedom(exterior_face_votes(spark, d))


def strips(triangles):
    """Strips three cells wide, each with vertices of its own, so that they are separate bodies."""
    strip = F.floor((F.col("v0") % 40) / 3).alias("s")
    own = triangles.select("t_id", strip, "v0", "v1", "v2")
    return own.select("t_id", *[(F.col(f"v{i}") * 100 + F.col("s")).alias(f"v{i}") for i in range(3)])


@query("face_components_by_edge", f"{_MESH}, k AS (SELECT t_id, (v0 % 40) // 3 AS strip FROM triangles) SELECT t_id, min(t_id) OVER (PARTITION BY strip) AS root FROM k")
def face_components_by_edge(spark, d):
    return gr.face_components(strips(b.triangles(spark, d)))


@query("face_components_by_vertex", f"{_MESH} SELECT t_id, min(t_id) OVER (PARTITION BY (v0 % 40 + v0 // 40) % 2) AS root FROM triangles")
def face_components_by_vertex(spark, d):
    # two colours of a chessboard with vertices of their own: cells of one colour meet in corners only
    colour = ((F.col("v0") % 40 + F.floor(F.col("v0") / 40)) % 2).alias("c")
    two = b.triangles(spark, d).select("t_id", colour, "v0", "v1", "v2")
    return gr.face_components(two.select("t_id", *[(F.col(f"v{i}") * 2 + F.col("c")).alias(f"v{i}") for i in range(3)]), by_edge=False)


@query("component_ranks", f"{_MESH}, k AS (SELECT t_id, (v0 % 40) // 3 AS strip FROM triangles), r AS (SELECT min(t_id) AS root, count(*) AS n FROM k GROUP BY strip) SELECT root, n, row_number() OVER (ORDER BY n DESC, root) AS rank FROM r WHERE n >= 3")
def component_ranks(spark, d):
    return gr.component_sizes(face_components_by_edge(spark, d), 3)


_COMP = f"{_VOX}, {_NBR}, reach AS (SELECT cell_id, cell_id AS root FROM voxels UNION SELECT n.other, r.root FROM reach r JOIN nbr n ON n.cell_id = r.cell_id WHERE n.label = n.other_label), comp AS (SELECT cell_id, min(root) AS root FROM reach GROUP BY cell_id)"


@query("voxel_components", f"{_COMP} SELECT cell_id, root FROM comp")
def voxel_components(spark, d):
    return vx.cell_components(b.voxels(spark, d))


def _cleanup_sql(least: int, passes: int = 5) -> str:
    """Each pass in CTEs of its own: components by reach, small ones, modes of neighbours."""
    parts = [f"WITH RECURSIVE {b.VOXELS_SQL}", "near AS MATERIALIZED (SELECT c.cell_id, o.cell_id AS other FROM voxels c JOIN voxels o ON abs(c.ix-o.ix)+abs(c.iy-o.iy)+abs(c.iz-o.iz) = 1)",
             "v0 AS (SELECT cell_id, label FROM voxels)"]
    for p in range(passes):
        parts += [
            f"n{p} AS MATERIALIZED (SELECT n.cell_id, n.other, c.label, o.label AS other_label FROM near n JOIN v{p} c USING (cell_id) JOIN v{p} o ON o.cell_id = n.other)",
            f"reach{p} AS (SELECT cell_id, cell_id AS root FROM v{p} UNION SELECT n.other, r.root FROM reach{p} r JOIN n{p} n ON n.cell_id = r.cell_id WHERE n.label = n.other_label)",
            f"small{p} AS (SELECT cell_id FROM reach{p} GROUP BY cell_id HAVING count(*) < {least})",
            f"mode{p} AS (SELECT cell_id, arg_max(other_label, n*100-other_label) AS mode FROM (SELECT cell_id, other_label, count(*) AS n FROM n{p} SEMI JOIN small{p} USING (cell_id) GROUP BY 1, 2) GROUP BY cell_id)",
            f"v{p + 1} AS MATERIALIZED (SELECT cell_id, coalesce(mode, label) AS label FROM v{p} LEFT JOIN mode{p} USING (cell_id))",
        ]
    return ",\n ".join(parts) + f" SELECT cell_id, ix, iy, iz, c.label, density, susceptibility FROM voxels JOIN v{passes} c USING (cell_id)"


@query("voxel_cleanup", _cleanup_sql(4))
def voxel_cleanup(spark, d):
    return vx.clean_fragments(b.voxels(spark, d), 4)


@query("voxel_neighbours", f"{_VOX}, {_NBR} SELECT cell_id, label, other, other_label FROM nbr")
def voxel_neighbours(spark, d):
    return vx.neighbours(b.voxels(spark, d))


@query("neighbor_mode", f"{_VOX}, {_NBR}, n AS (SELECT cell_id, other_label, count(*) AS n FROM nbr GROUP BY 1, 2) SELECT cell_id, arg_max(other_label, n*100-other_label) AS mode FROM n GROUP BY cell_id")
def neighbor_mode(spark, d):
    return vx.neighbour_mode(b.voxels(spark, d))


@query("label_changes", f"{_VOX}, {_NBR}, ax AS (SELECT c.label, o.label AS l2, CASE WHEN c.ix <> o.ix THEN 'x' WHEN c.iy <> o.iy THEN 'y' ELSE 'z' END AS axis FROM voxels c JOIN voxels o ON abs(c.ix-o.ix)+abs(c.iy-o.iy)+abs(c.iz-o.iz) = 1 AND c.cell_id < o.cell_id) SELECT axis, count(*) AS n FROM ax WHERE label <> l2 GROUP BY axis")
def label_changes(spark, d):
    return vx.label_changes(b.voxels(spark, d))


_OPEN = f"{_VOX}, {_NBR}, inner_same AS (SELECT cell_id, count(*) AS k FROM nbr WHERE label = other_label GROUP BY 1)"


@query("voxel_faces", f"{_OPEN} SELECT label, sum(6 - coalesce(k, 0))::BIGINT AS n_faces FROM voxels LEFT JOIN inner_same USING (cell_id) GROUP BY label")
def voxel_faces(spark, d):
    return vx.faces(b.voxels(spark, d)).groupBy("label").agg(F.count("*").alias("n_faces"))


@query("voxel_face_volume", f"{_VOX} SELECT label, count(*)::DOUBLE AS volume FROM voxels GROUP BY label")
def voxel_face_volume(spark, d):
    return fw.mesh_volume(vx.face_triangles(vx.faces(b.voxels(spark, d))), ["label"]).select("label", F.round("volume", 6).alias("volume"))


@query("voxel_face_nodes", f"{_VOX}, c AS (SELECT DISTINCT label, ix+a AS i, iy+b AS j, iz+c AS k FROM voxels, (VALUES (0),(1)) x(a), (VALUES (0),(1)) y(b), (VALUES (0),(1)) z(c)), "
       "full_in AS (SELECT c.label, i, j, k FROM c JOIN voxels v ON v.label = c.label AND v.ix BETWEEN i-1 AND i AND v.iy BETWEEN j-1 AND j AND v.iz BETWEEN k-1 AND k GROUP BY ALL HAVING count(*) = 8) SELECT c.label, c.i, c.j, c.k FROM c ANTI JOIN full_in f ON f.label = c.label AND f.i = c.i AND f.j = c.j AND f.k = c.k")  # fmt: skip
def voxel_face_nodes(spark, d):
    return vx.face_nodes(vx.faces(b.voxels(spark, d)))


@query("contact_nodes", f"{_VOX}, nodes AS (SELECT DISTINCT ix+a AS i, iy+b AS j, iz+c AS k FROM voxels, (VALUES (0),(1)) x(a), (VALUES (0),(1)) y(b), (VALUES (0),(1)) z(c) WHERE label = 2), "
       "met AS (SELECT i, j, k, v.label FROM nodes JOIN voxels v ON v.ix BETWEEN i-1 AND i AND v.iy BETWEEN j-1 AND j AND v.iz BETWEEN k-1 AND k) SELECT i, j, k FROM met GROUP BY ALL HAVING bool_or(label = 1)")  # fmt: skip
def contact_nodes(spark, d):
    return vx.contact_nodes(b.voxels(spark, d), 1, 2)


@query("voxel_world_mapping", "SELECT p_partkey AS idx, (p_partkey % 7)::INT AS ix, ((p_partkey // 7) % 5)::INT AS iy, (p_partkey // 35)::INT AS iz, 100+((p_partkey % 7)+0.5)*200.0 AS x, -50+(((p_partkey // 7) % 5)+0.5)*100.0 AS y, 25-((p_partkey // 35)+0.5)*50.0 AS z FROM part")
def voxel_world_mapping(spark, d):
    cells = vx.from_flat(b.read(spark, d, "part").select(F.col("p_partkey").alias("idx")), 7, 5)
    return vx.centres(cells, (100.0, -50.0, 25.0), (200.0, 100.0, 50.0))


@query("world_voxel_mapping", f"WITH {b.OBS_SQL} SELECT obs_id, floor((x-150.0)/300.0)::INT AS ix, floor((y-70.0)/250.0)::INT AS iy, floor((10.0-value)/4.0)::INT AS iz FROM obs")
def world_voxel_mapping(spark, d):
    pts = b.obs(spark, d).withColumn("z", F.col("value"))
    return vx.to_index(pts, (150.0, 70.0, 10.0), (300.0, 250.0, 4.0)).select("obs_id", "ix", "iy", "iz")


@query("padding_mask", "SELECT c_custkey AS v_id, (c_custkey % 40 < 2 OR c_custkey % 40 >= 38 OR c_custkey // 40 < 2) AS padding FROM customer")
def padding_mask(spark, d):
    col, row = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    return b.read(spark, d, "customer").select(F.col("c_custkey").alias("v_id"), ((col < 2) | (col >= 38) | (row < 2)).alias("padding"))


@query("control_point_mask", "SELECT c_custkey AS v_id FROM customer WHERE (c_custkey % 40 % 4 = 0 OR c_custkey % 40 = 39) AND c_custkey // 40 % 4 = 0")
def control_point_mask(spark, d):
    col, row = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    return b.read(spark, d, "customer").filter(((col % 4 == 0) | (col == 39)) & (row % 4 == 0)).select(F.col("c_custkey").alias("v_id"))


_SITES = "sites AS (SELECT s_suppkey AS target_id, (s_suppkey*37 % 4000)::DOUBLE AS x, (s_suppkey*91 % 3000)::DOUBLE AS y, -s_acctbal/10.0 AS z FROM supplier)"


def _sites(spark, d):
    k = F.col("s_suppkey")
    return b.read(spark, d, "supplier").select(k.alias("target_id"), (k * 37 % 4000).cast("double").alias("x"), (k * 91 % 3000).cast("double").alias("y"), (-F.col("s_acctbal") / 10.0).alias("z"))


_NEAR = "near AS (SELECT obs_id, target_id, pow(o.x-s.x,2)+pow(o.y-s.y,2) AS d2, row_number() OVER (PARTITION BY obs_id ORDER BY pow(o.x-s.x,2)+pow(o.y-s.y,2), target_id) AS rank FROM obs o, sites s)"


@query("nearest_xy", f"WITH {b.OBS_SQL}, {_SITES}, {_NEAR} SELECT obs_id, target_id, d2 FROM near WHERE rank = 1")
def nearest_xy(spark, d):
    return lo.nearest(b.obs(spark, d), _sites(spark, d), 1, "xy").select("obs_id", "target_id", "d2")


@query("knn_weights", f"WITH {b.OBS_SQL}, {_SITES}, {_NEAR}, w AS (SELECT *, 1.0/greatest(sqrt(d2), 1e-12) AS r FROM near WHERE rank <= 4) SELECT obs_id, target_id, round(r/sum(r) OVER (PARTITION BY obs_id), 9) AS w FROM w")
def knn_weights(spark, d):
    return lo.idw_weights(lo.nearest(b.obs(spark, d), _sites(spark, d), 4, "xy")).select("obs_id", "target_id", F.round("w", 9).alias("w"))


@query("control_point_interpolation", f"WITH {b.OBS_SQL}, {_SITES}, {_NEAR}, w AS (SELECT *, 1.0/greatest(sqrt(d2), 1e-12) AS r FROM near WHERE rank <= 4) SELECT obs_id, round(sum(r*z)/sum(r), 6) AS z FROM w JOIN sites USING (target_id) GROUP BY obs_id")
def control_point_interpolation(spark, d):
    sites = _sites(spark, d)
    w = lo.idw_weights(lo.nearest(b.obs(spark, d), sites, 4, "xy"))
    return w.join(sites.select("target_id", "z"), "target_id").groupBy("obs_id").agg(F.round(F.sum(F.col("w") * F.col("z")), 6).alias("z"))


@query("control_point_gradient", f"WITH {b.OBS_SQL}, {_SITES}, {_NEAR}, w AS (SELECT *, 1.0/greatest(sqrt(d2), 1e-12) AS r FROM near WHERE rank <= 4), n AS (SELECT obs_id, target_id, r/sum(r) OVER (PARTITION BY obs_id) AS w FROM w) SELECT target_id, round(sum(w*value), 6) AS g FROM n JOIN obs USING (obs_id) GROUP BY target_id")
def control_point_gradient(spark, d):
    pts = b.obs(spark, d)
    w = lo.idw_weights(lo.nearest(pts, _sites(spark, d), 4, "xy"))
    return w.join(pts.select("obs_id", "value"), "obs_id").groupBy("target_id").agg(F.round(F.sum(F.col("w") * F.col("value")), 6).alias("g"))


@query("idw_grid", f"WITH {b.OBS_SQL}, {_SITES} SELECT obs_id, round(sum(s.z/greatest(pow(o.x-s.x,2)+pow(o.y-s.y,2),1.0))/sum(1.0/greatest(pow(o.x-s.x,2)+pow(o.y-s.y,2),1.0)), 6) AS z FROM obs o, sites s GROUP BY obs_id")
def idw_grid(spark, d):
    samples = _sites(spark, d).select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    return lo.idw(b.obs(spark, d), samples).select("obs_id", F.round("z", 6).alias("z"))


_BIL = """pts AS (SELECT s_suppkey AS obs_id, s_suppkey*137.5 % 4200 - 100 AS x, s_suppkey*53.25 % 400 - 50 AS y FROM supplier),
 nodes AS (SELECT (v_id % 40)::INT AS ix, (v_id // 40)::INT AS iy, z FROM vertices),
 c AS (SELECT obs_id, greatest(0, least(38, floor(x/100))) AS cx, greatest(0, least((SELECT count(*)//40 FROM vertices)-2, floor(y/100))) AS cy, x, y FROM pts),
 t AS (SELECT obs_id, cx, cy, x/100-cx AS tx, y/100-cy AS ty FROM c)"""


@query("bilinear_dem", f"WITH {b.VERTICES_SQL}, {_BIL} SELECT obs_id, round((1-tx)*(1-ty)*a.z+tx*(1-ty)*bb.z+(1-tx)*ty*cc.z+tx*ty*dd.z, 6) AS z FROM t JOIN nodes a ON a.ix = cx AND a.iy = cy JOIN nodes bb ON bb.ix = cx+1 AND bb.iy = cy JOIN nodes cc ON cc.ix = cx AND cc.iy = cy+1 JOIN nodes dd ON dd.ix = cx+1 AND dd.iy = cy+1")
def bilinear_dem(spark, d):
    k = F.col("s_suppkey")
    pts = b.read(spark, d, "supplier").select(k.alias("obs_id"), (k * 137.5 % 4200 - 100).alias("x"), (k * 53.25 % 400 - 50).alias("y"))
    nodes = b.vertices(spark, d).select((F.col("v_id") % 40).alias("ix"), F.floor(F.col("v_id") / 40).alias("iy"), "z")
    return lo.bilinear(pts, nodes, 100.0, 40, nodes.count() // 40).select("obs_id", F.round("z", 6).alias("z"))


_PTS = "pts AS (SELECT o_orderkey AS obs_id, (o_orderkey*13 % 5000)::DOUBLE AS x, (o_orderkey*7 % 1400)::DOUBLE AS y, -(o_orderkey*3 % 600)::DOUBLE AS z FROM orders)"


def _pts(spark, d):
    k = F.col("o_orderkey")
    return b.read(spark, d, "orders").select(k.alias("obs_id"), (k * 13 % 5000).cast("double").alias("x"), (k * 7 % 1400).cast("double").alias("y"), (-(k * 3 % 600)).cast("double").alias("z"))


@query("point_in_box_raycast", f"WITH {_PTS}, {b.BOXES_SQL} SELECT obs_id, CASE WHEN z < -345 THEN -1 ELSE coalesce(min(group_id), -1) END AS group_id FROM pts LEFT JOIN boxes ON abs(x-0.0-cx) <= 50 AND x < cx+50 AND x >= cx-50 AND y+1.234567e-6 BETWEEN cy-50 AND cy+50 AND z+2.345678e-6 BETWEEN cz-50 AND cz+50 GROUP BY obs_id, z")
def point_in_box_raycast(spark, d):
    return lo.classify(_pts(spark, d), fw.box_facets(b.boxes(spark, d)), bottom=-345.0)


@query("surface_height", f"{_MESH}, pts AS (SELECT s_suppkey AS obs_id, ((s_suppkey*613 % 3800)+37.3)::DOUBLE AS x, ((s_suppkey*29 % 200)+11.7)::DOUBLE AS y FROM supplier), c AS (SELECT obs_id, x, y, floor(x/100)::BIGINT + 40*floor(y/100)::BIGINT AS v, x/100-floor(x/100) AS u, y/100-floor(y/100) AS w FROM pts)"
       " SELECT obs_id, round(CASE WHEN u >= w THEN a.z+u*(bb.z-a.z)+w*(dd.z-bb.z) ELSE a.z+u*(dd.z-cc.z)+w*(cc.z-a.z) END, 4) AS z FROM c JOIN vertices a ON a.v_id = v JOIN vertices bb ON bb.v_id = v+1 JOIN vertices cc ON cc.v_id = v+40 JOIN vertices dd ON dd.v_id = v+41")  # fmt: skip
def surface_height(spark, d):
    k = F.col("s_suppkey")
    pts = b.read(spark, d, "supplier").select(k.alias("obs_id"), ((k * 613 % 3800) + 37.3).alias("x"), ((k * 29 % 200) + 11.7).alias("y"))
    v, t, _ = _mesh(spark, d)
    facets = fw.mesh_facets(v.drop("freedom"), t)
    return lo.surface_z(pts, facets).select("obs_id", F.round("z", 4).alias("z"))


@query("groups_in_volume", f"WITH {_PTS}, {b.BOXES_SQL} SELECT group_id FROM boxes WHERE EXISTS (SELECT 1 FROM pts WHERE abs(x-cx) <= 50 AND abs(y-cy) <= 50 AND abs(z-cz) <= 50)")
def groups_in_volume(spark, d):
    boxes = b.boxes(spark, d).select("group_id", *[(F.col(f"c{a}") - 50).alias(f"lo_{a}") for a in "xyz"], *[(F.col(f"c{a}") + 50).alias(f"hi_{a}") for a in "xyz"])
    return lo.inside_any(_pts(spark, d), boxes).select("group_id")


@query("best_per_cell", f"WITH {b.POINTS_SQL}, c AS (SELECT *, floor(x/0.1) AS i, floor(y/0.1) AS j, floor(z/0.1) AS k FROM points) SELECT i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k, arg_min(p_id, struct_pack(a := round(pow(x-(i+0.5)*0.1,2)+pow(y-(j+0.5)*0.1,2)+pow(z-(k+0.5)*0.1,2), 12), b := p_id)) AS p_id FROM c GROUP BY ALL")
def best_per_cell(spark, d):
    cells = b.points(spark, d).withColumns({n: F.floor(F.col(c) / 0.1) for n, c in zip("ijk", "xyz", strict=True)})
    d2 = F.round(sum((F.pow(F.col(c) - (F.col(n) + 0.5) * 0.1, 2) for n, c in zip("ijk", "xyz", strict=True)), F.lit(0.0)), 12)
    return cells.groupBy("i", "j", "k").agg(F.min_by("p_id", F.struct(d2, F.col("p_id"))).alias("p_id"))


@query("cell_size_from_points", f"WITH {b.VERTICES_SQL}, f AS (SELECT DISTINCT x, y FROM vertices ORDER BY x, y LIMIT 300) SELECT min(CASE WHEN abs(a.x-c.x) > 1e-9 THEN abs(a.x-c.x) END) AS dx, min(CASE WHEN abs(a.y-c.y) > 1e-9 THEN abs(a.y-c.y) END) AS dy FROM f a, f c")
def cell_size_from_points(spark, d):
    from pyspark.sql import Window

    first = b.vertices(spark, d).select("x", "y").distinct().orderBy("x", "y").limit(300)
    gap = lambda c: first.select(c).distinct().select((F.col(c) - F.lag(c).over(Window.orderBy(c))).alias("g")).agg(F.min("g").alias(f"d{c}"))
    return gap("x").crossJoin(gap("y"))


def _farthest_sql(k: int) -> str:
    """One CTE a chosen point: the farthest by the least distance to all chosen before it."""
    square = "+".join(f"(p.{a}-c.{a})*(p.{a}-c.{a})" for a in "xyz")
    parts = [f"WITH {b.POINTS_SQL}", "c0 AS MATERIALIZED (SELECT p_id, x, y, z FROM points ORDER BY p_id LIMIT 1)", f"d0 AS MATERIALIZED (SELECT p.p_id, p.x, p.y, p.z, {square} AS d FROM points p, c0 c)"]
    for i in range(1, k):
        parts.append(f"c{i} AS MATERIALIZED (SELECT p_id, x, y, z FROM d{i - 1} ORDER BY d DESC NULLS LAST, p_id LIMIT 1)")
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.p_id, p.x, p.y, p.z, least(p.d, {square}) AS d FROM d{i - 1} p, c{i} c)")
    return ",\n ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS ord, p_id FROM c{i}" for i in range(k))


@query("farthest_points", _farthest_sql(12))
def farthest_points(spark, d):
    from terralith.operators.sampling import farthest_points as fps

    return fps(b.points(spark, d), 12)
