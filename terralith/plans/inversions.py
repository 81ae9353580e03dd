"""Queries on whole inversions: meshed models and voxel models recovered from data of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import forward as fw
from terralith.operators import inversion as inv
from terralith.operators import runs
from terralith.operators.storage import stored
from terralith.plans import bindings as b
from terralith.plans.registry import query

#: Spacing of the tiles and depth of the flat bottom of the meshed model.
_TILE, _BOTTOM = 400.0, -300.0


def _tiles(spark, d, disturbed: bool):
    """(vertices, triangles) of five closed bodies of five tiles each, one tile a nation.

    Neighbouring bodies share vertices; tops may move up and down, bottoms are held. The
    disturbed model has its tops moved by up to 15 m.
    """
    n = F.col("n_nationkey")
    tiles = b.read(spark, d, "nation").select((n % 5).cast("int").alias("mesh_id"), (n % 5).alias("i"), F.floor(n / 5).alias("j"))
    rows = []
    for t, corners in enumerate(fw.BOX_TRIANGLES):
        ids = [((F.col("i") + (sx + 1) // 2) * 100 + (F.col("j") + (sy + 1) // 2) * 10 + (sz + 1) // 2).cast("long").alias(f"v{k}") for k, (sx, sy, sz) in enumerate(corners)]
        rows.append(F.struct(F.lit(t).alias("t"), *ids))
    # walls between tiles of one body are left out
    inner = (F.col("f.t").isin(4, 5) & (F.col("j") > 0)) | (F.col("f.t").isin(6, 7) & (F.col("j") < 4))
    faces = tiles.select("mesh_id", "j", F.explode(F.array(*rows)).alias("f")).filter(~inner)
    triangles = faces.select("mesh_id", (F.col("j") * 12 + F.col("f.t")).cast("long").alias("t_id"), "f.v0", "f.v1", "f.v2")
    ids = triangles.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v_id")).distinct()
    i, j, top = F.floor(F.col("v_id") / 100), F.floor(F.col("v_id") / 10) % 10, F.col("v_id") % 10 == 1
    depth = -(60.0 + 10.0 * ((7 * i + 3 * j) % 5)) + (15.0 * F.sin(3.0 * i + 5.0 * j + 1.0) if disturbed else 0.0)
    vertices = ids.select(
        "mesh_id", "v_id", ((i - 2.5) * _TILE).alias("x"), ((j - 2.5) * _TILE).alias("y"),
        F.when(top, depth).otherwise(_BOTTOM).alias("z"), F.when(top, "Z_ONLY").otherwise("FIXED").alias("freedom"),
    )
    return vertices, triangles


def _density(group):
    return 0.2 + 0.1 * group


def _tile_data(spark, d):
    """Gravity of the true tiles at 12 x 12 places, measured once by every customer with an error of up to 0.002 mGal."""
    vertices, triangles = _tiles(spark, d, False)
    facets = fw.mesh_facets(vertices.select("mesh_id", "v_id", "x", "y", "z"), triangles, ["mesh_id"]).withColumn("density", _density(F.col("mesh_id")))
    k = F.col("c_custkey")
    visits = b.read(spark, d, "customer").select((k % 144).alias("obs_id"), (F.col("c_acctbal").cast("decimal(20,2)") % 2).cast("double").alias("e"))
    places = visits.groupBy("obs_id").agg((F.avg("e") * 0.001).alias("error"))
    places = places.select("obs_id", ((F.col("obs_id") % 12 - 5.5) * _TILE / 2).alias("x"), ((F.floor(F.col("obs_id") / 12) - 5.5) * _TILE / 2).alias("y"), F.lit(0.0).alias("z"), "error")
    field = fw.gravity(places, facets)
    return places.join(field, "obs_id").select("obs_id", "x", "y", "z", (F.col("response") + F.col("error")).alias("value"), F.lit(0.01).alias("std"))


@query("mesh_inversion", "WITH t AS (SELECT n_nationkey % 5 AS mesh_id, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation), v AS (SELECT DISTINCT mesh_id, (i+a.x)*100+(j+b.x)*10+1 AS v_id, i+a.x AS ci, j+b.x AS cj FROM t, (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x))"
       " SELECT mesh_id::INT AS mesh_id, v_id::BIGINT AS v_id, -(60.0+10.0*((7*ci+3*cj) % 5)) AS z, round(0.2+0.1*mesh_id, 2) AS density FROM v")
def mesh_inversion(spark, d):
    """Tops and densities of five bodies that share vertices, recovered from noisy gravity.

    Starts with tops up to 15 m off and equal densities; depths come back to the nearest ten
    metres and densities to two places. Every geometry phase passes the six checks of the gate.
    """
    vertices, triangles = _tiles(spark, d, True)
    done = runs.invert_mesh(stored(vertices), stored(triangles), stored(_tile_data(spark, d)), dict.fromkeys(range(5), 0.4), 0.0, 1.0, 50.0, most=30, interval=10)
    density = spark.createDataFrame([(g, round(v, 2) + 0.0) for g, v in done.density.items()], "mesh_id int, density double")
    found = done.field.vertices(stored(vertices), done.parameters).filter("freedom = 'Z_ONLY'").select("mesh_id", "v_id", F.round("z", -1).alias("z"))
    return found.join(F.broadcast(density), "mesh_id")


def _cells(spark, d):
    """Cells (j, prism) from parts on a 10 x 10 grid, top down; every seventh size is a body of 0.3 g/cc."""
    v = b.voxels(spark, d).join(b.read(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), "p_size"), "cell_id")
    place = [((F.col("ix") - 4.5) * 200.0).alias("cx"), ((F.col("iy") - 4.5) * 200.0).alias("cy"), (-100.0 - F.col("iz") * 100.0).alias("cz")]
    return v.select(F.col("cell_id").alias("j"), *place, *[F.lit(x).alias(f"h{a}") for a, x in zip("xyz", (100.0, 100.0, 50.0), strict=True)], F.when(F.col("p_size") % 7 == 0, 0.3).otherwise(0.0).alias("truth"))


#: Error of a measurement in the voxel inversion, in mGal.
_ERROR = 0.2


@query("voxel_inversion", "SELECT (SELECT count(*) FROM part) AS n_cells, (SELECT count(*) FROM customer) AS n_data, true AS within_bounds, true AS fits_to_the_noise")
def voxel_inversion(spark, d):
    """Density contrasts of cells from noisy gravity: matrix-free, sparse and bounded.

    Cells are the parts, stations the customers; the data are the true cells' field with an
    error of 0.2 mGal from the customers' balances. The result is judged by its misfit.
    """
    import numpy as np

    cells = stored(_cells(spark, d))
    k = F.col("c_custkey")
    stations = stored(b.read(spark, d, "customer").select(k.alias("i"), ((k % 40 - 19.5) * 60.0).alias("x"), ((F.floor(k / 40) % 40 - 19.5) * 60.0).alias("y"), F.lit(0.0).alias("z"), ((F.col("c_acctbal") * 100) % 101 / 50.0 - 1.0).alias("e")))
    matrix = inv.Sensitivity(stations, cells, inv.prism_gravity, ["x", "y", "z"], ["cx", "cy", "cz", "hx", "hy", "hz"])
    rows = cells.select("j", "cz", "truth").orderBy("j").toPandas()
    # errors of mean 0 and standard deviation 0.2, by their own spread
    e = stations.select("i", "e").orderBy("i").toPandas()["e"].to_numpy()
    data = matrix.dot(rows["truth"].to_numpy()) + _ERROR * (e - e.mean()) / e.std()
    weight = (-rows["cz"].to_numpy() / 100.0) ** -1.0
    m, log = inv.sparse_inversion(matrix.dot, matrix.back, data, np.full(len(data), _ERROR), weight, 0.0, 0.5, norm=1.0, rounds=8, inner=8, cooling=10.0)
    matrix.release()
    done = spark.createDataFrame([(bool((m >= 0).all() and (m <= 0.5).all()), bool(log[-1]["chi2"] <= 1.1))], "within_bounds boolean, fits_to_the_noise boolean")
    return cells.agg(F.count("*").alias("n_cells")).crossJoin(stations.agg(F.count("*").alias("n_data"))).crossJoin(done)
