"""Triangle meshes as relations: edges, topology, degrees of freedom, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.storage import partitions

#: Axes that a vertex may move along, by freedom class (fixed values).
FREEDOM_AXES = {
    "FIXED": "", "X_ONLY": "x", "Y_ONLY": "y", "Z_ONLY": "z", "XY_FREE": "xy", "XZ_FREE": "xz", "YZ_FREE": "yz", "XYZ_FREE": "xyz", "ALONG_VECTOR": "v",
}


def grid_triangles(nodes: DataFrame, width: int, id_col: str = "v_id") -> DataFrame:
    """Two triangles for each cell of a row-major grid; a cell counts if its far corner exists."""
    far = nodes.select((F.col(id_col) - width - 1).alias("v"))
    near = nodes.select(F.col(id_col).alias("v")).filter(F.col("v") % width < width - 1)
    v = F.col("v")
    both = F.array(
        F.struct((2 * v).alias("t_id"), v.alias("v0"), (v + 1).alias("v1"), (v + width + 1).alias("v2")),
        F.struct((2 * v + 1).alias("t_id"), v.alias("v0"), (v + width + 1).alias("v1"), (v + width).alias("v2")),
    )
    return near.join(far, "v").select(F.explode(both).alias("t")).select("t.*")


def directed_edges(triangles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Three directed edges per triangle: (keys, t_id, a, b)."""
    e = F.array(*[F.struct(F.col(s).alias("a"), F.col(t).alias("b")) for s, t in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return triangles.select(*(keys or []), "t_id", F.explode(e).alias("e")).select(*(keys or []), "t_id", "e.a", "e.b")


def boundary_edges(triangles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges used by one triangle, in that triangle's direction."""
    keys = keys or []
    e = directed_edges(triangles, keys).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    one = e.groupBy(*keys, "lo", "hi").agg(F.count("*").alias("n"), F.min_by(F.struct("a", "b"), "t_id").alias("d"))
    return one.filter("n = 1").select(*keys, "d.a", "d.b")


def undirected_edges(triangles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct neighbour pairs of vertices, both ways.

    Triangles are dealt by their number; an edge is made distinct in one direction and then goes both ways.
    """
    keys = keys or []
    n = partitions(triangles, 3)
    e = directed_edges(triangles.repartition(n, "t_id"), keys).select(*keys, F.when(_swapped(), F.col("b")).otherwise(F.col("a")).alias("lo"), F.when(_swapped(), F.col("a")).otherwise(F.col("b")).alias("hi"))
    both = F.array(*[F.struct(F.col(s).alias("a"), F.col(t).alias("b")) for s, t in (("lo", "hi"), ("hi", "lo"))])
    one = e.repartition(n, *keys, "lo", "hi").distinct()
    return one.select(*keys, F.explode(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.slice(both, 1, 1)).otherwise(both)).alias("e")).select(*keys, "e.a", "e.b")


def _swapped() -> Column:
    """Whether b comes before a, nulls first."""
    return F.coalesce(F.col("b") < F.col("a"), F.col("b").isNull())


def neighbour_means(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per vertex that can move: mean position of its neighbours of the same freedom."""
    me = vertices.select(F.col("v_id").alias("a"), F.col("freedom").alias("fa"))
    other = vertices.select(F.col("v_id").alias("b"), F.col("freedom").alias("fb"), "x", "y", "z")
    same = edges.join(me, "a").join(other, "b").filter("fa = fb and fa <> 'FIXED'")
    return same.groupBy(F.col("a").alias("v_id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.count("*").alias("n_same"))


def laplacian(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Offset of every movable vertex from its neighbours' mean, by axis; 0 along fixed axes."""
    joined = vertices.join(neighbour_means(vertices, edges), "v_id")
    axes = F.create_map(*[x for k, v in FREEDOM_AXES.items() for x in (F.lit(k), F.lit(v))])
    free = lambda c: F.contains(F.element_at(axes, F.col("freedom")), F.lit(c))
    return joined.select("v_id", *[F.when(free(c), F.col(c) - F.col(f"m{c}")).otherwise(0.0).alias(f"d{c}") for c in "xyz"], "n_same", "mx", "my", "mz")


def smoothness_penalty(vertices: DataFrame, edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """Half the weighted sum of squared offsets, one row."""
    d = laplacian(vertices, edges)
    return d.agg(F.sum(0.5 * weight * (F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).alias("penalty"), F.count("*").alias("n_vertices"))


def smoothness_gradient(vertices: DataFrame, edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """Derivative of the penalty by each vertex: its own offset less its neighbours' shares."""
    d = laplacian(vertices, edges).select("v_id", "dx", "dy", "dz", "n_same")
    freedom = vertices.select("v_id", "freedom")
    from_side = d.join(freedom, "v_id").select(F.col("v_id").alias("a"), *[(F.col(f"d{c}") / F.col("n_same")).alias(f"s{c}") for c in "xyz"], F.col("freedom").alias("fa"))
    shares = edges.join(from_side, "a").join(freedom.select(F.col("v_id").alias("b"), F.col("freedom").alias("fb")), "b").filter("fa = fb")
    taken = shares.groupBy(F.col("b").alias("v_id")).agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"])
    return d.join(taken, "v_id", "left").select("v_id", *[(weight * (F.col(f"d{c}") - F.coalesce(F.col(f"s{c}"), F.lit(0.0)))).alias(f"g{c}") for c in "xyz"])


def spikes(vertices: DataFrame, edges: DataFrame, share: float = 0.2) -> DataFrame:
    """Vertices farther from their neighbours' mean than ``share`` of the model's largest side."""
    side = vertices.agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("side"))
    around = edges.join(vertices.select(F.col("v_id").alias("b"), "x", "y", "z"), "b").groupBy(F.col("a").alias("v_id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    off = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return vertices.join(around, "v_id").select("v_id", off.alias("offset")).crossJoin(F.broadcast(side)).filter(F.col("offset") > F.col("side") * share).select("v_id", "offset")


def lattice(c: Column, scale: float = 1e6) -> Column:
    """Integer key of a coordinate."""
    return F.round(c * scale).cast("long")


def shared_vertices(vertices: DataFrame, mesh_col: str = "mesh_id") -> DataFrame:
    """Positions that two or more meshes share: key and number of meshes."""
    keyed = vertices.select(mesh_col, *[lattice(F.col(c)).alias(f"q{c}") for c in "xyz"])
    return keyed.groupBy("qx", "qy", "qz").agg(F.count_distinct(mesh_col).alias("n_meshes"), F.count("*").alias("n_vertices")).filter("n_vertices >= 2")


def shared_vertex_average(vertices: DataFrame) -> DataFrame:
    """Vertices moved to the mean of all vertices on their lattice key."""
    keyed = vertices.withColumns({f"q{c}": lattice(F.col(c), 1e0) for c in "xyz"})
    mean = keyed.groupBy("qx", "qy", "qz").agg(*[F.avg(c).alias(f"a{c}") for c in "xyz"])
    return keyed.join(mean, ["qx", "qy", "qz"]).select("mesh_id", "v_id", *[F.col(f"a{c}").alias(c) for c in "xyz"])


def dof_rows(vertices: DataFrame) -> DataFrame:
    """One row per vertex and axis it may move along."""
    axes = F.create_map(*[x for k, v in FREEDOM_AXES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))])
    return vertices.select("*", F.posexplode(F.element_at(axes, F.col("freedom"))).alias("k", "axis")).drop("k")


def global_dofs(vertices: DataFrame) -> DataFrame:
    """Degrees of freedom shared by coincident vertices: one per lattice position and axis.

    Numbered by first appearance, (mesh, vertex, axis) ascending. The key is the whole tuple, so
    different positions never collide. Numbers come from sorted ranges and their offsets, not
    from a window over all rows.
    """
    d = dof_rows(vertices).select("mesh_id", "v_id", "axis", *[lattice(F.col(c)).alias(f"q{c}") for c in "xyz"])
    firsts = d.groupBy("qx", "qy", "qz", "axis").agg(F.min(F.struct("mesh_id", "v_id", "axis")).alias("first"), F.count("*").alias("n_refs"))
    return dense_number(firsts, ["first"], "dof_id").select("dof_id", F.col("first.mesh_id").alias("mesh_id"), F.col("first.v_id").alias("v_id"), "axis", "n_refs")


def dense_number(rows: DataFrame, by: list[str], name: str, start: int = 0, parts: int = 1) -> DataFrame:
    """Rows numbered in the order of ``by`` (which must be unique), by range partitions.

    A range of rows is numbered in its own task and shifted by the count of the ranges before
    it, so that no task sees all rows. ``parts``: ranges at least.
    """
    n = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    from terralith.operators.storage import stored

    ranged = stored(ranged)
    part = F.shiftright("__m", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = ranged.join(F.broadcast(before), part == F.col("__p"))
    return numbered.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1) + start).drop("__m", "__p", "__before")


def face_keys(facets: DataFrame, scale: float = 1e6) -> DataFrame:
    """Facets with an order-free key of their corners."""
    corner = [F.struct(*[lattice(F.col(f"{c}{a}"), scale).alias(a) for a in "zyx"]) for c in "pqr"]
    return facets.withColumn("face", F.array_sort(F.array(*corner)))


def exterior_votes(facets: DataFrame) -> DataFrame:
    """Per mesh vertex: exterior faces by dominant direction, and whether it touches shared ones.

    ``facets``: mesh_id, t_id, v0..v2 and corner coordinates. A face is exterior if no other
    facet has the same corners.
    """
    from terralith.functions import geometry as g
    from terralith.operators.forward import corners

    keyed = face_keys(facets)
    shared = keyed.groupBy("face").agg(F.count("*").alias("uses"))
    p, q, r = corners()
    n, size = g.normal(p, q, r, 1e-30)
    rows = keyed.join(shared, "face").withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "size": size})
    rows = rows.select("mesh_id", "uses", "nx", "ny", "nz", "size", F.explode(F.array("v0", "v1", "v2")).alias("v_id"))
    outer = (F.col("uses") == 1) & (F.col("size") >= 1e-30)
    ax, ay, az = F.abs("nx"), F.abs("ny"), F.abs("nz")
    flat = (az >= ax) & (az >= ay)
    vote = lambda c: F.count(F.when(outer & c, 1))
    return rows.groupBy("mesh_id", "v_id").agg(
        vote(flat).alias("top_bottom"),
        vote(~flat & (ay >= ax)).alias("north_south"),
        vote(~flat & (ay < ax)).alias("east_west"),
        F.bool_or(F.col("uses") > 1).alias("touches_shared"),
    )


def exterior_freedom(votes: DataFrame, current: str = "XYZ_FREE") -> DataFrame:
    """Freedom class of every vertex from its votes; a vertex without exterior faces keeps its own."""
    t, s, e = (F.col(c) > 0 for c in ("top_bottom", "north_south", "east_west"))
    outer = (
        F.when(t & s & e, "FIXED").when(t & s, "X_ONLY").when(t & e, "Y_ONLY").when(s & e, "Z_ONLY").when(t, "XY_FREE").when(s, "X_ONLY").when(e, "Y_ONLY").otherwise(current)
    )
    lifted = F.when(outer.isin("FIXED", "XY_FREE"), "XYZ_FREE").when(outer == "X_ONLY", "XZ_FREE").when(outer == "Y_ONLY", "YZ_FREE").otherwise(outer)
    return votes.select("mesh_id", "v_id", F.when(F.col("touches_shared") & ~t, lifted).otherwise(outer).alias("freedom"))


def model_bounds(vertices: DataFrame, multiple: float = 1.0) -> DataFrame:
    """Bounding box widened by 1 % of each side (of at least 1) times ``multiple``, one row."""
    sides = {c: F.greatest(F.max(c) - F.min(c), F.lit(1.0)) * (0.01 * multiple) for c in "xyz"}
    return vertices.agg(*[(F.min(c) - sides[c]).alias(f"{c}_lo") for c in "xyz"], *[(F.max(c) + sides[c]).alias(f"{c}_hi") for c in "xyz"])


def decimate(vertices: DataFrame, triangles: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Vertices merged in an n x n x n grid over their box; triangles remapped, degenerate ones gone.

    Vertex ids of the result are bin numbers.
    """
    box = vertices.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"])
    cell = lambda c: F.least(F.lit(n - 1), F.floor((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12)) * n))
    binned = vertices.crossJoin(F.broadcast(box)).select("v_id", "x", "y", "z", (cell("x") * n * n + cell("y") * n + cell("z")).cast("long").alias("bin"))
    means = binned.groupBy("bin").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n_merged"))
    out = triangles
    for i in range(3):
        out = out.join(binned.select(F.col("v_id").alias(f"v{i}"), F.col("bin").alias(f"b{i}")), f"v{i}")
    faces = out.filter("b0 <> b1 and b1 <> b2 and b0 <> b2").select("t_id", F.col("b0").alias("v0"), F.col("b1").alias("v1"), F.col("b2").alias("v2"))
    return means, faces


def closed_between(top: DataFrame, bottom_z: float, triangles: DataFrame, offset: int) -> DataFrame:
    """Closed mesh from a surface, its flat copy below (ids + offset) and side walls."""
    down = triangles.select(F.col("t_id").alias("t"), (F.col("v0") + offset).alias("v0"), (F.col("v2") + offset).alias("v1"), (F.col("v1") + offset).alias("v2"))
    a, b = F.col("a"), F.col("b")
    quad = F.array(F.struct(b.alias("v0"), a.alias("v1"), (a + offset).alias("v2")), F.struct(b.alias("v0"), (a + offset).alias("v1"), (b + offset).alias("v2")))
    walls = boundary_edges(triangles).select(F.explode(quad).alias("q")).select("q.*")
    return triangles.select("v0", "v1", "v2").unionByName(down.select("v0", "v1", "v2")).unionByName(walls)
