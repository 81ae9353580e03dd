"""Closed surfaces around sets of voxels, by tetrahedra instead of a case table for cubes.

Cell centres are the nodes of a lattice; every cube of eight nodes is cut into the six
tetrahedra along its main diagonal, which fit together from cube to cube. A tetrahedron with one
node on either side gives a triangle, one with two and two gives two, with corners half way
between nodes on different sides. All groups are one job: cells are dealt to blocks of cubes,
mixed cubes look their triangles up by corner mask.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.storage import stored

#: Corners of a cube: bits of the number are the steps along x, y and z.
_CORNERS = [tuple(c >> k & 1 for k in range(3)) for c in range(8)]


@cache
def triangles_by_mask() -> list[tuple[int, ...]]:
    """(mask, number, a0, b0, a1, b1, a2, b2): triangles of a cube whose inside corners are the mask.

    Each corner of a triangle lies between the cube's corners a and b; normals point outwards.
    """
    paths = [[0, 1 << p[0], (1 << p[0]) | (1 << p[1]), 7] for p in permutations(range(3))]
    at = np.array(_CORNERS, float)
    rows = []
    for mask in range(1, 255):
        number = 0
        for tet in paths:
            inner, outer = [c for c in tet if mask >> c & 1], [c for c in tet if not mask >> c & 1]
            if not inner or not outer:
                continue
            edges = [(i, o) for i in inner for o in outer]
            faces = [edges] if len(edges) == 3 else [[edges[0], edges[1], edges[3]], [edges[0], edges[3], edges[2]]]
            out = at[outer].mean(0) - at[inner].mean(0)
            for face in faces:
                p = [(at[a] + at[b]) / 2 for a, b in face]
                if np.cross(p[1] - p[0], p[2] - p[0]) @ out < 0:
                    face = [face[0], face[2], face[1]]
                rows.append((mask, number, *[int(c) for edge in face for c in edge]))
                number += 1
    return rows


def closing(cells: DataFrame, shape: tuple[int, int, int], by: str = "label") -> DataFrame:
    """(by, ix, iy, iz): each group's cells after a dilation and an erosion with a 3 x 3 x 3 cube.

    Nothing lies outside the grid of ``shape``: the dilation ends at its border and the erosion
    takes the cells on it.
    """
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((a, b, c), ("a", "b", "c"), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = lambda rows: rows.select(by, "ix", "iy", "iz", steps.alias("s")).select(by, *[(F.col(n) + F.col(f"s.{s}")).alias(n) for n, s in zip(("ix", "iy", "iz"), "abc", strict=True)])
    inside = F.lit(True)
    for n, size in zip(("ix", "iy", "iz"), shape, strict=True):
        inside = inside & F.col(n).between(0, size - 1)
    wide = spread(cells).filter(inside).distinct()
    # a cell stays if all 27 cells around it are there, each of which says so once
    return spread(wide).filter(inside).groupBy(by, "ix", "iy", "iz").agg(F.count("*").alias("n")).filter("n = 27").drop("n")


#: Cubes of a block along x, y and z.
BLOCK = (16, 16, 64)
#: Blocks of a task: what it holds does not grow with the table.
_TASK_BLOCKS = 8


def _corners_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(there, mixed): the vertices of a block by twice their local place, and its cubes' masks where they are mixed, else 0."""
    inside = np.zeros([n + 1 for n in BLOCK], bool)
    inside.reshape(-1)[cells] = True
    there = np.zeros([2 * n + 1 for n in BLOCK], bool)
    mask = np.zeros(BLOCK, np.int32)
    for i, step in enumerate(_CORNERS):
        mask |= inside[tuple(slice(s, s + n) for s, n in zip(step, BLOCK, strict=True))].astype(np.int32) << i
        if i:
            low, high = inside[tuple(slice(0, n + 1 - s) for s, n in zip(step, BLOCK, strict=True))], inside[tuple(slice(s, n + 1) for s, n in zip(step, BLOCK, strict=True))]
            there[tuple(slice(s, 2 * n + 1 - s, 2) for s, n in zip(step, BLOCK, strict=True))] = low != high
    return there, np.where(mask == 255, 0, mask)


@cache
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles of each mask, its first row, twice the place of the three corners of each row within the cube)."""
    rows = np.array(triangles_by_mask())
    n = np.bincount(rows[:, 0], minlength=256)
    at = np.array(_CORNERS)
    return n, np.cumsum(n) - n, np.stack([at[rows[:, 2 + 2 * i]] + at[rows[:, 3 + 2 * i]] for i in range(3)], axis=1)


def surfaces(cells: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), size: tuple[float, float, float] = (1.0, 1.0, 1.0), by: str = "label") -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the closed surfaces around each group's cells.

    cells: by, ix, iy, iz (iz counts down from the origin's z). vertices(by, v_id, x, y, z) and
    triangles(by, t_id, v0, v1, v2), numbered over all groups in the order of group and place;
    normals point outwards. Repeated cells count once, cells without a place not at all.

    Cells are dealt to blocks of cubes with the cells on their far sides. A block counts the vertices
    and triangles of each of its columns; running sums of the counts give every column its first
    number, so blocks number what they hold themselves and no vertex or triangle is shuffled.
    """
    spark = cells.sparkSession
    axes, home = ("ix", "iy", "iz"), ["bx", "by", "bz"]
    placed = cells.select(F.col(by).alias("g"), *[F.col(c).cast("int").alias(c) for c in axes]).na.drop(subset=list(axes))
    for c, h, n in zip(axes, home, BLOCK, strict=True):
        placed = placed.withColumn(h, F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) - s) / n).cast("int") for s in (0, 1)]))))
    local = F.lit(0)
    for c, h, n in zip(axes, home, BLOCK, strict=True):
        local = local * (n + 1) + F.col(c) - F.col(h) * n
    few = placed.groupBy("g", *home).agg(F.collect_set(local.cast("int")).alias("cells"))
    blocks = stored(few)
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // _TASK_BLOCKS))
    kind = dict(blocks.dtypes)["g"]

    def count(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                there, mask = _corners_of(r.cells)
                for what, n, k in ((0, there[:-1, :-1, :-1].sum(axis=2), 2), (1, _table()[0][mask].sum(axis=2), 1)):
                    x, y = np.nonzero(n)
                    yield pd.DataFrame({"g": pd.Series([r.g] * len(x), dtype=pdf["g"].dtype), "what": what, "x": x + r.bx * BLOCK[0] * k, "y": y + r.by * BLOCK[1] * k, "bz": r.bz, "n": n[x, y]})

    columns = ["what", "g", "x", "y", "bz"]
    counts = blocks.repartition(tasks).mapInPandas(count, f"g {kind}, what int, x int, y int, bz int, n long")
    ranged = stored(counts.repartitionByRange(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("what", "part").agg(F.sum("n").alias("total"))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = totals.select("what", "part", F.coalesce(F.sum("total").over(Window.partitionBy("what").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = ranged.join(F.broadcast(ahead), ["what", "part"]).select(*columns, (F.col("ahead") + running(Window.partitionBy("what", "part").orderBy(*columns))).alias("start"))
    # a vertex on the side between two blocks is numbered by the second and known to both
    for c, h, n in zip("xy", home, BLOCK, strict=False):
        own = F.when(F.col("what") == 0, F.floor(F.col(c) / (2 * n))).otherwise(F.floor(F.col(c) / n)).cast("int")
        starts = starts.withColumn(h, F.explode(F.when((F.col("what") == 0) & (F.pmod(F.col(c), F.lit(2 * n)) == 0), F.array(own, own - 1)).otherwise(F.array(own))))
    starts = starts.withColumn("up", F.explode(F.when(F.col("what") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("bz", F.col("bz") - F.col("up"))
    wide = F.when(F.col("what") == 0, 2).otherwise(1)
    slot = ((F.col("x") - F.col("bx") * BLOCK[0] * wide) * (2 * BLOCK[1] + 1) + F.col("y") - F.col("by") * BLOCK[1] * wide) * 3 + F.when(F.col("what") == 1, 2).otherwise(F.col("up"))
    packed = starts.groupBy("g", *home).agg(F.collect_list(slot.cast("int")).alias("slots"), F.collect_list("start").alias("starts"))
    same = [blocks["g"].eqNullSafe(packed["g"]), *[blocks[h] == packed[h] for h in home]]
    ready = stored(blocks.join(packed, same).select(blocks["g"], *[blocks[h] for h in home], "cells", "slots", "starts")).repartition(tasks)

    def numbered(r):
        first = np.zeros((2 * BLOCK[0] + 1, 2 * BLOCK[1] + 1, 3), np.int64)
        first.reshape(-1)[r.slots] = r.starts
        there, mask = _corners_of(r.cells)
        ids = np.cumsum(there, axis=2) - there + first[:, :, :1]
        ids[:, :, -1] = first[:, :, 1]
        return there, mask, ids, first[: BLOCK[0], : BLOCK[1], 2]

    def of_group(pdf, r, rows):
        return pd.DataFrame({"g": pd.Series([r.g] * len(next(iter(rows.values()))), dtype=pdf["g"].dtype), **rows})

    def corner_rows(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                there, _, ids, _ = numbered(r)
                k = np.nonzero(there[:-1, :-1, :-1])
                yield of_group(pdf, r, {"v_id": ids[k], **{f"k{a}": i + 2 * n * h for a, i, n, h in zip("xyz", k, BLOCK, (r.bx, r.by, r.bz), strict=True)}})

    def face_rows(batches):
        n, begin, places = _table()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, mask, ids, first = numbered(r)
                at = np.nonzero(mask)
                own = mask[at]
                many = n[own]
                cube = np.repeat(np.arange(len(own)), many)
                row = np.arange(len(cube)) - np.repeat(np.cumsum(many) - many - begin[own], many)
                column = (at[0] * BLOCK[1] + at[1])[cube]
                within = np.bincount(column, minlength=BLOCK[0] * BLOCK[1])
                within = np.arange(len(cube)) - (np.cumsum(within) - within)[column]
                base = np.stack(at, axis=1)[cube] * 2
                # z falls with iz, so the order of the corners turns round
                corner = [ids[tuple((base + places[row, i]).T)] for i in (0, 2, 1)]
                yield of_group(pdf, r, {"t_id": first.reshape(-1)[column] + within, **{f"v{i}": c for i, c in enumerate(corner)}})

    (x0, y0, z0), (dx, dy, dz) = origin, size
    found = ready.mapInPandas(corner_rows, f"g {kind}, v_id long, kx int, ky int, kz int")
    vertices = found.select(F.col("g").alias(by), "v_id", (x0 + (F.col("kx") / 2 + 0.5) * dx).alias("x"), (y0 + (F.col("ky") / 2 + 0.5) * dy).alias("y"), (z0 - (F.col("kz") / 2 + 0.5) * dz).alias("z"))
    triangles = ready.mapInPandas(face_rows, f"g {kind}, t_id long, v0 long, v1 long, v2 long").withColumnRenamed("g", by)
    return vertices, triangles


def open_edges(triangles: DataFrame, by: str = "label") -> DataFrame:
    """(by, n_open_edges): edges that triangles do not meet as often one way as the other; no row for a group without any.

    Opposite edges cancel within a batch of rows first, so only what is left is shuffled.
    """
    kind = dict(triangles.dtypes)[by]

    def cancel(batches):
        for pdf in batches:
            v = pdf[["v0", "v1", "v2"]].to_numpy()
            a, b = v.reshape(-1), np.roll(v, -1, axis=1).reshape(-1)
            edges = pd.DataFrame({by: pdf[by].repeat(3).reset_index(drop=True), "a": np.minimum(a, b), "b": np.maximum(a, b), "way": np.where(a < b, 1, -1)})
            left = edges.groupby([by, "a", "b"], dropna=False, sort=False, as_index=False)["way"].sum()
            yield left[left["way"] != 0]

    left = triangles.select(by, "v0", "v1", "v2").mapInPandas(cancel, f"`{by}` {kind}, a long, b long, way long")
    return left.groupBy(by, "a", "b").agg(F.sum("way").alias("s")).filter("s <> 0").groupBy(by).agg(F.count("*").cast("int").alias("n_open_edges"))


def surface_lines(vertices: DataFrame, triangles: DataFrame, groups: DataFrame, form: str = "obj", by: str = "label") -> DataFrame:
    """(by, part, ord, line) of each group's surface as OBJ or TSurf with its properties ahead.

    groups: by, density, susceptibility. Three places; vertices and triangles are renumbered from
    1 within their group by their order.
    """
    # one row a group, read several times below
    first = stored(vertices.groupBy(by).agg(F.min("v_id").alias("first"), F.count("*").alias("nv")))
    faces = stored(triangles.groupBy(by).agg(F.min("t_id").alias("t_first"), F.count("*").alias("nf")))
    known = groups.join(first, by).join(faces, by)
    mean = [F.format_string("%.6f g/cc", F.col("density").cast("double")), F.format_string("%.6f SI", F.col("susceptibility").cast("double"))]
    if form == "obj":
        head = [F.concat(F.lit("# Lithology group "), F.col(by).cast("string")), F.concat(F.lit("# density_mean="), mean[0], F.lit("  susc_mean="), mean[1]), F.format_string("# vertices=%d faces=%d", "nv", "nf")]
        vertex, face = ("v ", []), "f "
    else:
        head = [F.lit("GOCAD TSurf 1"), F.lit("HEADER {"), F.concat(F.lit("name: litho_group_"), F.col(by).cast("string")), F.concat(F.lit("*density_mean: "), mean[0]), F.concat(F.lit("*susc_mean: "), mean[1]), F.lit("}"), F.lit("TRIANGLES")]
        vertex, face = ("VRTX ", [F.col("ord")]), "TRGL "
    out = known.select(by, F.lit(0).alias("part"), F.posexplode(F.array(*head)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    v = vertices.join(F.broadcast(first), by).withColumn("ord", F.col("v_id") - F.col("first") + 1)
    line = F.concat(F.lit(vertex[0]), F.concat_ws(" ", *[c.cast("string") for c in vertex[1]], F.format_string("%.3f %.3f %.3f", "x", "y", "z")))
    out = out.unionByName(v.select(by, F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line")))
    t = triangles.join(F.broadcast(first), by).join(F.broadcast(faces.select(by, "t_first")), by)
    ids = F.concat_ws(" ", *[(F.col(c) - F.col("first") + 1).cast("string") for c in ("v0", "v1", "v2")])
    out = out.unionByName(t.select(by, F.lit(2).alias("part"), (F.col("t_id") - F.col("t_first") + 1).cast("long").alias("ord"), F.concat(F.lit(face), ids).alias("line")))
    if form != "obj":
        out = out.unionByName(known.select(by, F.lit(3).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("END").alias("line")))
    return out
