"""Whole-model steps: validation, remanence set-up, loops, layer order, mesh splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators import graph, mesh


def validate(start: DataFrame, now: DataFrame, edges: DataFrame, gap: float = 0.1, spike_share: float = 0.2, margin: float = 0.01) -> DataFrame:
    """(check, passed, worst) of a moved model against its starting vertices.

    start/now: mesh_id, v_id, x, y, z; edges(mesh_id, a, b). Checks: vertices that shared a
    place in the start still do (worst gap), all lie in the start's widened box (worst excess),
    and none is a spike (largest offset from the neighbours' mean over its limit).
    """
    key = [mesh.lattice(F.col(c)).alias(f"q{c}") for c in "xyz"]
    moved = start.select("mesh_id", "v_id", *key).join(now, ["mesh_id", "v_id"])
    spread = moved.groupBy("qx", "qy", "qz").agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("g"))
    gaps = spread.agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("worst")).select(F.lit("shared_gap").alias("check"), (F.col("worst") <= gap).alias("passed"), "worst")
    box = start.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"])
    side = {c: F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1.0)) * margin for c in "xyz"}
    out = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"lo_{c}") - side[c] - F.col(c), F.col(c) - F.col(f"hi_{c}") - side[c]) for c in "xyz"])
    inside = now.crossJoin(F.broadcast(box)).agg(F.coalesce(F.max(out), F.lit(0.0)).alias("worst")).select(F.lit("bounding_box").alias("check"), (F.col("worst") <= 0).alias("passed"), "worst")
    around = edges.join(now.select("mesh_id", F.col("v_id").alias("b"), "x", "y", "z"), ["mesh_id", "b"]).groupBy("mesh_id", F.col("a").alias("v_id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    off = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    limit = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]) * spike_share
    spike = now.join(around, ["mesh_id", "v_id"]).crossJoin(F.broadcast(box)).agg(F.coalesce(F.max(off / limit), F.lit(0.0)).alias("worst"))
    spike = spike.select(F.lit("spikes").alias("check"), (F.col("worst") <= 1).alias("passed"), "worst")
    return gaps.unionByName(inside).unionByName(spike)


def overlap_counts(classified: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Vertices found in an adjacent (group +- 1) and in another foreign group; less a baseline.

    classified: group_id (the vertex's own), found.
    """
    step = F.abs(F.col("found") - F.col("group_id"))
    held = F.col("found") >= 0
    out = classified.agg(F.count(F.when(held & (step == 1), 1)).alias("adjacent"), F.count(F.when(held & (step > 1), 1)).alias("distant"))
    if baseline is None:
        return out
    base = baseline.select(F.col("adjacent").alias("__a"), F.col("distant").alias("__d"))
    return out.crossJoin(F.broadcast(base)).select((F.col("adjacent") - F.col("__a")).alias("adjacent"), (F.col("distant") - F.col("__d")).alias("distant"))


def remanence(clusters: DataFrame, field: float = 55000.0, inclination: float = 75.0, declination: float = -20.0) -> DataFrame:
    """Remanence of each cluster with the model's mode.

    One unknown magnitude puts the whole model in mode 'fixed_vector' with magnitudes at a Q
    ratio of about one (susceptibility * field / 100); unknown angles take the defaults.
    """
    any_unknown = clusters.agg(F.bool_or(F.col("remanence_magnitude").isNull()).alias("__u"))
    induced = F.col("susceptibility") * (field / 100.0)
    rows = clusters.crossJoin(F.broadcast(any_unknown))
    return rows.select(
        "cluster_id", F.when(F.col("__u"), "fixed_vector").otherwise("vector").alias("mode"),
        F.coalesce("remanence_magnitude", induced).alias("magnitude"), F.coalesce("remanence_inclination", F.lit(inclination)).alias("inclination"),
        F.coalesce("remanence_declination", F.lit(declination)).alias("declination"),
    )


def boundary_loops(boundary: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(key, loop, ord, v_id): boundary edges in the order of their loops, each from its smallest vertex.

    Loops are ranked by ``graph.chains`` and numbered within a mesh by their smallest vertex; no
    task holds a whole loop. Where several boundaries touch in a vertex, the k-th edge in goes
    on as the k-th edge out.
    """
    ranked = graph.chains(boundary, [key])
    names = ranked.select(key, "chain").distinct()
    numbered = mesh.dense_number(names, [key, "chain"], "n")
    first = numbered.groupBy(key).agg(F.min("n").alias("first"))
    loops = numbered.join(first, key).select(key, "chain", (F.col("n") - F.col("first")).cast("int").alias("loop"))
    return ranked.join(loops, [key, "chain"]).select(key, "loop", F.col("ord").cast("int").alias("ord"), F.col("a").alias("v_id"))


def stitch_loops(loops: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Triangles between two ordered loops (side 0 and 1: ord, v_id, x, y): the shorter diagonal next.

    Greedy and sequential along a pair of loops, so one task per pair.
    """

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s].sort_values("ord")[["v_id", "x", "y"]].values.tolist() for s in (0, 1)]
        n, m = len(sides[0]), len(sides[1])
        i = j = 0
        rows = []
        while n and m and (i < n or j < m):
            a, b = sides[0][i % n], sides[1][j % m]
            an, bn = sides[0][(i + 1) % n], sides[1][(j + 1) % m]
            first = (an[1] - b[1]) ** 2 + (an[2] - b[2]) ** 2
            second = (a[1] - bn[1]) ** 2 + (a[2] - bn[2]) ** 2
            if j >= m or (i < n and first <= second):
                rows.append((a[0], an[0], b[0]))
                i += 1
            else:
                rows.append((a[0], bn[0], b[0]))
                j += 1
        out = pd.DataFrame(rows, columns=["v0", "v1", "v2"]).astype("int64")
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return loops.groupBy(key).applyInPandas(stitch, f"{key} {dict(loops.dtypes)[key]}, v0 long, v1 long, v2 long")


def enforce_order(surfaces: DataFrame, order: list[int], margin: float) -> DataFrame:
    """Surfaces kept apart by ``margin``: for each pair from the top, the upper rises over the
    nearest point of the lower, then the lower sinks under the nearest point of the upper.

    surfaces: surface_id, v_id, x, y, z. Pairs depend on each other, so the driver loops over
    them; every step is a nearest-neighbour join and is written down.
    """
    from terralith.operators.locate import nearest
    from terralith.operators.storage import stored

    now = surfaces
    for upper, lower in zip(order, order[1:], strict=False):
        for moving, other, up in ((upper, lower, True), (lower, upper, False)):
            mine = now.filter(F.col("surface_id") == moving)
            theirs = now.filter(F.col("surface_id") == other)
            pairs = nearest(mine.select(F.col("v_id").alias("obs_id"), "x", "y"), theirs.select(F.col("v_id").alias("target_id"), "x", "y"), 1, "xy")
            limit = pairs.join(theirs.select(F.col("v_id").alias("target_id"), F.col("z").alias("zo")), "target_id").select(F.col("obs_id").alias("v_id"), "zo")
            z = F.greatest(F.col("z"), F.col("zo") + margin) if up else F.least(F.col("z"), F.col("zo") - margin)
            moved = mine.join(limit, "v_id").withColumn("z", z).select(*surfaces.columns)
            now = stored(now.filter(F.col("surface_id") != moving).unionByName(moved))
    return now


def split_mesh(triangles: DataFrame, properties: DataFrame, mesh_id: int, next_id: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(triangles with component ids, property rows): each component takes a copy of its mesh's row.

    Components by edges, largest first, get ``next_id``, ``next_id + 1`` and so on.
    """
    parts = graph.face_components(triangles)
    ranks = graph.component_sizes(parts, least).withColumn("new_id", F.col("rank") - 1 + next_id)
    labelled = triangles.join(parts, "t_id").join(F.broadcast(ranks.select("root", "new_id")), "root").drop("root")
    row = properties.filter(F.col("cluster_id") == mesh_id).drop("cluster_id")
    return labelled, ranks.select(F.col("new_id").alias("cluster_id"), F.col("n").alias("n_faces")).crossJoin(F.broadcast(row))


def layer_stack(contacts: DataFrame, top: float, bottom: float) -> DataFrame:
    """Layers between consecutive contacts of a column: (node, layer, z_top, z_bottom).

    contacts: node, ord (from the top), z. A flat top and bottom close the stack.
    """
    w = Window.partitionBy("node").orderBy("ord")
    rows = contacts.select("node", F.col("ord").alias("layer"), F.coalesce(F.lag("z").over(w), F.lit(top)).alias("z_top"), F.col("z").alias("z_bottom"))
    last = contacts.groupBy("node").agg((F.max("ord") + 1).alias("layer"), F.max_by("z", "ord").alias("z_top")).withColumn("z_bottom", F.lit(bottom))
    return rows.unionByName(last)


def pad_edges(nodes: DataFrame, nx: int, ny: int, ring: int = 1) -> DataFrame:
    """A padded nx x ny grid (ix, iy from 0, z): padding continues the two rows next to it linearly.

    Corners take the mean of both directions. z of the padding ring is replaced.
    """
    low, high = ring, {"ix": nx - 1 - ring, "iy": ny - 1 - ring}
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high[c]), F.col(c)))
    inner = lambda c: F.when(F.col(c) < low, low + 1).when(F.col(c) > high[c], high[c] - 1)
    steps = lambda c: F.when(F.col(c) < low, low - F.col(c)).when(F.col(c) > high[c], F.col(c) - high[c]).otherwise(0)
    inside = F.col("ix").between(low, high["ix"]) & F.col("iy").between(low, high["iy"])
    pad = nodes.filter(~inside).select("ix", "iy", clamp("ix").alias("cx"), clamp("iy").alias("cy"), inner("ix").alias("mx"), inner("iy").alias("my"), steps("ix").alias("sx"), steps("iy").alias("sy"))
    at = lambda name, x, y: nodes.select(F.col("ix").alias(x), F.col("iy").alias(y), F.col("z").alias(name))
    out = pad.join(at("z0", "cx", "cy"), ["cx", "cy"]).join(at("zx", "mx", "cy"), ["mx", "cy"], "left").join(at("zy", "cx", "my"), ["cx", "my"], "left")
    along_x = F.col("z0") + F.col("sx") * (F.col("z0") - F.col("zx"))
    along_y = F.col("z0") + F.col("sy") * (F.col("z0") - F.col("zy"))
    z = F.when(F.col("sx") == 0, along_y).when(F.col("sy") == 0, along_x).otherwise((along_x + along_y) / 2)
    return nodes.filter(inside).select("ix", "iy", "z").unionByName(out.select("ix", "iy", z.alias("z")))
