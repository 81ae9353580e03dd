"""Spatial joins: containment, nearest neighbours, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators.cells import with_boxes
from terralith.operators.forward import BROADCAST_FACETS, corners, pairs
from terralith.operators.storage import discard, stored_at

#: Most reference points that every point looks through; more are searched by grid cells.
BROADCAST_POINTS = 4096
#: Places, in multiples of ``BROADCAST_POINTS``, that go to every executor as arrays.
PLACES = 4


def envelope(points: DataFrame, bodies: DataFrame, cz: float, a: float, b: float, c: float, regional: float) -> DataFrame:
    """Highest of the regional level and the tops of all ellipsoids (cx, cy) over each point.

    A body matters only where its footprint covers the point, so points meet bodies through
    cells of the footprint's size and only those nine cells around them.
    """
    side = max(a, b)
    dealt = bodies.withColumns({"bi": F.floor(F.col("cx") / side), "bj": F.floor(F.col("cy") / side)})
    near = _near_cells(points.select("obs_id", "x", "y"), side, 2)
    top = g.ellipsoid_top(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), cz, a, b, c)
    inside = F.pow((F.col("x") - F.col("cx")) / a, 2) + F.pow((F.col("y") - F.col("cy")) / b, 2) <= 1.0
    best = near.join(dealt, ["bi", "bj"]).filter(inside).groupBy("obs_id").agg(F.max(top).alias("__top"))
    out = points.join(best, "obs_id", "left")
    return out.withColumn("z", F.greatest(F.lit(regional), F.coalesce("__top", F.lit(regional)))).drop("__top")


def _near_cells(points: DataFrame, side: float, dims: int) -> DataFrame:
    """Points repeated for the 3**dims cells at and around their own (bi, bj[, bk])."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    out = points
    for name, axis in list(zip(("bi", "bj", "bk"), "xyz"))[:dims]:
        out = out.withColumn("__s", F.explode(steps)).withColumn(name, F.floor(F.col(axis) / side) + F.col("__s")).drop("__s")
    return out


def classify(points: DataFrame, facets: DataFrame, bottom: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(obs_id, *by, group_id) of the first closed mesh (by group_id) that holds each point; -1 for none.

    Points under ``bottom`` are outside. ``by``: columns of both that tell models apart (a point
    is held against the facets of its own). See ``holders`` for the test.
    """
    by = by or []
    first = holders(points, facets, by).withColumnRenamed("group_id", "__g")
    found = F.coalesce("__g", F.lit(-1))
    if bottom is not None:
        found = F.when(F.col("z") < bottom, -1).otherwise(found)
    return points.join(first, ["obs_id", *by], "left").select("obs_id", *by, found.alias("group_id"))


def holders(points: DataFrame, facets: DataFrame, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(obs_id, *keep, *by, group_id) for points in any closed mesh: the first by group_id; no row for the rest.

    A ray along +x from the point, moved by 1.234567e-6 in y and 2.345678e-6 in z so that it
    meets no edge, crosses the mesh an odd number of times. ``by``: facet columns that tell
    models apart; points that lack them are held against every model. ``keep``: columns of the
    points. Points first meet the boxes of whole meshes, so rays are sent only where they can
    matter: outside its box a closed mesh is crossed an even number of times. A mesh with an
    edge that an odd number of facets share is not closed and keeps the rays from below its x.
    """
    by, keep = by or [], keep or []
    mesh, on = [*by, "group_id"], [c for c in by if c in points.columns]
    p, q, r = corners()
    oy, oz = F.col("y") + 1.234567e-6, F.col("z") + 2.345678e-6
    o = (F.col("x"), oy, oz)
    e1, e2 = g.sub(q, p), g.sub(r, p)
    h = (F.lit(0.0), -e2[2], e2[1])
    det = g.dot(e1, h)
    s = g.sub(o, p)
    u = g.dot(s, h) / det
    w = g.cross(s, e1)
    v = w[0] / det
    t = g.dot(e2, w) / det
    hit = (F.abs(det) >= 1e-30) & u.between(0.0, 1.0) & (v >= 0.0) & (u + v <= 1.0) & (t > 1e-12)
    spans = {a: (F.least(*[f"{c}{a}" for c in "pqr"]), F.greatest(*[f"{c}{a}" for c in "pqr"])) for a in "xyz"}
    ends = facets.groupBy(*mesh).agg(*[f(e).alias(f"__{n}{a}") for a, (lo, hi) in spans.items() for n, f, e in (("min", F.min, lo), ("max", F.max, hi))])
    place = {c: F.struct(*[F.col(f"{c}{a}").alias(a) for a in "xyz"]) for c in "pqr"}
    edges = facets.select(*mesh, F.explode(F.array(*[F.array_sort(F.array(place[a], place[b])) for a, b in ("pq", "qr", "rp")])).alias("__e"))
    gaps = edges.groupBy(*mesh, "__e").agg(F.count("*").alias("__n")).filter("__n % 2 = 1").select(*mesh).distinct()
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in mesh]
    slack = lambda a: (F.col(f"__max{a}") - F.col(f"__min{a}")) * 1e-9 + 1e-9
    span = {a: (F.col(f"__min{a}") - slack(a), F.col(f"__max{a}") + slack(a)) for a in "xyz"}
    spots = points.select("obs_id", *keep, *on, "x", "y", "z")
    closed = ends.alias("m").join(gaps.alias("o"), same("m", "o"), "left_anti")
    near = with_boxes(spots, [*o], closed, [span[a] for a in "xyz"], mesh, on)
    if not gaps.isEmpty():
        near = near.unionByName(with_boxes(spots, [oy, oz], ends.alias("m").join(gaps.alias("o"), same("m", "o"), "left_semi"), [span[a] for a in "yz"], mesh, on))
    both = with_boxes(near, [oy, oz], facets, [spans[a] for a in "yz"], [*mesh, *[f"{c}{a}" for c in "pqr" for a in "xyz"]], mesh)
    crossed = both.filter(hit).groupBy("obs_id", *keep, *mesh).agg(F.count("*").alias("__n")).filter("__n % 2 = 1")
    return crossed.groupBy("obs_id", *keep, *by).agg(F.min("group_id").alias("group_id"))


def surface_z(points: DataFrame, facets: DataFrame) -> DataFrame:
    """Height of a surface under each point: first triangle (by t_id) that covers it in x-y.

    Barycentric weights down to -1e-9 count as inside; points that no triangle covers are left
    out. Points meet triangles through cells of the triangles' x-y extents.
    """
    d = (F.col("qy") - F.col("ry")) * (F.col("px") - F.col("rx")) + (F.col("rx") - F.col("qx")) * (F.col("py") - F.col("ry"))
    wa = ((F.col("qy") - F.col("ry")) * (F.col("x") - F.col("rx")) + (F.col("rx") - F.col("qx")) * (F.col("y") - F.col("ry"))) / d
    wb = ((F.col("ry") - F.col("py")) * (F.col("x") - F.col("rx")) + (F.col("px") - F.col("rx")) * (F.col("y") - F.col("ry"))) / d
    wc = 1.0 - wa - wb
    inside = (F.abs(d) > 1e-30) & (wa >= -1e-9) & (wb >= -1e-9) & (wc >= -1e-9)
    z = wa * F.col("pz") + wb * F.col("qz") + wc * F.col("rz")
    both = over_facets(points.select("obs_id", "x", "y"), facets).filter(inside)
    return both.groupBy("obs_id").agg(F.min_by(z, "t_id").alias("z"))


def over_facets(points: DataFrame, facets: DataFrame) -> DataFrame:
    """Points beside the facets whose x-y extent, widened by what rounding allows, holds them."""
    spans = []
    for a in "xy":
        low, high = F.least(*[f"{c}{a}" for c in "pqr"]), F.greatest(*[f"{c}{a}" for c in "pqr"])
        slack = (high - low) * 1e-6 + 1e-9
        spans.append((low - slack, high + slack))
    return with_boxes(points, [F.col("x"), F.col("y")], facets, spans)


def nearest(points: DataFrame, targets: DataFrame, k: int = 1, dims: str = "xyz") -> DataFrame:
    """(obs_id, target_id, d2, rank) of the ``k`` nearest targets; ties by target_id.

    Up to ``BROADCAST_POINTS`` targets are looked through by every point. More are first brought
    together by place; up to ``PLACES`` times as many places stream past the points as arrays
    (``_nearest_by_places``), more are searched in a tree of cells (``_nearest_by_cells``). On
    both ways points and targets without a full place are left out.
    """
    n = targets.count()
    src = points.select("obs_id", *[F.col(a).alias(f"__{a}") for a in dims])
    if n > BROADCAST_POINTS:
        targets = targets.select("target_id", *[F.col(a).cast("double").alias(a) for a in dims])
        if targets.select(*dims).distinct().count() <= PLACES * BROADCAST_POINTS:
            return _nearest_by_places(src, targets, k, dims)
        return _nearest_by_cells(src, targets, k, dims)
    blocks = max(1, -(-n // 1024))
    packed = targets.select(F.struct("target_id", *[F.col(a).alias(a) for a in dims]).alias("t"), F.pmod(F.xxhash64("target_id"), F.lit(blocks)).alias("__b"))
    packed = packed.groupBy("__b").agg(F.collect_list("t").alias("ts"))
    # spread by point first: the ranking below finds its partitioning already there
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = src.repartition(parts, "obs_id").crossJoin(F.broadcast(packed.select("ts")))

    def far(t):
        return F.struct(sum((F.pow(t[a] - F.col(f"__{a}"), 2) for a in dims), F.lit(0.0)).alias("d2"), t["target_id"].alias("target_id"))

    reach = F.transform("ts", far)
    closest = F.array(F.array_min(reach)) if k == 1 else F.slice(F.sort_array(reach), 1, k)
    best = both.select("obs_id", F.explode(closest).alias("c"))
    return _ranked(best.select("obs_id", "c.target_id", "c.d2"), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("obs_id").orderBy("d2", "target_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Targets, for each neighbour asked for, up to which a cell of the tree is not split, and its greatest depth.
_LEAF = 16
_DEPTH = 20


def _whole(src: DataFrame, targets: DataFrame, k: int, dims: str) -> tuple[DataFrame, DataFrame]:
    """Points, and the ``k`` smallest ids of every target place, that have a full place."""
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    for a in dims:
        targets, src = targets.filter(whole(a)), src.filter(whole(f"__{a}"))
    src = src.withColumns({f"__{a}": F.col(f"__{a}").cast("double") + 0.0 for a in dims})
    one = Window.partitionBy(*dims).orderBy("target_id")
    few = targets.withColumns({a: F.col(a) + 0.0 for a in dims}).withColumn("__r", F.row_number().over(one)).filter(F.col("__r") <= k).drop("__r")
    return src, few


def _nearest_by_places(src: DataFrame, targets: DataFrame, k: int, dims: str) -> DataFrame:
    """``nearest`` with all places of the targets as arrays; points stream past them and nothing of a point is shuffled."""
    src, few = _whole(src, targets, k, dims)
    kinds = {"obs_id": dict(src.dtypes)["obs_id"], "target_id": dict(few.dtypes)["target_id"]}
    rows = few.toPandas().sort_values([*dims, "target_id"], ignore_index=True)
    axes = rows[[*dims]].to_numpy(float).reshape(-1, len(dims))
    new = np.r_[True, (axes[1:] != axes[:-1]).any(axis=1)][: len(axes)]
    starts = np.flatnonzero(new)
    held = src.sparkSession.sparkContext.broadcast((axes[starts], starts, np.diff(np.r_[starts, len(axes)]), rows["target_id"].to_numpy()))
    schema = f"obs_id {kinds['obs_id']}, target_id {kinds['target_id']}, d2 double, rank int"

    def run(batches):
        at, starts, sizes, ids = held.value
        lines = [np.ascontiguousarray(at[:, i]) for i in range(at.shape[1])]
        step = max(1, 65_536 // max(1, len(at)))
        for pdf in batches:
            found = []
            own = [pdf[f"__{a}"].to_numpy(float) for a in dims]
            for low in range(0, len(pdf) if len(at) else 0, step):
                d2 = np.zeros((min(step, len(pdf) - low), len(at)))
                for x, line in zip(own, lines, strict=True):
                    gap = line - x[low : low + step, None]
                    d2 += gap * gap
                most = d2.min(axis=1) if k == 1 else np.partition(d2, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                point, place = np.nonzero(d2 <= most[:, None])
                n = sizes[place]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append((np.repeat(point, n) + low, np.repeat(starts[place], n) + within, np.repeat(d2[point, place], n)))
            if not found:
                continue
            point, target, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
            out = pd.DataFrame({"p": point, "target_id": ids[target], "d2": d2}).sort_values(["p", "d2", "target_id"])
            out["rank"] = out.groupby("p").cumcount() + 1
            out = out[out["rank"] <= k]
            yield out.assign(obs_id=pdf["obs_id"].to_numpy()[out["p"]])[["obs_id", "target_id", "d2", "rank"]]

    return src.repartition(src.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(run, schema)


def _nearest_by_cells(src: DataFrame, targets: DataFrame, k: int, dims: str) -> DataFrame:
    """``nearest`` by ``descend``: targets of one place are one place with its ``k`` smallest ids, points of one place one point.

    A single neighbour in the point's own place is found by an equi-join instead.
    """
    axes = [f"__{a}" for a in dims]
    src, few = _whole(src, targets, k, dims)
    if k == 1:
        # a target in the point's own place cannot be beaten: those points need no search
        here = [F.col(a) for a in axes]
        own = few.select(*[F.col(c).alias(a) for c, a in zip(dims, axes, strict=True)], "target_id").filter(sum((F.abs(a) for a in here), F.lit(0.0)) < float("inf"))
        met = src.join(own, axes).select("obs_id", "target_id", F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
        src = src.join(own, axes, "left_anti")
        if src.isEmpty():
            return met
        return met.unionByName(_by_tree(src, few, k, dims))
    return _by_tree(src, few, k, dims)


def _by_tree(src: DataFrame, few: DataFrame, k: int, dims: str) -> DataFrame:
    axes = [f"__{a}" for a in dims]
    places = src.groupBy(*axes).agg(F.min("obs_id").alias("p"))
    met = descend(places, few.withColumns({f"{e}{a}": F.col(a) for a in dims for e in ("lo", "hi")}), k, dims)
    d2 = sum((F.pow(F.col(a) - F.col(f"__{a}"), 2) for a in dims), F.lit(0.0))
    best = _ranked(met.select(F.col("p").alias("obs_id"), "target_id", d2.alias("d2")), k).withColumnRenamed("obs_id", "p")
    own = src.join(places.withColumnsRenamed({c: f"{c}p" for c in axes}), [F.col(c) == F.col(f"{c}p") for c in axes]).select("obs_id", "p")
    return own.join(best, "p").select("obs_id", "target_id", "d2", "rank")


def descend(places: DataFrame, items: DataFrame, k: int, dims: str) -> DataFrame:
    """(p, __x.., target_id, x..): for every place, items that hold its ``k`` nearest ones for certain.

    places: p and ``__`` before each of ``dims``; items: target_id, a centre (x, y, z as in ``dims``) and the
    box lo.., hi.. around each. All places go down together through a tree of cells that adapts
    to the items: a cell of more than ``_LEAF`` * k items is split by their centres; cells carry
    their count and the box of what they hold. Each place keeps a frontier of cells: its k-th
    nearest item is no farther than the far corners of cells that hold k together, and cells
    whose near corner lies beyond that are dropped before the next level. Leaves hold few items,
    so what a place meets last is bounded. Every level is one round, at most ``_DEPTH`` of them
    however the items lie; the tables of the round before are removed.
    """
    spark = places.sparkSession
    axes = [f"__{a}" for a in dims]
    corner = [f"{e}{a}" for a in dims for e in ("lo", "hi")]
    keys, parents = [f"c{a}" for a in dims], [f"u{a}" for a in dims]
    live, live_path = stored_at(items.select("target_id", *dims, *corner))
    ends = live.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in dims for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return places.crossJoin(live.select("target_id", *dims)).select("p", *axes, "target_id", *dims)  # no items: no rows
    side = max([1e-300, *[ends[f"max_{a}"] - ends[f"min_{a}"] for a in dims]])
    step = 2 if len(dims) <= 2 else 1
    frontier, path = stored_at(places.select("p", *axes, *[F.lit(0).cast("long").alias(u) for u in parents]))
    live = live.withColumns({u: F.lit(0).cast("long") for u in parents})
    kept, leaves, old = [], [], [live_path]
    for depth in range(step, _DEPTH + step, step):
        depth = min(depth, _DEPTH)
        cell = {f"c{a}": F.least(F.floor((F.col(a) - ends[f"min_{a}"]) / side * 2.0**depth), F.lit(2**depth - 1)).cast("long") for a in dims}
        placed = live.withColumns(cell)
        cells = placed.groupBy(*parents, *keys).agg(F.count("*").alias("n"), *[f(f"{e}{a}").alias(f"{e}{a}") for a in dims for e, f in (("lo", F.min), ("hi", F.max))])
        cells, cells_path = stored_at(cells.withColumn("leaf", (F.col("n") <= _LEAF * k) | F.lit(depth == _DEPTH)))
        met = frontier.join(cells, parents).drop(*parents)
        gap = [F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"__{a}"), F.col(f"__{a}") - F.col(f"hi{a}")) for a in dims]
        far = [F.greatest(F.abs(F.col(f"__{a}") - F.col(f"lo{a}")), F.abs(F.col(f"hi{a}") - F.col(f"__{a}"))) for a in dims]
        met = met.select("p", *axes, *keys, "n", "leaf", F.lit(depth).alias("depth"), sum((g_ * g_ for g_ in gap), F.lit(0.0)).alias("near"), sum((f_ * f_ for f_ in far), F.lit(0.0)).alias("far"))
        # leaves of earlier rounds bound the search too
        both = _union([met, *[x for x, _ in kept]])
        w = Window.partitionBy("p").orderBy("far", "near")
        sums = both.withColumn("__sum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        limit = F.min(F.when(F.col("__sum") >= k, F.col("far"))).over(Window.partitionBy("p"))
        within = sums.withColumn("__b", limit).filter(F.col("__b").isNull() | (F.col("near") <= F.col("__b") * (1 + 1e-12))).drop("__sum", "__b")
        now, now_path = stored_at(within)
        for _, x in kept:
            discard(spark, x)
        kept = [(now.filter("leaf"), now_path)]
        # items of cells that no place keeps are let go
        held = cells.join(now.filter(F.col("depth") == depth).select(*keys).distinct(), keys, "left_semi")
        here = placed.join(held.select(*parents, *keys, "leaf"), [*parents, *keys])
        leaves.append(stored_at(here.filter("leaf").select("target_id", *dims, *keys, F.lit(depth).alias("depth")))[0])
        rest, rest_path = stored_at(here.filter("not leaf").select("target_id", *dims, *corner, *[F.col(c).alias(u) for c, u in zip(keys, parents, strict=True)]))
        for x in (*old, path, cells_path):
            discard(spark, x)
        live, old = rest, [rest_path]
        frontier, path = stored_at(now.filter("not leaf").select("p", *axes, *[F.col(c).alias(u) for c, u in zip(keys, parents, strict=True)]))
        if frontier.isEmpty():
            break
    return kept[0][0].join(_union(leaves), ["depth", *keys]).select("p", *axes, "target_id", *dims)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def idw_weights(neighbours: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Inverse-distance weights of each point's neighbours, summing to 1."""
    raw = 1.0 / F.greatest(F.sqrt("d2"), F.lit(floor))
    w = Window.partitionBy("obs_id")
    return neighbours.withColumn("w", raw / F.sum(raw).over(w))


def idw(points: DataFrame, samples: DataFrame, least: float = 1.0) -> DataFrame:
    """Inverse-square-distance mean of all samples (x, y, z as sx, sy, sz) at each point.

    Samples of one place are one, with the sum of their values and their number. Places are
    broadcast as arrays while they are few and points stream past them, so nothing of a point is
    shuffled; more are dealt into blocks, with partial sums before the shuffle. A point or sample
    without a place counts as ``least`` away.
    """
    places = samples.groupBy("sx", "sy").agg(F.sum(F.col("sz").cast("double")).alias("total"), F.count("*").alias("n"))
    nowhere = F.col("sx").isNull() | F.col("sy").isNull()
    seen = points.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if places.count() > BROADCAST_FACETS:
        d2 = F.greatest(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2), F.lit(least * least))
        both = pairs(seen, places)
        return both.groupBy("obs_id").agg((F.sum(F.col("total") / d2) / F.sum(F.col("n") / d2)).alias("z"))
    rows = places.select(F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"), F.coalesce("total", F.lit(0.0)).alias("total"), "n", F.col("total").isNotNull().alias("some"), nowhere.alias("nowhere")).toPandas()
    if not rows["some"].any():
        return seen.select("obs_id", F.lit(None).cast("double").alias("z")) if len(rows) else seen.filter("false").select("obs_id", F.lit(0.0).alias("z"))
    here = rows[~rows["nowhere"].astype(bool)]
    held = seen.sparkSession.sparkContext.broadcast((here["sx"].to_numpy(float), here["sy"].to_numpy(float), here[["total", "n"]].to_numpy(float), rows.loc[rows["nowhere"].astype(bool), ["total", "n"]].to_numpy(float).sum(axis=0), rows[["total", "n"]].to_numpy(float).sum(axis=0)))

    def run(batches):
        sx, sy, values, rest, everything = held.value
        step = max(1, 65_536 // max(1, len(sx)))
        for pdf in batches:
            x, y, lost = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), pdf["lost"].to_numpy(bool)
            sums = np.empty((len(pdf), 2))
            for at in range(0, len(pdf), step):
                dx, dy = x[at : at + step, None] - sx, y[at : at + step, None] - sy
                sums[at : at + step] = (1.0 / np.maximum(dx * dx + dy * dy, least * least)) @ values
            sums += rest / (least * least)
            sums[lost] = everything / (least * least)
            yield pd.DataFrame({"obs_id": pdf["obs_id"], "z": sums[:, 0] / sums[:, 1]})

    dealt = seen.withColumn("lost", F.col("x").isNull() | F.col("y").isNull()).repartition(seen.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(run, f"obs_id {dict(seen.dtypes)['obs_id']}, z double")


def bilinear(points: DataFrame, nodes: DataFrame, step: float, nx: int, ny: int) -> DataFrame:
    """Bilinear height on a regular grid of nodes (ix, iy, z) from 0; outside it extrapolates linearly.

    Points find the four nodes of their cell by equi-join.
    """
    cx = F.greatest(F.lit(0), F.least(F.lit(nx - 2), F.floor(F.col("x") / step)))
    cy = F.greatest(F.lit(0), F.least(F.lit(ny - 2), F.floor(F.col("y") / step)))
    at = points.select("obs_id", cx.alias("cx"), cy.alias("cy"), (F.col("x") / step - cx).alias("tx"), (F.col("y") / step - cy).alias("ty"))
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = at.withColumn("c", F.explode(corner)).select("obs_id", (F.col("cx") + F.col("c.i")).alias("ix"), (F.col("cy") + F.col("c.j")).alias("iy"), _side(F.col("c.i"), F.col("tx")).alias("wx"), _side(F.col("c.j"), F.col("ty")).alias("wy"))
    return four.join(nodes, ["ix", "iy"]).groupBy("obs_id").agg(F.sum(F.col("wx") * F.col("wy") * F.col("z")).alias("z"))


def _side(far: Column, t: Column) -> Column:
    return F.when(far == 1, t).otherwise(1.0 - t)


def inside_any(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes (lo/hi of x, y, z) that hold at least one point, through cells of their extents."""
    ends = [f"{e}_{a}" for a in "xyz" for e in ("lo", "hi")]
    held = with_boxes(points.select("x", "y", "z"), [F.col(a) for a in "xyz"], boxes.select(*ends).distinct(), [(F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in "xyz"])
    return boxes.join(held.select(*ends).distinct(), ends, "left_semi")
