"""Gravity of many facets at many stations: facets by blocks of one neighbourhood, far blocks by their moments.

A facet's gravity is n_z times the integral of 1/r over it. Seen from beyond ``_REACH`` times a
block's longest half side, 1/r over the block is the polynomial through its values at a few
Chebyshev nodes, up to ``_ERROR``; so the block is as many point sources, worked out once, and
costs a far station that many terms whatever it holds. Stations that are nearer take its facets one by
one, or by slices that are far in their turn. Which way a station takes a block is decided by the
block's box and the station alone, so every pair counts once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.storage import discard, stored, stored_at

#: Half sides beyond which a block's moments stand for it, and their error as a share of the sum of the sources' sizes over r.
_REACH, _ERROR = 8.0, 1e-14
#: Facets of a slice of a near block, and far stations from which its moments pay.
_SLICE, _STATIONS = 1024, 64
#: Pairs that one array operation takes.
_TILE = 16_384
#: Blocks whose moments are one unit of work with a block of stations.
_GROUP = 32


def _points(length: float, reach: float, power: int) -> int:
    """Points by which ``power`` times their number reaches ``_ERROR`` on a half side ``length`` seen from ``reach``."""
    if not length > 0:
        return 1
    d = reach / length
    return max(1, int(np.ceil(-np.log(_ERROR) / (power * np.log(d + np.sqrt(1 + d * d))))))


class Moments:
    """Point sources at Chebyshev nodes of a block's box that stand for its facets from ``reach`` on."""

    def __init__(self, centre, half, counts, q):
        self.centre, self.half, self.counts, self.q = (np.asarray(x) for x in (centre, half, counts, q))
        self.reach = _REACH * float(self.half.max())

    @staticmethod
    def box(corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = corner.min(axis=(0, 1)), corner.max(axis=(0, 1))
        centre = (low + high) / 2
        return centre, np.maximum(high - centre, centre - low)

    @classmethod
    def of(cls, corner: np.ndarray, w: np.ndarray) -> Moments | None:
        """None where the sources would be more than four times the facets, each of which costs twenty of them."""
        centre, half = cls.box(corner)
        reach = _REACH * float(half.max())
        counts = [_points(h, reach, 1) for h in half]
        if np.prod(counts) > 4 * len(corner) or not np.isfinite(reach):
            return None
        p, a, b = corner[:, 0], corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 1]
        size = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]  # twice the area times n_z
        longest = max(float(np.sqrt((x * x).sum(axis=1).max())) for x in (a, b, a + b))
        at, weight = np.polynomial.legendre.leggauss(_points(longest / 2, reach, 2) + 1)
        at, weight = (at + 1) / 2, weight / 2
        q = np.zeros((counts[0] * counts[1], counts[2]))
        for (u, wu), (v, wv) in itertools.product(zip(at, weight, strict=True), repeat=2):
            for low in range(0, len(corner), 4096):
                cut = slice(low, low + 4096)
                y = (p[cut] + u * (a[cut] + v * b[cut]) - centre) / np.maximum(half, 1e-300)
                lx, ly, lz = (cls._basis(y[:, i], counts[i]) for i in range(3))
                c = (wu * wv * u) * size[cut] * w[cut]
                q += ((lx * c[:, None])[:, :, None] * ly[:, None, :]).reshape(len(c), -1).T @ lz
        return cls(centre, half, counts, q.reshape(-1))

    @staticmethod
    def _basis(t: np.ndarray, n: int) -> np.ndarray:
        """(m, n) values at ``t`` of the polynomials that are 1 at one of n Chebyshev nodes and 0 at the others."""
        whole = np.polynomial.chebyshev.chebvander(t, n - 1) * np.r_[1.0, np.full(n - 1, 2.0)]
        return whole @ np.polynomial.chebyshev.chebvander(Moments._nodes(n), n - 1).T / n

    @staticmethod
    def _nodes(n: int) -> np.ndarray:
        return np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))

    def far(self, o: np.ndarray) -> np.ndarray:
        return distant(o, self.centre, self.half)

    def at(self, o: np.ndarray) -> np.ndarray:
        """Sums at stations ``o`` (n, 3)."""
        x, y, z = (self.centre[i] + self.half[i] * self._nodes(int(self.counts[i])) for i in range(3))
        out, step = np.zeros(len(o)), max(1, _TILE // len(self.q))
        for low in range(0, len(o), step):
            part = o[low : low + step]
            side = (np.square(part[:, 0, None] - x)[:, :, None] + np.square(part[:, 1, None] - y)[:, None, :]).reshape(len(part), -1)
            r = (side[:, :, None] + np.square(part[:, 2, None] - z)[:, None, :]).reshape(len(part), -1)
            np.sqrt(r, out=r)
            np.reciprocal(r, out=r)
            out[low : low + step] = r @ self.q
        return out


def distant(o: np.ndarray, centre, half) -> np.ndarray:
    """Which stations are as far from a box as moments ask."""
    gap = np.maximum(np.abs(o - np.asarray(centre)) - np.asarray(half), 0.0)
    return np.sqrt((gap * gap).sum(axis=1)) >= _REACH * float(np.max(half))


def near_sums(o: np.ndarray, corner: np.ndarray, w: np.ndarray, direct) -> np.ndarray:
    """Sums at ``o`` of facets in the order of their places: slices that are far by moments, the rest by ``direct(o, corner, w)``."""
    out = np.zeros(len(o))
    for low in range(0, len(corner), _SLICE):
        c, v = corner[low : low + _SLICE], w[low : low + _SLICE]
        far = distant(o, *Moments.box(c))
        moments = Moments.of(c, v) if far.sum() >= _STATIONS else None
        if moments is None:
            far = np.zeros(len(o), bool)
        else:
            out[far] += moments.at(o[far])
        if not far.all():
            out[~far] += direct(o[~far], c, v)
    return out


def place_order(place: list[Column], low: list[float], size: float) -> Column:
    """Number of a place along a curve through space that keeps near places together (bits of the axes in turn, 16 each)."""
    bits = []
    for axis, c in enumerate(place):
        cell = F.least(F.floor((c - low[axis]) * (65_535 / size if size > 0 else 0.0)), F.lit(65_535))
        cell = F.coalesce(cell.cast("long"), F.lit(0).cast("long"))
        bits += [F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + axis) for i in range(16)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ordered(df: DataFrame, place: list[Column], parts: int, first: list[str], last: list[Column]) -> DataFrame:
    """``df`` in ``parts`` ranges of ``first`` and of the order of ``place``, sorted; ties go by ``last``."""
    names = [f"__{a}" for a in "xyz"]
    seen = df.select(*[c.alias(n) for c, n in zip(place, names, strict=True)]).filter(" AND ".join(f"abs({n}) < double('inf')" for n in names))
    ends = seen.agg(*[F.min(n).alias(f"l{n}") for n in names], *[F.max(n).alias(f"h{n}") for n in names]).first()
    low = [ends[f"l{n}"] or 0.0 for n in names]
    size = max((ends[f"h{n}"] or 0.0) - x for n, x in zip(names, low, strict=True))
    keys = [*first, "__order", *[f"__last{i}" for i in range(len(last))]]
    out = df.withColumns({"__order": place_order(place, low, size), **{f"__last{i}": c for i, c in enumerate(last)}})
    return out.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys[len(first) :])


def gravity(obs: DataFrame, facets: DataFrame, corners: list[str], by: list[str], facet_block: int, obs_block: int, direct) -> DataFrame:
    """(obs_id, *by, response): sums over ``facets`` (corners, by, __w) at ``obs`` (obs_id, x, y, z).

    ``direct(o, corner, w)`` sums over pairs. Blocks are written once; moments meet stations in
    units of ``_GROUP`` blocks, and only blocks that some station is near to meet stations whole.
    """
    kinds, given = dict(facets.dtypes), {f"__by{i}": c for i, c in enumerate(by)}
    facets, by = facets.withColumnsRenamed({c: n for n, c in given.items()}), list(given)
    own = "".join(f"{n} {kinds[c]}, " for n, c in given.items())
    schema = f"obs_id {dict(obs.dtypes)['obs_id']}, {own}response double"
    place = [sum((F.col(f"{c}{a}") for c in "pqr"), F.lit(0.0)) / 3 for a in "xyz"]
    facets, path = stored_at(facets.select(*by, *[F.col(c).cast("double").alias(c) for c in [*corners, "__w"]]))
    parts = min(10_000, max(1, -(-facets.count() // facet_block)))
    lists = ["centre", "half", "counts", "q", "corner", "w"]

    def pack(batches):
        number, kept, name = itertools.count(TaskContext.get().partitionId() << 32), [], None

        def block(pdf):
            corner, w = pdf[corners].to_numpy(float).reshape(-1, 3, 3), pdf["__w"].to_numpy(float)
            m, (centre, half) = Moments.of(corner, w), Moments.box(corner)
            row = {**{c: pdf[c].iloc[0] for c in by}, "b": next(number), "centre": centre, "half": half, "counts": m.counts if m else [], "q": m.q if m else [], "corner": corner.reshape(-1), "w": w}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        def whole(most):
            rows = pd.concat(kept)
            for low in range(0, len(rows) - (most and len(rows) % facet_block), facet_block):
                yield block(rows.iloc[low : low + facet_block])
            kept[:] = [rows.iloc[len(rows) - len(rows) % facet_block :]] if most and len(rows) % facet_block else []

        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False) if by else [(None, pdf)]:
                same = kept and (not by or all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(key, name, strict=True)))
                if kept and not same:
                    yield from whole(False)
                name = key
                kept.append(part)
                if sum(map(len, kept)) >= facet_block:
                    yield from whole(True)
        if kept:
            yield from whole(False)

    sorted_ = ordered(facets, place, parts, by, [F.xxhash64(*corners)])
    blocks = stored(sorted_.mapInPandas(pack, f"{own}b long, " + ", ".join(f"{c} array<{'int' if c == 'counts' else 'double'}>" for c in lists)))
    discard(obs.sparkSession, path)

    nan = F.lit(float("nan"))
    chunks = min(10_000, max(1, -(-obs.count() // obs_block)))
    seen = obs.select("obs_id", *[F.coalesce(F.col(a).cast("double"), nan).alias(a) for a in "xyz"])
    dealt = ordered(seen, [F.col(a) for a in "xyz"], chunks, [], [F.xxhash64("obs_id")]).withColumn("c", F.spark_partition_id())
    low, high = [F.array(*[f(a) for a in "xyz"]) for f in (F.min, F.max)]
    stations = stored(dealt.groupBy("c").agg(low.alias("low"), high.alias("high"), F.collect_list(F.struct(F.col("obs_id").alias("i"))).alias("obs_id"), *[F.collect_list(a).alias(a) for a in "xyz"]))

    def rows(r, names, sums):
        out = pd.DataFrame({"obs_id": [x["i"] for x in r["obs_id"]]})
        for c, value in zip(by, names, strict=True):
            out[c] = [value] * len(out)
        return out.assign(response=sums)

    def far(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                o, found = np.stack([r[a] for a in "xyz"], axis=1), {}
                for m in r["ms"]:
                    name = tuple(m[c] for c in by)
                    sums = found.setdefault(name, np.zeros(len(o)))
                    if len(m["q"]):
                        at = distant(o, m["centre"], m["half"])
                        sums[at] += Moments(m["centre"], m["half"], m["counts"], m["q"]).at(o[at])
                lost = np.isnan(o).any(axis=1)  # comes out as null, as no sum reaches it
                for name, sums in found.items():
                    yield rows(r, name, np.where(lost, np.nan, sums))

    def near(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                o = np.stack([r[a] for a in "xyz"], axis=1)
                at = ~distant(o, r["centre"], r["half"]) if r["thin"] else np.ones(len(o), bool)
                sums = np.zeros(len(o))
                sums[at] = near_sums(o[at], np.asarray(r["corner"], float).reshape(-1, 3, 3), np.asarray(r["w"], float), direct)
                yield rows(r, [r[c] for c in by], sums)

    groups = max(1, -(-blocks.count() // _GROUP))
    packed = blocks.groupBy(F.pmod(F.xxhash64("b"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct(*by, "centre", "half", "counts", "q")).alias("ms"))
    every = stations.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(packed, "g")
    first = every.select("obs_id", *"xyz", "ms").repartition(min(10_000, groups * chunks)).mapInPandas(far, schema)

    # no station of a chunk is nearer to a block than their boxes are; boxes without an end are near to all
    thin = F.size("q") > 0
    boxes = blocks.select("b", thin.alias("thin"), "centre", "half")
    gap = [F.greatest(F.element_at("low", i) - F.element_at("centre", i) - F.element_at("half", i), F.element_at("centre", i) - F.element_at("half", i) - F.element_at("high", i), F.lit(0.0)) for i in (1, 2, 3)]
    reach = _REACH * F.array_max("half")
    apart = F.sqrt(sum((F.pow(x, 2) for x in gap), F.lit(0.0)))
    ends = F.forall(F.concat("low", "high"), lambda x: ~F.isnan(x))
    numbers = stations.agg(F.max("c")).first()[0] or 0
    each = boxes.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(numbers))))
    pairs = each.join(stations.select("c", "low", "high"), "c").filter(~F.col("thin") | ~ends | (apart < reach * (1 + 1e-9))).select("c", "b", "thin")
    held = pairs.join(stations.drop("low", "high"), "c").join(blocks.drop("counts", "q"), "b")
    last = held.repartition(min(10_000, max(1, pairs.count()))).mapInPandas(near, schema)
    return first.unionByName(last).groupBy("obs_id", *by).agg(F.sum("response").alias("response")).withColumnsRenamed(given)
