"""Gravity of meshed models as a function of shared degrees of freedom, with its gradient.

Coincident vertices share one degree of freedom per axis they may move along, so a contact
between two bodies moves as one. The wiring (which corner coordinate follows which degree of
freedom) is found once by joins on lattice keys and written down; every evaluation afterwards is
a single pass of facets past the broadcast parameters and stations, summed before the shuffle.
The derivative by a degree of freedom is the chain rule as one aggregation: derivatives of the
misfit by the nine coordinates of every facet, summed over the coordinates that follow it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators import forward as fw
from terralith.operators import mesh
from terralith.operators.storage import discard, stored_at

#: Stations and degrees of freedom that are broadcast (24 and 8 bytes each); counted first.
MOST_STATIONS = 1_000_000
MOST_DOFS = 10_000_000
#: Pairs of stations and facets whose kernels are held at once.
_PAIRS = 16_384


def _weighed(weights: np.ndarray, o: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Sums over stations ``o`` (n, 3) of ``weights`` times the gravity factor of facets ``corner`` (m, 3, 3), by facet."""
    at = [[np.ascontiguousarray(corner[:, i, a])[None] for a in range(3)] for i in range(3)]
    out, step = np.zeros(len(corner)), max(1, _PAIRS // max(1, len(corner)))
    for low in range(0, len(o), step):
        out += weights[low : low + step] @ fw.pair_terms("gravity", [np.ascontiguousarray(x)[:, None] for x in o[low : low + step].T], at)
    return out


def vertex_dofs(vertices: DataFrame) -> DataFrame:
    """(mesh_id, v_id, axis, dof, value): the degree of freedom of every vertex and axis it may move along.

    vertices: mesh_id, v_id, x, y, z, freedom. Vertices at one lattice place share degrees of
    freedom, numbered from 0 by first appearance; ``value`` is the coordinate.
    """
    place = [mesh.lattice(F.col(c)).alias(f"q{c}") for c in "xyz"]
    rows = mesh.dof_rows(vertices.filter(F.col("freedom") != "ALONG_VECTOR")).select("mesh_id", "v_id", "axis", *place, *[F.col(c) for c in "xyz"])
    firsts = rows.groupBy("qx", "qy", "qz", "axis").agg(F.min(F.struct("mesh_id", "v_id", "axis")).alias("first"))
    numbered = mesh.dense_number(firsts, ["first"], "dof").select("qx", "qy", "qz", "axis", "dof")
    value = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    return rows.withColumn("value", value).join(numbered, ["qx", "qy", "qz", "axis"]).select("mesh_id", "v_id", "axis", "dof", "value")


@dataclass
class MeshField:
    """Gravity response of a meshed model over its degrees of freedom.

    ``wired``: group_id, t_id, nine base coordinates and nine degrees of freedom (-1 where a
    coordinate is held). ``start``: values of the degrees of freedom. ``stations`` and ``obs_id``
    (whole numbers, ascending) are in the order of the arrays that ``response`` gives.
    """

    wired: DataFrame
    dofs: DataFrame
    start: np.ndarray
    stations: np.ndarray
    obs_id: np.ndarray
    paths: list[str]

    @classmethod
    def build(cls, vertices: DataFrame, triangles: DataFrame, stations: DataFrame) -> MeshField:
        """vertices: mesh_id, v_id, x, y, z, freedom; triangles: mesh_id, t_id, v0..v2; the mesh is the group."""
        dofs, path = stored_at(vertex_dofs(vertices))
        n = dofs.agg((F.coalesce(F.max("dof"), F.lit(-1)) + 1).alias("n")).first()["n"]
        if n > MOST_DOFS:
            raise ValueError(f"at most {MOST_DOFS} degrees of freedom, not {n}")
        m = stations.count()
        if m > MOST_STATIONS:
            raise ValueError(f"at most {MOST_STATIONS} stations in one field, not {m}")
        start = np.zeros(n)
        values = dofs.groupBy("dof").agg(F.min("value").alias("value")).toPandas()
        start[values["dof"].to_numpy()] = values["value"].to_numpy()
        place = F.max(F.when(F.col("axis") == "x", F.col("dof"))).alias("kx"), F.max(F.when(F.col("axis") == "y", F.col("dof"))).alias("ky"), F.max(F.when(F.col("axis") == "z", F.col("dof"))).alias("kz")
        own = vertices.select("mesh_id", "v_id", "x", "y", "z").join(dofs.groupBy("mesh_id", "v_id").agg(*place), ["mesh_id", "v_id"], "left")
        out = triangles.select("mesh_id", "t_id", "v0", "v1", "v2")
        for i, c in enumerate("pqr"):
            follows = [F.coalesce(f"k{a}", F.lit(-1)).cast("long").alias(f"k_{c}{a}") for a in "xyz"]
            out = out.join(own.select("mesh_id", F.col("v_id").alias(f"v{i}"), *[F.col(a).cast("double").alias(f"{c}{a}") for a in "xyz"], *follows), ["mesh_id", f"v{i}"])
        wired, other = stored_at(out.select(F.col("mesh_id").alias("group_id"), "t_id", *fw.CORNERS, *[f"k_{c}" for c in fw.CORNERS]))
        rows = stations.select(F.col("obs_id").cast("long"), "x", "y", "z").orderBy("obs_id").toPandas()
        return cls(wired, dofs, start, rows[["x", "y", "z"]].to_numpy(float), rows["obs_id"].to_numpy(np.int64), [path, other])

    def _pass(self, parameters: np.ndarray, work, schema: str) -> DataFrame:
        """``work(o, corner, group, follows)`` over every block of facets with its corners at ``parameters``."""
        held = self.wired.sparkSession.sparkContext.broadcast((np.asarray(parameters, float), self.stations))

        def run(batches):
            p, o = held.value
            for pdf in batches:
                follows = pdf[[f"k_{c}" for c in fw.CORNERS]].to_numpy(np.int64)
                at = pdf[fw.CORNERS].to_numpy(float)
                at = np.where(follows >= 0, p[np.maximum(follows, 0)] if len(p) else at, at)
                if len(pdf):
                    yield from work(o, at.reshape(-1, 3, 3), pdf["group_id"].to_numpy(), follows)

        return self.wired.mapInPandas(run, schema)

    def units(self, parameters: np.ndarray) -> DataFrame:
        """(obs_id, group_id, u): response of each group to 1 g/cc."""
        ids = self.obs_id

        def work(o, corner, group, _):
            for name in np.unique(group):
                own = corner[group == name]
                yield pd.DataFrame({"obs_id": ids, "group_id": name, "u": fw.summed("gravity", o, own, None, None, np.full((len(own), 1), g.G_MGAL))[:, 0]})

        kind = dict(self.wired.dtypes)["group_id"]
        return self._pass(parameters, work, f"obs_id long, group_id {kind}, u double").groupBy("obs_id", "group_id").agg(F.sum("u").alias("u"))

    def response(self, parameters: np.ndarray, density: dict) -> np.ndarray:
        """mGal at every station; ``density`` by group, 0 for groups without one."""

        def work(o, corner, group, _):
            w = np.array([density.get(x, 0.0) for x in group.tolist()]) * g.G_MGAL
            yield pd.DataFrame({"station": np.arange(len(o)), "r": fw.summed("gravity", o, corner, None, None, w[:, None])[:, 0]})

        found = self._pass(parameters, work, "station long, r double").groupBy("station").agg(F.sum("r").alias("r")).toPandas()
        out = np.zeros(len(self.stations))
        out[found["station"].to_numpy()] = found["r"].to_numpy()
        return out

    def pulled_back(self, parameters: np.ndarray, density: dict, weights: np.ndarray, step: float = 1e-4) -> np.ndarray:
        """Derivative by every degree of freedom of the sum of ``weights`` times the response.

        Nine forward differences a facet, weighted and summed over stations inside the task, then
        summed over the facets and corners that follow each degree of freedom.
        """

        def work(o, corner, group, follows):
            w = np.array([density.get(x, 0.0) for x in group.tolist()]) * g.G_MGAL
            base = _weighed(weights, o, corner)
            slope = np.zeros((len(corner), 9))
            for j in range(9):
                if (follows[:, j] >= 0).any():
                    moved = corner.copy().reshape(-1, 9)
                    moved[:, j] += step
                    slope[:, j] = (_weighed(weights, o, moved.reshape(-1, 3, 3)) - base) / step
            held = follows >= 0
            dof, at = np.unique(follows[held], return_inverse=True)
            yield pd.DataFrame({"dof": dof, "d": np.bincount(at, (slope * w[:, None])[held], len(dof))})

        found = self._pass(parameters, work, "dof long, d double").groupBy("dof").agg(F.sum("d").alias("d")).toPandas()
        out = np.zeros(len(self.start))
        out[found["dof"].to_numpy()] = found["d"].to_numpy()
        return out

    def vertices(self, vertices: DataFrame, parameters: np.ndarray) -> DataFrame:
        """``vertices`` with the coordinates that the parameters give them."""
        spark = vertices.sparkSession
        values = spark.createDataFrame(pd.DataFrame({"dof": np.arange(len(parameters)), "to": np.asarray(parameters, float)}), "dof long, to double")
        moved = self.dofs.join(values, "dof").groupBy("mesh_id", "v_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("to"))).alias(f"__{a}") for a in "xyz"])
        out = vertices.join(moved, ["mesh_id", "v_id"], "left")
        return out.withColumns({a: F.coalesce(f"__{a}", F.col(a)) for a in "xyz"}).drop("__x", "__y", "__z")

    def release(self) -> None:
        """Remove the written tables; the field cannot be evaluated afterwards."""
        for path in self.paths:
            discard(self.wired.sparkSession, path)


@dataclass
class Misfit:
    """Half the squared weighted misfit of a field, per datum, over scaled parameters.

    Parameters are (value - start) / ``scale``, so that a step of one is a sensible first move.
    """

    field: MeshField
    observed: np.ndarray
    std: np.ndarray
    density: dict
    scale: float = 10.0
    _last: tuple[bytes, np.ndarray] | None = None

    def at(self, x: np.ndarray) -> np.ndarray:
        return self.field.start + self.scale * np.asarray(x, float)

    def residual(self, x: np.ndarray) -> np.ndarray:
        key = np.asarray(x, float).tobytes()
        if self._last is None or self._last[0] != key:
            self._last = key, (self.field.response(self.at(x), self.density) - self.observed) / self.std
        return self._last[1]

    def value(self, x: np.ndarray) -> float:
        r = self.residual(x)
        return float(r @ r) / (2 * len(r))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        r = self.residual(x)
        return self.field.pulled_back(self.at(x), self.density, r / self.std) * (self.scale / len(r))
