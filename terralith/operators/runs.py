"""Parts of an inversion run on whole models: Jacobians, property solves, constraints, the loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators import forward as fw
from terralith.operators import inversion as inv
from terralith.operators import locate, mesh, model
from terralith.operators.meshfield import MeshField, Misfit
from terralith.operators.storage import discard, stored_at


def central_jacobian(response: Callable[[DataFrame], DataFrame], dofs: DataFrame, step: float) -> DataFrame:
    """(obs_id, dof, j): central differences of any forward model, all parameters in one job.

    ``response`` maps moves(dof, sign, delta) to (dof, sign, obs_id, response), the response of
    whatever a move changes; what it leaves alone cancels and may be left out.
    """
    moves = dofs.select("dof", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign")).withColumn("delta", F.col("sign") * step)
    both = response(moves)
    return both.groupBy("obs_id", "dof").agg((F.sum(F.col("sign") * F.col("response")) / (2.0 * step)).alias("j"))


def unit_magnetics(stations: DataFrame, facets: DataFrame, inclination: float, declination: float, field_nt: float, mode: str = "effective") -> DataFrame:
    """(obs_id, group_id, part, u): nT for one unit of each magnetic property of each group.

    Parts: 'chi' (SI); with mode 'fixed_vector' also 'm' (A/m along the field); with 'vector'
    'mx', 'my' and 'mz' instead. facets: group_id and corners.
    """
    chi = fw.total_field(stations, facets, inclination, declination, field_nt, ["group_id"], susceptibility=F.lit(1.0))
    out = [chi.withColumn("part", F.lit("chi"))]
    i, d = np.radians(inclination), np.radians(declination)
    along = {"effective": {}, "fixed_vector": {"m": (np.cos(i) * np.cos(d), np.cos(i) * np.sin(d), -np.sin(i))}, "vector": {"mx": (1, 0, 0), "my": (0, 1, 0), "mz": (0, 0, 1)}}
    for part, unit in along[mode].items():
        ready = facets.withColumns({c: F.lit(float(x)) for c, x in zip(("mx", "my", "mz"), unit, strict=True)})
        out.append(fw.total_field(stations, ready, inclination, declination, field_nt, ["group_id"], mode="vector", susceptibility=F.lit(0.0)).withColumn("part", F.lit(part)))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.withColumnRenamed("response", "u")


def solve_properties(units: DataFrame, data: DataFrame, start: dict, lower: dict, upper: dict, damping: float = 0.0) -> dict:
    """Properties by bounded least squares: {(group, part): value}.

    units: obs_id, group_id, part, u; data: obs_id, value, std. The misfit is divided by the
    mean square of the data (1 at least), and ``damping`` pulls towards the start. ``start``,
    ``lower`` and ``upper`` are by part. Sums run in Spark; the driver solves one dense system
    whose size is checked first.
    """
    size = float(data.agg(F.avg(F.col("value") * F.col("value"))).first()[0] or 0.0)
    keyed = units.select("obs_id", F.struct("group_id", "part").alias("group_id"), "u")
    names, a, rhs = inv.normal_equations(keyed, data)
    of = lambda table_: np.array([float(table_[n["part"]]) for n in names])
    scale = max(size, 1.0)
    x = inv.bounded_least_squares(a / scale, rhs / scale, of(start), of(lower), of(upper), damping)
    return {(n["group_id"], n["part"]): float(v) for n, v in zip(names, x, strict=True)}


def solve_conductivities(pairs: DataFrame, data: DataFrame, start: float, lower: float, upper: float, rounds: int = 30) -> dict:
    """{group: conductivity} whose summed decays fit the data, by bounded Gauss-Newton steps on the logarithms.

    pairs: obs_id, group_id, time, distance; data: obs_id, value, std. A round is two
    aggregations: the predicted responses, and the normal equations of their derivatives by the
    logarithm of each conductivity (central differences of the closed response). A step that
    does not lower the misfit is halved; the driver holds one value a group.
    """
    names = sorted(r[0] for r in pairs.select("group_id").distinct().collect())
    x = dict.fromkeys(names, float(np.log(start)))

    def at(values: dict, shift: float = 0.0) -> Column:
        log = F.element_at(F.create_map(*[c for n, v in values.items() for c in (F.lit(n), F.lit(float(v)))]), F.col("group_id"))
        return g.active_response(F.exp(log + shift), F.col("time"), F.col("distance"))

    def residual(values: dict) -> DataFrame:
        rows = pairs.withColumn("r", at(values)).groupBy("obs_id").agg(F.sum("r").alias("r")).join(data, "obs_id")
        return rows.select("obs_id", (F.col("value") - F.col("r")).alias("value"), "std")

    def misfit(values: dict) -> float:
        scaled = F.col("value") / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
        return float(residual(values).agg(F.sum(scaled * scaled)).first()[0])

    now, step = misfit(x), 1e-4
    for _ in range(rounds):
        slopes = pairs.select("obs_id", "group_id", ((at(x, step) - at(x, -step)) / (2 * step)).alias("u"))
        order, a, b = inv.normal_equations(slopes, residual(x))
        zero = np.zeros(len(order))
        low, high = (np.array([np.log(v) - x[n] for n in order]) for v in (lower, upper))
        move = inv.bounded_least_squares(a, b, zero, low, high)
        length, better = 1.0, None
        while length > 1e-4:
            trial = {n: x[n] + length * float(m) for n, m in zip(order, move, strict=True)}
            got = misfit(trial)
            if got <= now:
                better = trial
                break
            length /= 2
        if better is None:
            break
        done = max(abs(better[n] - x[n]) for n in order) < 1e-6
        x, now = better, got
        if done:
            break
    return {n: float(np.exp(v)) for n, v in x.items()}


def constraint_midpoints(constraints: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points (obs_id, x, y, z, thickness, expected, *by) of constraints, depths positive downwards."""
    return constraints.select(
        "obs_id", "x", "y", (-(F.col("z_top") + F.col("z_bottom")) / 2.0).alias("z"),
        F.abs(F.col("z_bottom") - F.col("z_top")).alias("thickness"), F.col("litho_group_id").alias("expected"), *(by or []),
    )


def constraint_penalty(constraints: DataFrame, facets: DataFrame, omega: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(*by, penalty): omega times the summed squared thickness of intervals in another group.

    The middle of each interval is classified in the model; ``by`` are columns of constraints
    and facets that tell model variants apart. Intervals outside every group are summed where
    they lie; only those inside one move.
    """
    by = by or []
    points = constraint_midpoints(constraints, by)
    total = _wrong(points, F.lit(-1), by).unionByName(_corrections(points, facets, by))
    return _penalties(total, omega, by)


def constraint_gradient(constraints: DataFrame, moved: Callable[[DataFrame], DataFrame], dofs: DataFrame, step: float = 1.0, omega: float = 1.0, compat_double_omega: bool = False) -> DataFrame:
    """(dof, gradient) of ``constraint_penalty`` by central differences, all variants in one job.

    ``moved`` maps moves(variant, dof, delta) to the facets of each variant of the model.
    Constraints are not repeated for the variants: each meets the facets of all of them.
    ``compat_double_omega`` multiplies by omega again, as older results did.
    """
    moves = dofs.select("dof", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign"))
    moves = moves.select(F.concat_ws("/", "dof", "sign").alias("variant"), "dof", "sign", (F.col("sign") * step).alias("delta"))
    points = constraint_midpoints(constraints)
    outside = _wrong(points, F.lit(-1), []).crossJoin(F.broadcast(moves.select("variant")))
    found = _penalties(outside.unionByName(_corrections(points, moved(moves), ["variant"])), omega, ["variant"])
    k = omega if compat_double_omega else 1.0
    both = moves.join(found, "variant", "left").withColumn("p", F.coalesce("penalty", F.lit(0.0)))
    return both.groupBy("dof").agg((k * F.sum(F.col("sign") * F.col("p")) / (2.0 * step)).alias("gradient"))


def _wrong(points: DataFrame, group: Column, by: list[str], less: Column | None = None) -> DataFrame:
    """(*by, s, n): summed squared thickness and number of points expected elsewhere than in ``group``, less those elsewhere than in ``less``."""
    sums = []
    for name, one in (("s", F.pow("thickness", 2)), ("n", F.lit(1))):
        term = lambda g, one=one: F.when(g != F.col("expected"), one).otherwise(0)
        sums.append(F.sum(term(group) if less is None else term(group) - term(less)).alias(name))
    return points.groupBy(*by).agg(*sums) if by else points.agg(*sums)


def _corrections(points: DataFrame, facets: DataFrame, by: list[str]) -> DataFrame:
    """What ``_wrong`` changes for the points that lie in a group."""
    inside = locate.holders(points, facets, by, ["thickness", "expected"])
    return _wrong(inside, F.col("group_id"), by, F.lit(-1))


def _penalties(parts: DataFrame, omega: float, by: list[str]) -> DataFrame:
    total = (omega * F.coalesce(F.sum("s"), F.lit(0.0))).alias("penalty")
    if not by:
        return parts.agg(total)
    return parts.groupBy(*by).agg(total, F.sum("n").alias("__n")).filter("__n > 0").drop("__n")


def vertex_overlaps(vertices: DataFrame, facets: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``model.overlap_counts`` of vertices(group_id, v_id, x, y, z) classified in facets(group_id, ...)."""
    key = F.struct("group_id", "v_id")
    found = locate.classify(vertices.select(key.alias("obs_id"), "x", "y", "z"), facets)
    return model.overlap_counts(found.select(F.col("obs_id.group_id").alias("group_id"), F.col("group_id").alias("found")), baseline)


def gate(start: DataFrame, now: DataFrame, edges: DataFrame, facets: DataFrame, baseline: DataFrame | None = None, adjacent_more: int = 20, distant_more: int = 120) -> DataFrame:
    """(place, check, passed, worst): the six checks of a moved model, in the order they count.

    Beside the three of ``model.validate``: vertices in an adjacent group, in another foreign
    group (each less its baseline, against a fixed allowance), and tearing (vertices that are
    not free in all directions and share a place to 0.1 mm lie within 0.1 of each other).
    start/now: mesh_id, v_id, x, y, z, now with freedom; facets: group_id (the mesh) and corners.
    """
    three = model.validate(start, now, edges, margin=0.02)
    counts = vertex_overlaps(now.withColumnRenamed("mesh_id", "group_id"), facets, baseline)
    rows = F.array(
        F.struct(F.lit("adjacent_overlap").alias("check"), (F.col("adjacent") <= adjacent_more).alias("passed"), F.col("adjacent").cast("double").alias("worst")),
        F.struct(F.lit("distant_overlap").alias("check"), (F.col("distant") <= distant_more).alias("passed"), F.col("distant").cast("double").alias("worst")),
    )
    overlaps = counts.select(F.explode(rows).alias("r")).select("r.*")
    held = now.filter(F.col("freedom") != "XYZ_FREE").withColumns({f"q{c}": mesh.lattice(F.col(c), 1e4) for c in "xyz"})
    torn = held.groupBy("qx", "qy", "qz").agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("g")).agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("worst"))
    torn = torn.select(F.lit("tearing").alias("check"), (F.col("worst") <= 0.1).alias("passed"), "worst")
    order = ["shared_gap", "adjacent_overlap", "distant_overlap", "tearing", "bounding_box", "spikes"]
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("check")).cast("int")
    return three.unionByName(overlaps).unionByName(torn).select(place.alias("place"), "check", "passed", "worst")


@dataclass
class Finished:
    """A model ready for inversion: freedom of every vertex, its box, and the depth it ends at."""

    freedom: DataFrame
    bounds: DataFrame
    bottom: float | None


def finalise(vertices: DataFrame, facets: DataFrame, freedom: str = "XYZ_FREE", margin: float = 1.0) -> Finished:
    """Freedom from exterior faces, bounds from the model's box, bottom 100 under its lowest vertex.

    vertices: mesh_id, v_id, x, y, z; facets: mesh_id, t_id, v0..v2 and corners.
    """
    votes = mesh.exterior_votes(facets)
    classes = vertices.select("mesh_id", "v_id").join(mesh.exterior_freedom(votes, freedom), ["mesh_id", "v_id"], "left")
    lowest = vertices.agg(F.min("z")).first()[0]
    return Finished(classes.select("mesh_id", "v_id", F.coalesce("freedom", F.lit(freedom)).alias("freedom")), mesh.model_bounds(vertices, margin), None if lowest is None else lowest - 100.0)


def apply_parameters(vertices: DataFrame, parameters: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """vertices(mesh_id, v_id, x, y, z, freedom[, dx, dy, dz]) moved to parameters(mesh_id, v_id, axis, value).

    An axis takes its value times the axis's scale. Vertices of freedom ALONG_VECTOR (axis 'v')
    move along their direction until their projection on it has the value; a direction without
    length moves nothing.
    """
    scales = scales or {}
    wide = parameters.groupBy("mesh_id", "v_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(f"__{a}") for a in "xyzv"])
    out = vertices.join(wide, ["mesh_id", "v_id"], "left")
    moved = {a: F.coalesce(F.col(f"__{a}") * scales.get(a, 1.0), F.col(a)) for a in "xyz"}
    if "dx" in vertices.columns:
        unit, along = _direction()
        shift = F.col("__v") - along
        vector = (F.col("freedom") == "ALONG_VECTOR") & F.col("__v").isNotNull() & unit[0].isNotNull()
        moved = {a: F.when(vector, F.col(a) + shift * u).otherwise(moved[a]) for a, u in zip("xyz", unit, strict=True)}
    return out.withColumns(moved).drop(*[f"__{a}" for a in "xyzv"])


def extract_parameters(vertices: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """(mesh_id, v_id, axis, value): the parameters that ``apply_parameters`` takes."""
    scales = scales or {}
    rows = mesh.dof_rows(vertices.filter(F.col("freedom") != "ALONG_VECTOR"))
    value = F.when(F.col("axis") == "x", F.col("x") / scales.get("x", 1.0)).when(F.col("axis") == "y", F.col("y") / scales.get("y", 1.0)).otherwise(F.col("z") / scales.get("z", 1.0))
    out = rows.select("mesh_id", "v_id", "axis", value.alias("value"))
    if "dx" not in vertices.columns:
        return out
    unit, along = _direction()
    vectors = vertices.filter((F.col("freedom") == "ALONG_VECTOR") & unit[0].isNotNull())
    return out.unionByName(vectors.select("mesh_id", "v_id", F.lit("v").alias("axis"), along.alias("value")))


def _direction() -> tuple[list[Column], Column]:
    size = F.sqrt(sum((F.pow(F.col(f"d{a}"), 2) for a in "xyz"), F.lit(0.0)))
    unit = [F.when(size > 0, F.col(f"d{a}") / size) for a in "xyz"]
    return unit, sum((F.col(a) * u for a, u in zip("xyz", unit, strict=True)), F.lit(0.0))


def observation_grid(spark, n: int, half: float, cell: float, std: float = 0.01) -> DataFrame:
    """n x n stations at z = 0 from (-half, -half), row by row: obs_id, x, y, z, value 0, std."""
    rows = spark.range(n * n)
    return rows.select(
        F.col("id").alias("obs_id"), ((F.col("id") % n) * cell - half).alias("x"), (F.floor(F.col("id") / n) * cell - half).alias("y"),
        F.lit(0.0).alias("z"), F.lit(0.0).alias("value"), F.lit(std).alias("std"),
    )


@dataclass
class Alternating:
    """Geometry descent and property solves in turn, with a validation gate between them.

    ``minimise(parameters, properties, rounds)`` gives (parameters, iterations, converged);
    ``valid(parameters)`` tells whether the model holds; ``solve(parameters, properties)`` gives
    new properties, or is None. A geometry step that breaks the model is halved up to
    ``retries`` times and then dropped. The driver holds parameter vectors only.
    """

    minimise: Callable[[np.ndarray, dict, int], tuple[np.ndarray, int, bool]] | None
    valid: Callable[[np.ndarray], bool]
    solve: Callable[[np.ndarray, dict], dict] | None = None
    most: int = 100
    interval: int = 10
    retries: int = 5
    log: list[dict] = field(default_factory=list)

    def accepted(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray | None, int]:
        """The longest of the step's halvings that the model survives, and how often it was halved."""
        for halved in range(self.retries + 1):
            trial = before + (after - before) / 2**halved
            if self.valid(trial):
                return trial, halved
        return None, self.retries + 1

    def run(self, parameters: np.ndarray, properties: dict) -> tuple[np.ndarray, dict]:
        done, phases = 0, 0
        while done < self.most and phases < 3 * self.most:
            phases += 1
            converged, row = True, {"phase": phases, "iterations": 0, "halved": 0, "accepted": True}
            if self.minimise:
                new, iterations, converged = self.minimise(parameters, properties, min(self.interval, self.most - done))
                kept, halved = self.accepted(parameters, new)
                row |= {"iterations": iterations, "halved": halved, "accepted": kept is not None}
                if kept is not None:
                    parameters, done = kept, done + iterations
                if iterations == 0:
                    self.log.append(row)
                    break
                converged = converged and kept is not None
            if self.solve and done < self.most:
                before, properties = properties, self.solve(parameters, properties)
                # new properties give the geometry a new target, unless there is no geometry; a dropped
                # step with the properties it had before would only be tried again
                same = all(abs(properties[k] - before.get(k, np.inf)) <= 1e-12 for k in properties)
                converged = self.minimise is None or (not row["accepted"] and same)
            self.log.append(row | {"parameters": parameters.tolist()})
            if converged:
                break
        return parameters, properties


@dataclass
class Inverted:
    """A finished run over a meshed model: parameters and densities, the loop's log, the field."""

    parameters: np.ndarray
    density: dict
    log: list[dict]
    field: MeshField


def invert_mesh(vertices: DataFrame, triangles: DataFrame, data: DataFrame, density: dict, lower: float, upper: float, reach: float,
                most: int = 40, interval: int = 10, margin_gate: Callable[[DataFrame], bool] | None = None, scale: float = 10.0, memory: int = 20, gate_options: dict | None = None) -> Inverted:
    """Geometry and densities of closed meshes from gravity, in turn, every step behind ``gate``.

    vertices: mesh_id, v_id, x, y, z, freedom; triangles: mesh_id, t_id, v0..v2; data: obs_id
    (whole numbers), x, y, z, value, std. Degrees of freedom may leave the start by ``reach``,
    densities lie between ``lower`` and ``upper``. ``margin_gate`` replaces the six checks of
    ``gate`` by a check of one's own on the moved vertices.
    """
    field_ = MeshField.build(vertices, triangles, data)
    rows = data.select(F.col("obs_id").cast("long"), "value", "std").orderBy("obs_id").toPandas()
    observed, std = rows["value"].to_numpy(float), np.where(rows["std"].to_numpy(float) > 0, rows["std"].to_numpy(float), 1.0)
    edges = mesh.undirected_edges(triangles, ["mesh_id"])
    options = gate_options or {}

    def facets(moved: DataFrame) -> DataFrame:
        return fw.mesh_facets(moved.select("mesh_id", "v_id", "x", "y", "z"), triangles, ["mesh_id"]).withColumnRenamed("mesh_id", "group_id")

    spark = vertices.sparkSession
    first = None
    if margin_gate is None:
        edges, kept = stored_at(edges)
        field_.paths.append(kept)
        counts = vertex_overlaps(vertices.withColumnRenamed("mesh_id", "group_id"), facets(vertices))
        first = spark.createDataFrame(counts.collect(), counts.schema)

    def valid(x: np.ndarray) -> bool:
        moved, kept = stored_at(field_.vertices(vertices, field_.start + scale * x))
        if margin_gate is not None:
            held = margin_gate(moved)
        else:
            now, also = stored_at(facets(moved))
            checks = gate(vertices.select("mesh_id", "v_id", "x", "y", "z"), moved, edges, now, first, **options)
            held = bool(checks.agg(F.bool_and("passed")).first()[0])
            discard(spark, also)
        discard(spark, kept)
        return held

    def minimise(x: np.ndarray, properties: dict, rounds: int) -> tuple[np.ndarray, int, bool]:
        misfit = Misfit(field_, observed, std, properties, scale)
        wide = np.full(len(x), reach / scale)
        descent = inv.Bounded(misfit.value, misfit.gradient, -wide, wide, memory=memory, rounds=rounds)
        new = descent.minimise(x)
        done = len(descent.history)
        return new, done, done < rounds

    def solve(x: np.ndarray, properties: dict) -> dict:
        units = field_.units(field_.start + scale * x).withColumn("part", F.lit("density"))
        mean = float(np.mean(list(properties.values())))
        found = solve_properties(units, data.select(F.col("obs_id").cast("long"), "value", "std"), {"density": mean}, {"density": lower}, {"density": upper})
        return {name: value for (name, _), value in found.items()}

    loop = Alternating(minimise, valid, solve, most=most, interval=interval)
    start = np.zeros(len(field_.start))
    x, properties = loop.run(start, solve(start, density))
    return Inverted(field_.start + scale * x, properties, loop.log, field_)
