"""Bounded optimisation with Spark aggregations: the driver holds vectors of parameters only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most columns of a normal matrix that is solved on the driver.
MAX_PARAMETERS = 2000


def smooth_gradient(gradient: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """(v_id, g): gradient moved by ``share`` towards its neighbours' mean."""
    around = edges.join(gradient.select(F.col("v_id").alias("b"), F.col("g").alias("other")), "b").groupBy(F.col("a").alias("v_id")).agg(F.avg("other").alias("m"))
    return gradient.join(around, "v_id", "left").select("v_id", F.when(F.col("m").isNull(), F.col("g")).otherwise((1 - share) * F.col("g") + share * F.col("m")).alias("g"))


def reference_penalty(parameters: DataFrame, weight: float) -> DataFrame:
    """Half the weighted squared distance of parameters(dof_id, p) from p0, one row."""
    return parameters.agg(F.sum(0.5 * weight * F.pow(F.col("p") - F.col("p0"), 2)).alias("penalty"), F.sqrt(F.sum(F.pow(weight * (F.col("p") - F.col("p0")), 2))).alias("gradient_norm"))


def normal_equations(responses: DataFrame, data: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """(groups, U'W2U, U'W2d) of responses(obs_id, group_id, u) and data(obs_id, value, std).

    One self-join by observation and one aggregation; the result has groups squared rows. The
    number of groups is counted first and may not exceed ``MAX_PARAMETERS``.
    """
    if responses.select("group_id").distinct().count() > MAX_PARAMETERS:
        raise ValueError(f"at most {MAX_PARAMETERS} groups are solved on the driver")
    w2 = F.when(F.col("std") > 0, 1.0 / (F.col("std") * F.col("std"))).otherwise(1.0)
    rows = responses.join(data.select("obs_id", "value", w2.alias("w2")), "obs_id")
    packed = rows.groupBy("obs_id", "value", "w2").agg(F.collect_list(F.struct("group_id", "u")).alias("us"))
    pairs = packed.select("value", "w2", F.explode("us").alias("i"), "us").select("value", "w2", "i", F.explode("us").alias("j"))
    cross = pairs.groupBy(F.col("i.group_id").alias("i"), F.col("j.group_id").alias("j")).agg(F.sum(F.col("w2") * F.col("i.u") * F.col("j.u")).alias("a"), F.sum(F.col("w2") * F.col("i.u") * F.col("value")).alias("b"))
    found = cross.collect()
    names = sorted({r["i"] for r in found})
    at = {n: k for k, n in enumerate(names)}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in found:
        a[at[r["i"]], at[r["j"]]] = r["a"]
        b[at[r["i"]]] = r["b"]
    return names, a, b


def misfit_gradients(responses: DataFrame, data: DataFrame, names: list, points: list[np.ndarray]) -> tuple[list[float], list[np.ndarray]]:
    """Half the weighted squared misfit and its gradient by group at every one of ``points``, in one job.

    responses(obs_id, group_id, u) are linear in the groups' values; data: obs_id, value, std.
    One aggregation forms the residual of each point at each observation, the other carries it
    back to the groups; the driver gets a row for each point and group.
    """
    at = F.create_map(*[c for j, n in enumerate(names) for c in (F.lit(n), F.array(*[F.lit(float(p[j])) for p in points]))])
    w2 = F.when(F.col("std") > 0, 1.0 / (F.col("std") * F.col("std"))).otherwise(1.0)
    values = F.element_at(at, F.col("group_id"))
    sums = responses.groupBy("obs_id").agg(*[F.sum(F.col("u") * values[i]).alias(f"p{i}") for i in range(len(points))]).join(data.select("obs_id", "value", w2.alias("w2")), "obs_id")
    wr = [(F.col("w2") * (F.col(f"p{i}") - F.col("value"))) for i in range(len(points))]
    residual = sums.select("obs_id", *[c.alias(f"r{i}") for i, c in enumerate(wr)], *[(c * (F.col(f"p{i}") - F.col("value")) / 2).alias(f"f{i}") for i, c in enumerate(wr)])
    first = F.row_number().over(Window.partitionBy("obs_id").orderBy("group_id")) == 1
    rows = responses.withColumn("first", first).join(residual, "obs_id")
    found = rows.groupBy("group_id").agg(*[F.sum(F.col("u") * F.col(f"r{i}")).alias(f"g{i}") for i in range(len(points))], *[F.sum(F.when(F.col("first"), F.col(f"f{i}")).otherwise(0.0)).alias(f"f{i}") for i in range(len(points))]).collect()
    by = {r["group_id"]: r for r in found}
    return [float(sum(r[f"f{i}"] for r in found)) for i in range(len(points))], [np.array([by[n][f"g{i}"] if n in by else 0.0 for n in names]) for i in range(len(points))]


def bounded_least_squares(a: np.ndarray, b: np.ndarray, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, damping: float = 0.0, rounds: int = 2000) -> np.ndarray:
    """Minimum of x'Ax/2 - b'x + damping |x - start|^2 / 2 within bounds.

    The unbounded solution where it lies within them, else by coordinate descent.
    """
    a = a + damping * np.eye(len(b))
    b = b + damping * start
    free = np.linalg.lstsq(a, b, rcond=None)[0] if len(b) else b
    if len(b) and np.linalg.matrix_rank(a) == len(b) and (free >= lower).all() and (free <= upper).all():
        return free
    x = np.clip(start, lower, upper)
    for _ in range(rounds):
        before = x.copy()
        for i in range(len(x)):
            if a[i, i] > 0:
                x[i] = np.clip(x[i] + (b[i] - a[i] @ x) / a[i, i], lower[i], upper[i])
        if np.abs(x - before).max() < 1e-12:
            break
    return x


def largest_eigenvalue(a: np.ndarray, rounds: int = 50, tolerance: float = 1e-8) -> float:
    """Power iteration from a fixed start."""
    x, value = np.ones(len(a)) / np.sqrt(len(a)), 0.0
    for _ in range(rounds):
        y = a @ x
        size = float(np.linalg.norm(y))
        if size == 0 or abs(size - value) < tolerance * max(1.0, size):
            return size
        x, value = y / size, size
    return value


def balance(first: np.ndarray, second: np.ndarray, gradients: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Weight of the second data set: ratio of largest eigenvalues, kept within 1e-6 and 1e6.

    Where that ratio is not positive and finite, the ratio of the norms of the two misfit
    ``gradients``; 1 where these vanish too or are not given.
    """
    top, low = largest_eigenvalue(first), largest_eigenvalue(second)
    ratio = top / low if low > 1e-60 else 0.0
    if np.isfinite(ratio) and ratio > 0:
        return float(np.clip(ratio, 1e-6, 1e6))
    one, two = (float(np.linalg.norm(g)) for g in gradients) if gradients else (0.0, 0.0)
    return one / two if one >= 1e-60 and two > 1e-60 else 1.0


class Bounded:
    """Projected limited-memory quasi-Newton descent.

    ``value`` and ``gradient`` are callables over a parameter vector (each one a Spark job or
    more). Stops when the projected gradient falls under ``tolerance`` times its first norm (of
    at least 1), when the step length is zero, after three steps under 1e-8, or after ``rounds``.
    """

    def __init__(self, value: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], lower: np.ndarray, upper: np.ndarray,
                 memory: int = 5, rounds: int = 50, tolerance: float = 1e-6, line_search: bool = True):
        self.value, self.gradient, self.lower, self.upper = value, gradient, lower, upper
        self.memory, self.rounds, self.tolerance, self.line_search = memory, rounds, tolerance, line_search
        self.history: list[dict] = []

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, self.lower, self.upper)

    def direction(self, g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Two-loop product of the inverse Hessian estimate with -g."""
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q = q - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q = q + s * (a - (y @ q) / (y @ s))
        return -q

    def step(self, x: np.ndarray, f: float, g: np.ndarray, d: np.ndarray) -> tuple[float, np.ndarray, float]:
        """Armijo backtracking along the projected direction: (length, point, value).

        A trial whose projected step does not go downhill is halved like one that rises. Length 0
        and the old point if no trial down to 1e-16 passes. Without line search the whole
        projected step is taken.
        """
        if not self.line_search:
            new = self.project(x + d)
            return 1.0, new, self.value(new)
        if g @ d >= 0:
            return 0.0, x, f
        length = 1.0
        while length > 1e-16:
            new = self.project(x + length * d)
            fall = g @ (new - x)
            if fall < 0:
                got = self.value(new)
                if got <= f + 1e-4 * fall:
                    return length, new, got
            length /= 2
        return 0.0, x, f

    def minimise(self, x: np.ndarray) -> np.ndarray:
        x = self.project(np.asarray(x, float))
        f, g = self.value(x), self.gradient(x)
        first = None
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        short = 0
        for k in range(self.rounds):
            size = float(np.linalg.norm(x - self.project(x - g)))
            first = size if first is None else first
            self.history.append({"iteration": k, "objective": f, "projected_gradient": size})
            if k and size < self.tolerance * max(1.0, first):
                break
            length, new, f_new = self.step(x, f, g, self.direction(g, pairs))
            if length == 0.0:
                if not pairs:
                    break
                pairs = []
                continue
            short = short + 1 if length < 1e-8 else 0
            if short >= 3:
                break
            g_new = self.gradient(new)
            s, y = new - x, g_new - g
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                pairs = [*pairs, (s, y)][-self.memory :]
            x, f, g = new, f_new, g_new
        return x


def newton_cg(value: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], x: np.ndarray, lower: np.ndarray, upper: np.ndarray,
              rounds: int = 20, inner: int = 20, step: float = 1e-4, gradients: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None) -> np.ndarray:
    """Gauss-Newton by conjugate gradients: Hessian products from central gradient differences.

    ``gradients`` gives the gradients at several points at once (one Spark job for both sides
    of a difference); by default they are asked for one by one.
    """
    many = gradients or (lambda points: [gradient(q) for q in points])
    x = np.clip(np.asarray(x, float), lower, upper)
    f = value(x)
    for _ in range(rounds):
        g = gradient(x)
        d, r = np.zeros_like(x), -g
        p, rr = r.copy(), float(r @ r)
        if rr < 1e-20:
            break
        for _ in range(inner):
            plus, minus = many([x + step * p, x - step * p])
            hp = (plus - minus) / (2 * step)
            curve = float(p @ hp)
            if curve <= 0:
                break
            a = rr / curve
            d, r = d + a * p, r - a * hp
            new = float(r @ r)
            if new < 1e-12 * rr:
                break
            p, rr = r + (new / rr) * p, new
        if not d.any():
            d = -g
        length = 1.0
        while length > 1e-10:
            new_x = np.clip(x + length * d, lower, upper)
            f_new = value(new_x)
            if f_new < f:
                break
            length /= 2
        else:
            break
        x, f = new_x, f_new
    return x


#: Bytes of a whole block of the sensitivity, and unknowns or data that the driver holds.
BLOCK_BYTES = 16 << 20
MOST_UNKNOWNS = 10_000_000
#: What a block may lose as a product of two thin matrices, as a share of its size: less than its own rounding errors.
_THIN = 1e-13


def thin(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Two matrices whose product is ``a`` up to ``_THIN`` of its norm, if they hold less than half of its numbers.

    The range is found by random vectors, and the rest is formed and measured, so that the bound holds.
    """
    most = a.shape[0] * a.shape[1] // (2 * sum(a.shape))
    size, k = float(np.linalg.norm(a)), 16
    while np.isfinite(size) and k <= 2 * most:
        q = np.linalg.qr(a @ np.random.default_rng(k).standard_normal((a.shape[1], min(k, *a.shape))))[0]
        b = q.T @ a
        left = float(np.linalg.norm(a - q @ b))
        if left <= 0.7 * _THIN * size:
            u, s, v = np.linalg.svd(b, full_matrices=False)
            lost = np.sqrt(np.cumsum(np.square(s[::-1])))[::-1]
            r = int((lost > 0.7 * _THIN * size).sum())
            return (q @ u[:, :r], s[:r, None] * v[:r]) if r <= most else None
        k *= 2
    return None


class Sensitivity:
    """The matrix of responses of data to cells, written once in blocks; its two products are Spark sums.

    ``kernel(o, c)`` maps stations (n, k) and cells (m, j) to (n, m) responses. A block holds the
    data of one chunk against the cells of one chunk, whole or, where its cells are far from the
    data and so much alike to them, as the product of two thin matrices (``thin``). It is a row of
    a table in the shared folder, so a product streams the table past a broadcast vector; a task
    adds up its blocks before the shuffle. Data measured at one place (equal ``at``) have equal
    rows, of which the table holds one. The driver holds vectors of cells and of data, counted first.
    """

    def __init__(self, stations: DataFrame, cells: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], at: list[str], of: list[str]):
        """stations: i (0 to n - 1) and columns ``at``; cells: j (0 to m - 1) and columns ``of``."""
        from terralith.operators.storage import stored_at

        self.n, self.m = stations.count(), cells.count()
        if max(self.n, self.m) > MOST_UNKNOWNS:
            raise ValueError(f"at most {MOST_UNKNOWNS} data and cells")
        places, self.row = self._places(stations, at)
        self.rows = int(self.row.max(initial=-1)) + 1
        self.side = side = int(np.sqrt(BLOCK_BYTES / 8))
        chunk = lambda df, key, columns: df.groupBy(F.floor(F.col(key) / side).alias(f"b{key}")).agg(F.array_sort(F.collect_list(F.struct(key, *[F.col(c).cast("double").alias(c) for c in columns]))).alias(f"rows_{key}"))
        a, b = chunk(places, "i", at), chunk(cells, "j", of)
        count = -(-self.m // side)
        # every chunk of stations meets every chunk of cells by its number: a matrix has all pairs by nature
        both = a.withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, count - 1)).cast("long")))).join(b, "bj")

        def fill(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    rows, cols = (np.array([[x[c] for c in names] for x in part], float).reshape(len(part), len(names)) for part, names in ((r.rows_i, at), (r.rows_j, of)))
                    block = np.ascontiguousarray(kernel(rows, cols), float)
                    two = thin(block)
                    rank, held = (two[0].shape[1], b"".join(x.tobytes() for x in two)) if two else (-1, block.tobytes())
                    yield pd.DataFrame({"bi": [r.bi * side], "bj": [r.bj * side], "height": [len(rows)], "rank": [rank], "values": [held]})

        parts = max(1, -(-self.rows // side)) * max(1, count)
        # few files, each of many blocks: every product opens them all
        blocks = both.repartition(min(parts, 4 * both.sparkSession.sparkContext.defaultParallelism)).mapInPandas(fill, "bi long, bj long, height long, rank long, values binary")
        self.blocks, self.path = stored_at(blocks)

    def _sum(self, v: np.ndarray, across: bool) -> np.ndarray:
        held = self.blocks.sparkSession.sparkContext.broadcast(np.asarray(v, float))

        def run(batches):
            sums = {}
            for pdf in batches:
                for r in pdf.itertuples():
                    a = np.frombuffer(r.values, float)
                    cut = r.height * max(r.rank, 0)
                    a = [a.reshape(r.height, -1)] if r.rank < 0 else [a[:cut].reshape(r.height, r.rank), a[cut:].reshape(r.rank, min(side, m - r.bj))]
                    if across:
                        spot, part = r.bi, held.value[r.bj : r.bj + a[-1].shape[1]]
                        for x in reversed(a):
                            part = x @ part
                    else:
                        spot, part = r.bj, held.value[r.bi : r.bi + r.height]
                        for x in a:
                            part = part @ x
                    sums[spot] = sums[spot] + part if spot in sums else part
            yield pd.DataFrame({"at": list(sums), "part": [x.tobytes() for x in sums.values()]})

        def add(pdf):
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "part": [np.sum([np.frombuffer(x, float) for x in pdf["part"]], axis=0).tobytes()]})

        side, m, out = self.side, self.m, np.zeros(self.rows if across else self.m)
        for r in self.blocks.mapInPandas(run, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect():
            part = np.frombuffer(r["part"], float)
            out[r["at"] : r["at"] + len(part)] = part
        held.unpersist()
        return out

    def dot(self, cells: np.ndarray) -> np.ndarray:
        """Responses at the data of values of the cells."""
        return self._sum(cells, True)[self.row]

    def back(self, data: np.ndarray) -> np.ndarray:
        """Sums over the data, by cell."""
        return self._sum(np.bincount(self.row, np.asarray(data, float), self.rows), False)

    @staticmethod
    def _places(stations: DataFrame, at: list[str]) -> tuple[DataFrame, np.ndarray]:
        """The distinct places, numbered as ``i`` by their first datum, and the number of every datum's place."""
        from terralith.operators.mesh import dense_number
        from terralith.operators.storage import stored

        first = stations.groupBy(*[F.col(c).alias(f"__{c}") for c in at]).agg(F.min("i").alias("__first"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at]
        own = stored(stations.select("i", *at).join(first, same).select("i", "__first", *at))
        pairs = own.select("i", "__first").toPandas().sort_values("i")
        row = np.unique(pairs["__first"].to_numpy(), return_inverse=True)[1]
        heads = own.filter(F.col("i") == F.col("__first")).select("__first", *at)
        return dense_number(heads, ["__first"], "i").select("i", *at), row

    def release(self) -> None:
        from terralith.operators.storage import discard

        discard(self.blocks.sparkSession, self.path)


def sparse_inversion(dot: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], data: np.ndarray, std: np.ndarray, weight: np.ndarray, lower: float, upper: float,
                     norm: float = 1.0, rounds: int = 4, inner: int = 12, beta: float = 1.0, cooling: float = 4.0, eps: float = 1e-3, target: float = 1.0) -> tuple[np.ndarray, list[dict]]:
    """Cells within bounds whose responses fit ``data``, sparse in the sense of ``norm``; (cells, log).

    Minimises chi squared plus beta times the sum of r w^2 m^2, r = (m^2 + eps^2)^(norm/2 - 1) from
    the round before (1 in the first), by projected conjugate gradients: cells at a bound that
    the gradient pushes outwards are held, the others take a step of a few products. beta is the
    ratio of both terms' sizes at first and falls by ``cooling`` a round; the rounds end when chi
    squared a datum is at most ``target``, after ``rounds`` at the latest.
    """
    m = np.zeros(len(weight))
    w2 = 1.0 / np.square(std)
    first = back(w2 * data)
    top = float(np.abs(first / weight).max(initial=0.0)) or 1.0
    probe = first / np.square(weight)
    jp = dot(probe)
    scale = float(jp @ (w2 * jp)) / max(float((np.square(weight) * probe) @ probe), 1e-300)
    beta, log = beta * scale, []
    predicted = np.zeros(len(data))
    for k in range(rounds):
        r = np.ones(len(m)) if k == 0 else (np.square(m) + eps * eps) ** (norm / 2 - 1) * max(eps, float(np.abs(m).max())) ** (2 - norm)
        reg = beta * r * np.square(weight)
        gradient = back(w2 * (predicted - data)) + reg * m
        held = ((m <= lower) & (gradient > 0)) | ((m >= upper) & (gradient < 0))
        # conjugate gradients on the free cells, preconditioned by the regularisation
        x, res = np.zeros(len(m)), np.where(held, 0.0, -gradient)
        z = res / reg
        p, rz = z.copy(), float(res @ z)
        for _ in range(inner):
            if rz <= 1e-20 * top * top:
                break
            jp = dot(p)
            ap = np.where(held, 0.0, back(w2 * jp) + reg * p)
            a = rz / float(p @ ap)
            x, res = x + a * p, res - a * ap
            z = res / reg
            new = float(res @ z)
            p, rz = z + (new / rz) * p, new
        cost = lambda v, d: float(w2 @ np.square(d - data)) + float(reg @ np.square(v))
        before, length = cost(m, predicted), 1.0
        while length > 1e-3:
            trial = np.clip(m + length * x, lower, upper)
            got = dot(trial)
            if cost(trial, got) <= before:
                m, predicted = trial, got
                break
            length /= 2
        chi = float(w2 @ np.square(predicted - data)) / len(data)
        log.append({"round": k, "beta": beta, "chi2": chi, "step": length, "nonzero": int((np.abs(m) > eps).sum())})
        if chi <= target:
            break
        beta /= cooling
    return m, log


#: Times its longest half side that a prism is away at least, and points an axis that then give its pull to 1e-14.
_FAR = [(1600.0, 2), (108.0, 3), (28.0, 4), (12.5, 5), (8.0, 6)]
#: Pairs that one array operation takes, so that its operands stay in the processor's cache.
_TILE = 16_384


def prism_gravity(stations: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(n, m) mGal at stations (x, y, z) of 1 g/cc in upright prisms (cx, cy, cz, hx, hy, hz: half sides).

    Near prisms by their corners. Far ones, whose corners' terms cancel to rounding errors, by
    Gauss's points, as many as their distance asks.
    """
    out = np.empty((len(stations), len(cells)))
    if not out.size:
        return out
    low, high = stations.min(axis=0), stations.max(axis=0)
    gap = np.maximum(np.maximum(low - cells[:, :3], cells[:, :3] - high), 0.0)
    away = np.sqrt((gap * gap).sum(axis=1)) / np.maximum(cells[:, 3:].max(axis=1), 1e-300)
    points = np.zeros(len(cells), int)
    for far, n in reversed(_FAR):
        points[away >= far] = n
    for n in np.unique(points):
        at = np.flatnonzero(points == n)
        for a in range(0, len(at), 512):
            own = at[a : a + 512]
            step = max(1, _TILE // len(own))
            for b in range(0, len(stations), step):
                out[b : b + step, own] = (_corner_gravity(stations[b : b + step], cells[own]) if n == 0 else _point_gravity(stations[b : b + step], cells[own], n))
    return out


def _point_gravity(stations: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    from terralith.functions.geometry import G_MGAL

    places, weights = np.polynomial.legendre.leggauss(n)
    off = [[cells[None, :, a] + p * cells[None, :, a + 3] - stations[:, None, a] for p in places] for a in range(3)]
    square = [[x * x for x in axis] for axis in off]
    out = np.zeros((len(stations), len(cells)))
    for k, wz in enumerate(weights):
        layer = np.zeros_like(out)
        for i, wx in enumerate(weights):
            side = square[0][i] + square[2][k]
            for j, wy in enumerate(weights):
                r2 = side + square[1][j]
                layer += wx * wy / (r2 * np.sqrt(r2))
        out += wz * off[2][k] * layer
    return -G_MGAL * out * cells[None, :, 3:].prod(axis=2)


def _corner_gravity(stations: np.ndarray, cells: np.ndarray) -> np.ndarray:
    from terralith.functions.geometry import G_MGAL

    out = np.zeros((len(stations), len(cells)))
    ends = [[cells[None, :, a] + s * cells[None, :, a + 3] - stations[:, None, a] for s in (-1, 1)] for a in range(3)]
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                x, y, z = ends[0][i], ends[1][j], ends[2][k]
                r = np.sqrt(x * x + y * y + z * z)
                tiny = 1e-12
                term = x * np.log(np.maximum(y + r, tiny)) + y * np.log(np.maximum(x + r, tiny)) - z * np.arctan(x * y / np.where(np.abs(z * r) < tiny, tiny, z * r))
                out += (-1) ** (i + j + k) * term
    return -G_MGAL * out
