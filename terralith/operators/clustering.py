"""Property gating, cluster summaries, ranks, group mapping and mixture models."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gate rows up to which they become one CASE chain in the plan.
MAX_GATES = 500


#: Clusters that one array may hold.
BROADCAST_CLUSTERS = 4096


def valid(density: Column, sentinel: float = -9999.0) -> Column:
    """Whether a cell holds data: density at least one above the sentinel."""
    return density >= sentinel + 1.0


def active(density: Column) -> Column:
    return F.abs(density) > 1e-12


def gate(density: Column, susceptibility: Column, gates: list[tuple[float, float, float, float]]) -> Column:
    """Number of the first gate (d_min, d_max, s_min, s_max), bounds inclusive, that fits; else -1."""
    if len(gates) > MAX_GATES:
        raise ValueError("use gate_join for long gate tables")
    out = F.lit(-1)
    for i, (d0, d1, s0, s1) in reversed(list(enumerate(gates))):
        out = F.when(density.between(d0, d1) & susceptibility.between(s0, s1), i).otherwise(out)
    return out


def gate_join(cells: DataFrame, gates: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """(id, label) with gates as a table (ord, d_min, d_max, s_min, s_max), first match wins.

    The gate table is small by nature and broadcast; cells are grouped by id without moving
    their other columns.
    """
    fits = F.col("density").between(F.col("d_min"), F.col("d_max")) & F.col("susceptibility").between(F.col("s_min"), F.col("s_max"))
    joined = cells.join(F.broadcast(gates), fits, "left")
    return joined.groupBy(id_col).agg(F.coalesce(F.min("ord"), F.lit(-1)).alias("label"))


def shift_gates(gates: list[tuple[float, float, float, float]], background: float) -> list[tuple[float, float, float, float]]:
    """Gates on absolute density as gates on contrast."""
    return [(a - background, b - background, c, d) for a, b, c, d in gates]


def summary(cells: DataFrame, label: str = "label", columns: tuple[str, ...] = ("density", "susceptibility")) -> DataFrame:
    """Count, mean and population deviation by label."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return cells.groupBy(label).agg(F.count("*").alias("n"), *aggs)


def gated_summary(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Summary of every expected label (column label), zeros for those without cells."""
    found = summary(cells)
    out = labels.join(found, "label", "left")
    return out.select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != "label"])


def ranked_by_density(means: DataFrame) -> DataFrame:
    """Labels renumbered from 1 by ascending mean density (columns label, density_mean)."""
    return means.withColumn("rank", F.row_number().over(Window.orderBy("density_mean", "label")))


def stretch(rows: DataFrame, least_range: float, background: float = 2.67) -> DataFrame:
    """Mean contrasts widened to a range of at least ``least_range``, then made absolute.

    rows: density_mean, density_std. A range of zero stays.
    """
    ends = rows.agg((F.max("density_mean") - F.min("density_mean")).alias("__r"))
    k = F.when((F.col("__r") > 0) & (F.col("__r") < least_range), least_range / F.col("__r")).otherwise(1.0)
    out = rows.crossJoin(F.broadcast(ends))
    return out.withColumn("density_std", F.col("density_std") * k).withColumn("density_mean", F.col("density_mean") * k + background).drop("__r")


def intersection_labels(cells: DataFrame, n_susceptibility: int) -> DataFrame:
    """Dense labels of the pairs (density class d, susceptibility class s) that occur."""
    pair = F.col("d") * n_susceptibility + F.col("s")
    present = cells.select(pair.alias("__pair")).distinct()
    numbered = present.withColumn("label", F.dense_rank().over(Window.orderBy("__pair")) - 1)
    return cells.withColumn("__pair", pair).join(F.broadcast(numbered), "__pair").drop("__pair")


def tercile_groups(clusters: DataFrame, n_groups: int = 3) -> DataFrame:
    """Groups by density rank: halves for two groups, else thirds (ends 0 and 2, a lone one 1)."""
    w = Window.orderBy("density", "cluster_id")
    pos, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(F.lit(1)))
    if n_groups == 2:
        group = F.when(pos >= F.floor(n / 2), 1).otherwise(0)
    else:
        frac = pos / F.greatest(n - 1, F.lit(1))
        thirds = F.when(frac >= 0.67, 2).when(frac >= 0.33, 1).otherwise(0)
        group = F.when(n == 1, 1).when((n == 2) & (pos == 0), 0).when(n == 2, 2).otherwise(thirds)
    return clusters.withColumn("litho_group", group)


def group_properties(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mean density and susceptibility of each group; NaN values are left out."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    joined = clusters.join(mapping, "cluster_id")
    return joined.groupBy("litho_group").agg(F.avg(clean("density")).alias("density"), F.avg(clean("susceptibility")).alias("susceptibility"), F.count("*").alias("n_clusters"))


def weighted_properties(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Means of each group weighted by sample count, 0 without samples."""
    w = F.sum("sample_count")
    mean = lambda c: F.when(w > 0, F.sum(F.col("sample_count") * F.col(c)) / w).otherwise(0.0).alias(c)
    return clusters.join(mapping, "cluster_id").groupBy("litho_group").agg(mean("density"), mean("susceptibility"))


def fill_empty_groups(groups: DataFrame, expected: DataFrame) -> DataFrame:
    """Properties for every expected group: nearest populated ones above and below averaged.

    Only above: density * 1.05, susceptibility * 1.5; only below: * 0.95, * 0.5; none: 2.67, 0.
    """
    joined = expected.join(groups, "litho_group", "left")
    up = Window.orderBy("litho_group").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("litho_group").rowsBetween(0, Window.unboundedFollowing)
    out = joined
    for c in ("density", "susceptibility"):
        out = out.withColumn(f"a_{c}", F.last(c, True).over(up)).withColumn(f"b_{c}", F.first(c, True).over(down))

    def fill(c, k_above, k_below, default):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.coalesce(F.col(c), (a + b) / 2, a * k_above, b * k_below, F.lit(default)).alias(c)

    return out.select("litho_group", fill("density", 1.05, 0.95, 2.67), fill("susceptibility", 1.5, 0.5, 0.0), F.col("n_clusters").isNull().alias("interpolated"))


def nearest_cluster(rows: DataFrame, clusters: DataFrame, id_cols: list[str], susceptibility_weight: float | None = None) -> DataFrame:
    """(ids, cluster_id) of the cluster nearest in density, or in density and weighted susceptibility.

    Up to ``BROADCAST_CLUSTERS`` clusters are broadcast as one array, so rows are neither
    multiplied nor shuffled; more are dealt into blocks that rows meet by number, one row for
    each value of ``id_cols``. In the two-property form clusters of density 0 are left out; ties
    go to the smaller id.
    """
    used = clusters if susceptibility_weight is None else clusters.filter("density <> 0")
    blocks = -(-used.count() // BROADCAST_CLUSTERS) or 1
    held = F.array_sort(F.collect_list(F.struct("cluster_id", F.col("density").alias("d"), F.col("susceptibility").alias("s")))).alias("__c")

    def distance(c):
        near = F.abs(F.col("density") - c["d"])
        if susceptibility_weight is not None:
            near = near + susceptibility_weight * F.abs(F.col("susceptibility") - c["s"])
        return F.struct(near.alias("near"), c["cluster_id"].alias("id"))

    best = F.array_min(F.transform("__c", distance))
    if blocks == 1:
        return rows.crossJoin(F.broadcast(used.agg(held))).select(*id_cols, best["id"].alias("cluster_id"))
    dealt = used.groupBy(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)).alias("__b")).agg(held)
    met = rows.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "__b")
    return met.select(*id_cols, best.alias("best")).groupBy(*id_cols).agg(F.min("best")["id"].alias("cluster_id"))


def mixture(cells: DataFrame, columns: list[str], k: int, rounds: int = 30, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gaussian mixture with full covariance by EM: (weights, means, covariances, log-likelihood).

    Every round is one aggregation over the cells, whose result has k rows; the start is at
    quantiles of the first column, so a run is reproducible. Features are standardised by the
    population deviation first; the results are in standard units.
    """
    from terralith.operators.residual import standardise

    p = len(columns)
    z = standardise(cells.select(*columns), columns).select(*[F.col(f"{c}_z").alias(f"z{i}") for i, c in enumerate(columns)]).cache()
    cuts = z.agg(F.percentile("z0", [(i + 0.5) / k for i in range(k)]).alias("q")).first()["q"]
    means = np.zeros((k, p))
    means[:, 0] = cuts
    weights, covs, score = np.full(k, 1.0 / k), np.stack([np.eye(p)] * k), -np.inf
    for _ in range(rounds):
        logs = []
        for j in range(k):
            inv = np.linalg.inv(covs[j])
            x = [F.col(f"z{i}") - float(means[j, i]) for i in range(p)]
            q = sum((float(inv[a, b]) * x[a] * x[b] for a in range(p) for b in range(p)), F.lit(0.0))
            logs.append(F.lit(float(np.log(weights[j] + 1e-300) - 0.5 * np.linalg.slogdet(covs[j])[1] - 0.5 * p * np.log(2 * pi))) - 0.5 * q)
        rows = z.select("*", F.array(*logs).alias("l")).withColumn("top", F.array_max("l"))
        total = F.aggregate(F.transform("l", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v)
        rows = rows.withColumn("norm", F.col("top") + F.ln(total))
        aggs = [F.sum("norm").alias("ll"), F.count("*").alias("n")]
        for j in range(k):
            r = F.exp(F.col("l")[j] - F.col("norm"))
            aggs.append(F.sum(r).alias(f"r{j}"))
            aggs += [F.sum(r * F.col(f"z{a}")).alias(f"m{j}_{a}") for a in range(p)]
            aggs += [F.sum(r * F.col(f"z{a}") * F.col(f"z{b}")).alias(f"s{j}_{a}_{b}") for a in range(p) for b in range(a, p)]
        got = rows.agg(*aggs).first()
        for j in range(k):
            nj = max(got[f"r{j}"], 1e-12)
            weights[j] = nj / got["n"]
            means[j] = [got[f"m{j}_{a}"] / nj for a in range(p)]
            for a in range(p):
                for b in range(a, p):
                    covs[j, a, b] = covs[j, b, a] = got[f"s{j}_{a}_{b}"] / nj - means[j, a] * means[j, b]
            covs[j] += np.eye(p) * floor
        if abs(got["ll"] - score) < 1e-3 * got["n"] * 1e-3:
            score = got["ll"]
            break
        score = got["ll"]
    z.unpersist()
    return weights, means, covs, float(score)


def mixture_labels(cells: DataFrame, columns: list[str], k: int, fitted=None) -> DataFrame:
    """``cells`` with ``label``: most likely component, numbered from 1 by mean of the first column."""
    from terralith.operators.residual import standardise

    weights, means, covs, _ = fitted or mixture(cells, columns, k)
    rank = {int(j): i + 1 for i, j in enumerate(np.argsort(means[:, 0], kind="stable"))}
    z = standardise(cells, columns)
    scores = []
    for j in range(k):
        inv = np.linalg.inv(covs[j])
        x = [F.col(f"{c}_z") - float(means[j, i]) for i, c in enumerate(columns)]
        q = sum((float(inv[a, b]) * x[a] * x[b] for a in range(len(x)) for b in range(len(x))), F.lit(0.0))
        scores.append(F.struct((F.lit(float(np.log(weights[j] + 1e-300) - 0.5 * np.linalg.slogdet(covs[j])[1])) - 0.5 * q).alias("s"), F.lit(rank[j]).alias("r")))
    return z.withColumn("label", F.array_max(F.array(*scores))["r"]).drop(*[f"{c}_z" for c in columns])
