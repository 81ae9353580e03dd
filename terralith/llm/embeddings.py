"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised; in each of ``TABLES`` tables ``FUNCTIONS`` Gaussian projections, shifted
and cut into cells of width ``WIDTH``, name a bucket within the vector's label. Unit vectors of
cosine 0.98 lie 0.2 apart, a projection parts them by N(0, 0.2), so a cell keeps them together
with probability 1 - 0.8 * 0.2 / 1.5 = 0.89 and a table with 0.166; in 48 tables a pair at the
very threshold is missed with probability 2e-4, a closer one less often. Independent vectors
share a cell with probability 0.39 and meet in a table with 3e-7.

Equal vectors are one node with a weight. Small buckets are checked many at a time; a bucket
never meets in one task beyond ``BLOCK`` members: larger ones are cut into blocks, and each pair
of blocks is a unit of its own. A unit sends no pairs on, only sums per vector and the smallest vector
that its pairs reach: a pair counts in the first table in which it meets (the members carry their
bucket in every table), so the sums over tables are exact and no component comes apart. Buckets of several tables with the same members are checked once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialise, table
from terralith.llm.components import connected_components

THRESHOLD = 0.98
TABLES = 48
FUNCTIONS = 16
WIDTH = 1.5
BLOCK = 1024
#: Members up to which buckets are checked together in one array operation.
SMALL = 16
SEED = 20240607


def _planes(dim: int, tables: int, functions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * functions)), rng.uniform(0, width, tables * functions)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH) -> np.ndarray:
    """(rows, tables) 64-bit bucket names of unit vectors."""
    from terralith.llm.words import mix

    planes, shift = _planes(unit.shape[1], tables, functions, width)
    cells = np.floor((unit @ planes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, functions)
    out = np.zeros((len(unit), tables), np.uint64)
    for i in range(functions):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i] + np.uint64(i + 1))
    return out.view(np.int64)


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows])
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _meets(given, a: np.ndarray, b: np.ndarray, cosine: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of rows ``a`` and ``b`` are ``threshold`` or more; those that rounding leaves open by exact sums.

    The cosine of normalised vectors is off by some units in the last place, so within 1e-12 of
    the threshold the pair is held against it in rational numbers, as the double that the exact
    cosine rounds to.
    """
    ok = cosine >= threshold
    for at in np.flatnonzero(np.abs(cosine - threshold) < 1e-12):
        x, y = ([Fraction(float(z)) for z in given[k[at]]] for k in (a, b))
        dot, size = sum(p * q for p, q in zip(x, y, strict=True)), sum(p * p for p in x) * sum(q * q for q in y)
        # a real number rounds to the threshold or above from half way to the double below it
        least = (Fraction(threshold) + Fraction(float(np.nextafter(threshold, -1)))) / 2
        ok[at] = dot > 0 and dot * dot >= least * least * size
    return ok


def _usable(vector: str):
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def _keyed(nodes: DataFrame, tables: int) -> DataFrame:
    """nodes(rep, label, v, w) with the bucket names of each vector."""

    def run(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), 2000):
                    p = part.iloc[at : at + 2000]
                    yield p.assign(k=list(bucket_keys(_unit(list(p["v"])), tables)))

    return nodes.mapInPandas(run, f"rep long, label string, v {dict(nodes.dtypes)['v']}, w long, k array<long>")


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up`` (a root for every member, roots their own) with the roots that pairs (a, b) join under the smaller."""
    while len(a):
        p, q = up[a], up[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up != up[up]).any():
            up = up[up]
    return up


def _least(up: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest ``rep`` under the same root, for every member."""
    least = rep.copy()
    np.minimum.at(least, up, rep)
    return least[up]


def _small_links(threshold: float):
    """Links inside small buckets, one per row: buckets of one size are one stack of matrices.

    ``low`` is the smallest vector that the bucket's pairs reach, not the smallest neighbour:
    two neighbours whose own smallest neighbours differ would come apart.
    """

    def run(batches):
        for pdf in batches:
            shape = pdf["dim"].to_numpy() * 1000 + pdf["n"].to_numpy()
            for key in np.unique(shape):
                rows = pdf[shape == key]
                n = int(key % 1000)
                for at in range(0, len(rows), 4096):
                    part = rows.iloc[at : at + 4096]
                    members = [m for ms in part["m"] for m in ms]
                    part_v = [m["v"] for m in members]
                    v = _unit(part_v).reshape(len(part), n, -1)
                    k = np.array([m["k"] for m in members]).reshape(len(part), n, -1)
                    rep = np.array([m["rep"] for m in members]).reshape(len(part), n)
                    w = np.array([m["w"] for m in members]).reshape(len(part), n)
                    near = v @ v.transpose(0, 2, 1) >= threshold - 1e-9
                    b, i, j = np.nonzero(np.triu(near, 1))
                    ok = _meets(part_v, b * n + i, b * n + j, np.einsum("ij,ij->i", v[b, i], v[b, j]), threshold)
                    earlier = np.arange(k.shape[2])[None, :] < part["t"].to_numpy()[b][:, None]
                    ok &= ~((k[b, i] == k[b, j]) & earlier).any(axis=1)
                    b, i, j = b[ok], i[ok], j[ok]
                    links = np.zeros_like(rep)
                    for x, y in ((i, j), (j, i)):
                        np.add.at(links, (b, x), w[b, y])
                    low = _least(_joined(np.arange(rep.size), b * n + i, b * n + j), rep.reshape(-1)).reshape(rep.shape)
                    hit = links > 0
                    yield pd.DataFrame({"rep": rep[hit], "links": links[hit], "low": low[hit]})

    return run


def _unit_links(threshold: float):
    """Links inside a block, or between two blocks, of one bucket: sums and the smallest vector reached, for every member."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["t"].iloc[0])
        side = pdf["side"].to_numpy()
        v, k = _unit(list(pdf["v"])), np.array(list(pdf["k"]))
        rep, w = pdf["rep"].to_numpy(), pdf["w"].to_numpy()
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        rows, cols = (np.arange(len(v)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, up = np.zeros(len(v), np.int64), np.arange(len(v))
        for at in range(0, len(rows), 256):
            r = rows[at : at + 256]
            near = v[r] @ v[cols].T >= threshold - 1e-9
            a, b = np.nonzero(near)
            a, b = r[a], cols[b]
            if same:
                a, b = a[b > a], b[b > a]
            if not len(a):
                continue
            exact = np.fromiter((float(np.dot(v[x], v[y])) for x, y in zip(a, b)), float, len(a)) if len(a) < 64 else np.einsum("ij,ij->i", v[a], v[b])
            ok = _meets(pdf["v"].to_numpy(), a, b, exact, threshold)
            if t:
                ok &= ~(k[a, :t] == k[b, :t]).any(axis=1)
            a, b = a[ok], b[ok]
            np.add.at(links, a, w[b])
            np.add.at(links, b, w[a])
            up = _joined(up, a, b)
        hit = links > 0
        return pd.DataFrame({"rep": rep[hit], "links": links[hit], "low": _least(up, rep)[hit]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                    threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) for every row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine, in double precision,
    is at least ``threshold``. A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing, and neither does one of another length or a null id. Rows
    with equal vectors link with each other; a repeated row counts as often as it occurs (an id
    must not name two different vectors).
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    given = F.col(vector_col)
    vector = given if dict(vectors.dtypes)[vector_col] in ("array<float>", "array<double>") else given.cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), label.alias("label"))
    good = _usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()
    nodes = src.filter(good).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("w")).select("rep", "label", "v", "w")
    keyed = materialise(_keyed(nodes, tables))

    slim = keyed.select("rep", "label", F.posexplode("k").alias("t", "key"), F.size("v").alias("dim"))
    # buckets of several tables with the same members (told by two 64-bit sums) are one: the first
    mark = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sizes = slim.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("n"), *mark).filter("n > 1")
    sizes = sizes.groupBy("label", "dim", "n", "x1", "x2").agg(F.min(F.struct("t", "key")).alias("b")).select("label", "dim", "b.t", "b.key", "n")
    full = keyed.select("rep", F.col("label").alias("l2"), "v", "w", "k")
    placed = slim.join(sizes, ["label", "dim", "t", "key"])
    member = F.struct("rep", "v", "w", "k")
    few = placed.filter(F.col("n") <= SMALL).join(full, "rep").filter("label = l2")
    few = few.groupBy("label", "dim", "t", "key").agg(F.collect_list(member).alias("m")).select("dim", "t", F.size("m").alias("n"), "m")
    found = few.mapInPandas(_small_links(threshold), "rep long, links long, low long")

    where = placed.filter(F.col("n") > SMALL).select("rep", "label", "dim", "t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int")
    spread = where.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = spread.select(
        "rep", "label", "dim", "t", "key",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    members = units.join(full, "rep").filter("label = l2").drop("l2")
    many = members.groupBy("label", "dim", "t", "key", "i", "j").applyInPandas(_unit_links(threshold), "rep long, links long, low long")
    found = found.unionByName(many)
    sums = materialise(found)

    counts = sums.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(sums.filter("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")), rows=keyed.count())
    per = keyed.select("rep", "label", "v", "w").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    per = per.select(F.col("label").alias("l"), F.col("v").alias("x"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    joined = src.join(per, good & (F.col("label") == F.col("l")) & (F.col("v") == F.col("x")), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op3_embedding_near_dedup(spark, sf_dir):
    """Contract query over all ``embeddings``."""
    rows = near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: The contract by brute force within labels; fine for some thousand vectors.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id, vec_id AS root FROM u UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
