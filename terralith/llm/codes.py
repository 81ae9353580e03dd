"""Product codes of vectors by Lloyd's rounds with Elkan's bounds, in whole numbers.

Components become floor(1024 * x); a vector is cut into ``PARTS`` consecutive parts, each with a
codebook of ``ENTRIES`` entries. Every part keeps, from round to round, the entry it is assigned
to, an upper bound of its distance to that entry and a lower bound for every entry. When entries
move, the upper bound grows by its entry's movement and each lower bound shrinks by the movement
of its own entry. An entry is passed over only if its lower bound, or half its distance to the
assigned entry, is strictly greater than the upper bound; all that is left is compared by exact
integer squared distances, ties to the lower index. Bounds are rounded outwards, so they prune
nothing that could win or tie.

Bounds lie beside the vectors in a table in the shared folder; a round reads that of the round
before and writes the next, both by plain map tasks, and the older one is removed. Only sums and
counts by entry, at most ``PARTS`` * ``ENTRIES`` rows, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import discard, stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest absolute integer component: squared distances and their sums stay exact in 64 bits.
LARGEST = 1 << 26
#: Vectors worked on at once.
BLOCK = 512


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds as float32, never above ``x``."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances."""
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        d = x[:, i, None] - c[None, :, i]
        out += d * d
    return out


class Codebook:
    """The entries of one part position, with what pruning needs to know about them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = np.sqrt(_squares(entries, entries).astype(np.float64))
        self.half = np.nextafter(apart, -np.inf) / 2
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1, initial=np.inf)
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64))
        self.moved = np.where(moved > 0, _up(moved), 0.0)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment, upper and lower bounds without bounds from before."""
        d = _squares(x, self.entries)
        a = d.argmin(axis=1)
        root = np.sqrt(d.astype(np.float64))
        return a, _up(root[np.arange(len(x)), a]), _down(root)

    def again(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same with the bounds of the round before; also how many distances were computed."""
        a, upper = a.copy(), np.where(self.moved[a] > 0, _up(upper + self.moved[a]), upper)
        lower = np.where(self.moved > 0, _down(lower.astype(np.float64) - self.moved), lower)
        rows = np.flatnonzero(upper >= self.nearest[a])
        own = ((x[rows] - self.entries[a[rows]]) ** 2).sum(axis=1)
        root = np.sqrt(own.astype(np.float64))
        upper[rows] = _up(root)
        lower[rows, a[rows]] = _down(root)
        near = (lower[rows] <= upper[rows, None]) & (self.half[a[rows]] <= upper[rows, None])
        near[np.arange(len(rows)), a[rows]] = False
        r, j = np.nonzero(near)
        d = ((x[rows[r]] - self.entries[j]) ** 2).sum(axis=1)
        lower[rows[r], j] = _down(np.sqrt(d.astype(np.float64)))
        best = np.full((len(rows), len(self.entries)), np.iinfo(np.int64).max)
        best[np.arange(len(rows)), a[rows]] = own
        best[r, j] = d
        new = best.argmin(axis=1)
        a[rows] = new
        upper[rows] = _up(np.sqrt(best[np.arange(len(rows)), new].astype(np.float64)))
        return a, upper, lower, len(rows) + len(r)


def _cuts(dim: int) -> list[int]:
    return [dim * i // PARTS for i in range(PARTS + 1)]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A column of equally long binary values as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _blocks(n: int):
    return ((at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


def _assign(state: DataFrame, books: list[Codebook], cuts: list[int], keep: bool) -> DataFrame:
    """The next state(id, label, x, code, upper, lower, work), or (id, label, code, error) where ``keep`` is false."""
    first = "code" not in state.columns

    def run(batches):
        for batch in batches:
            name = {f: i for i, f in enumerate(batch.schema.names)}
            xs = _matrix(batch.column(name["x"]), np.int64)
            n = len(xs)
            codes, uppers, lowers, work, error = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS)), [None] * PARTS, np.zeros(n, np.int64), np.zeros(n, np.int64)
            old = None if first else (_matrix(batch.column(name["code"]), np.uint8), _matrix(batch.column(name["upper"]), np.float64), _matrix(batch.column(name["lower"]), np.float32))
            for p, book in enumerate(books):
                k = len(book.entries)
                lowers[p] = np.zeros((n, k), np.float32)
                for a, b in _blocks(n):
                    x = xs[a:b, cuts[p] : cuts[p + 1]]
                    if first:
                        code, upper, lower = book.first(x)
                        work[a:b] += k
                    else:
                        code, upper, lower, done = book.again(x, old[0][a:b, p].astype(np.int64), old[1][a:b, p], old[2][a:b, p * k : (p + 1) * k])
                        work[a] += done
                    codes[a:b, p], uppers[a:b, p], lowers[p][a:b] = code, upper, lower
                    error[a:b] += ((x - book.entries[code]) ** 2).sum(axis=1)
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            head = [batch.column(name["id"]), batch.column(name["label"])]
            if keep:
                yield pa.RecordBatch.from_arrays([*head, batch.column(name["x"]), binary(codes), binary(uppers), binary(np.concatenate(lowers, axis=1)), pa.array(work)], ["id", "label", "x", "code", "upper", "lower", "work"])
            else:
                yield pa.RecordBatch.from_arrays([*head, binary(codes), pa.array(error)], ["id", "label", "code", "error"])

    label = dict(state.dtypes)["label"]
    return state.mapInArrow(run, f"id long, label {label}, " + ("x binary, code binary, upper binary, lower binary, work long" if keep else "code binary, error long"))


def _sums(state: DataFrame, sizes: list[int], cuts: list[int]) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Componentwise sums and counts of the parts of each entry; a task sends one row an entry at most."""

    def run(batches):
        total = [np.zeros((sizes[p], cuts[p + 1] - cuts[p]), np.int64) for p in range(PARTS)]
        count = [np.zeros(sizes[p], np.int64) for p in range(PARTS)]
        for batch in batches:
            xs, codes = _matrix(batch.column(0), np.int64), _matrix(batch.column(1), np.uint8)
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], xs[:, cuts[p] : cuts[p + 1]])
                count[p] += np.bincount(codes[:, p], minlength=sizes[p])
        rows = [(p, j, total[p][j].tolist(), int(count[p][j])) for p in range(PARTS) for j in np.flatnonzero(count[p]).tolist()]
        part, entry, sums, n = map(list, zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["part", "entry", "sums", "n"])

    width = max((b - a for a, b in zip(cuts, cuts[1:])), default=0)
    parts = state.select("x", "code").mapInArrow(run, "part int, entry int, sums array<long>, n long")
    each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()
    return {(r.part, r.entry): ([int(r[f"s{i}"]) for i in range(cuts[r.part + 1] - cuts[r.part])], r.n) for r in rows}


def _whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): rows whose vector has finite components only, as arrays of whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST / SCALE)
    checked = F.when(small, F.transform("v", lambda x: F.floor(x * SCALE))).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST // SCALE}; scale the vectors first")))
    return src.filter(good).select("id", "label", checked.alias("v"))


def _packed(whole: DataFrame) -> DataFrame:
    """``v`` as bytes, eight a component."""

    def run(batches):
        for batch in batches:
            rows = batch.column(2)
            lists = pa.array([np.array(r, np.int64).tobytes() for r in rows.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "label", "x"])

    return whole.mapInArrow(run, f"id long, label {dict(whole.dtypes)['label']}, x binary")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(coded, codebooks, work): coded(id, label, code, error), the final codebooks by part and the
    number of distances that each assignment computed.

    Rows whose vector is null, empty or holds a null or non-finite component are left out, and so
    are vectors of another length than that of the smallest id. A codebook starts as the parts of the
    ``entries`` smallest distinct ids (of a repeated id, its smallest vector; null ids do not
    count); with fewer ids it has fewer entries. Repeated rows are coded each. A length that 4
    does not divide is cut as evenly as it goes. A component of more than 65536 raises an
    error, because squared distances must stay exact in 64 bits. An empty table gives no rows
    and empty codebooks. Further columns are not read, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    whole = _whole(vectors, id_col, vector_col, label_col)
    named = whole.filter("id is not null")
    first = named.orderBy("id", "v").limit(1).collect()
    dim = len(first[0]["v"]) if first else 0
    whole = whole.filter(F.size("v") == dim)
    smallest = [r["id"] for r in whole.select("id").filter("id is not null").distinct().orderBy("id").limit(entries).collect()]
    seeds = whole.filter(F.col("id") <= max(smallest, default=0)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if smallest else []
    seeds = [r["v"] for r in seeds]
    cuts = _cuts(dim)
    books = [np.array([s[cuts[p] : cuts[p + 1]] for s in seeds], np.int64).reshape(len(seeds), cuts[p + 1] - cuts[p]) for p in range(PARTS)]
    state, path = stored(_packed(whole if seeds else whole.limit(0)))
    if not seeds:
        return state.select("id", "label", F.col("x").alias("code"), F.lit(0).cast("long").alias("error")), books, []
    given = [Codebook(b) for b in books]
    work = []
    for _ in range(rounds):
        before, (state, after) = path, stored(_assign(state, given, cuts, keep=True), "lz4")
        discard(spark, before)
        path = after
        work.append(state.agg(F.sum("work")).first()[0] or 0)
        sums = _sums(state, [len(b) for b in books], cuts)
        new = [b.copy() for b in books]
        for (p, j), (total, n) in sums.items():
            new[p][j] = [s // n for s in total]
        given = [Codebook(b, old) for b, old in zip(new, books)]
        books = new
    coded, _ = stored(_assign(state, given, cuts, keep=False))
    discard(spark, path)
    return coded, books, work


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir):
    """Contract query over all ``embeddings``."""
    coded, books, _ = vector_codes(table(spark, sf_dir, "embeddings"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract's rounds by all distances, one set of tables a round."""
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, rank - 1 AS j, x AS y FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM parts) WHERE rank <= {ENTRIES})",
    ]
    distance = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'j': j}}) AS m FROM (SELECT vec_id, parts.p, x, j, {distance} AS d FROM parts JOIN b{r} USING (p)) GROUP BY vec_id, p)")
        if r < ROUNDS:
            ctes.append(f"e{r} AS (SELECT p, m.j AS j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) WHERE i <= len(x) GROUP BY p, m.j, i)")
            ctes.append(f"m{r} AS (SELECT p, j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM e{r} GROUP BY p, j)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m{r}.y, b{r}.y) AS y FROM b{r} LEFT JOIN m{r} USING (p, j))")
    ctes.append(f"coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.j)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    ctes.append(f"book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, j)) AS sha FROM b{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + (
        "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"
    )


ORACLE_SQL = _sql()
