"""Tolerant as-of join: client and time-chunk shards with a halo, DuckDB's ASOF join in cogrouped Arrow tasks.

Events of the right side at one time of one key are a tie group and become one row, its best
event and its size, before anything else happens. Time is cut into chunks of the tolerance;
a chunk that holds more than ``CELL`` rows of one key is cut further at up to ``CUTS`` of its own
quantiles, and an instant that fills several of these cells is dealt over them by a hash of the
left rows, while its one tie group is copied to each. The halo of a cell is one row: the
latest tie group of the key before the cell, carried over the cells by a window over their last
rows (at most ``CUTS`` + 1 rows a key and chunk, however many events there are). Cells are dealt to
shards by a hash of key and cell; a shard is one cogrouped task that DuckDB joins. The latest
event at or before a row is the only one that can match, so the tolerance is checked last.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import stored, table

TOLERANCE = 720 * 3600 * 1_000_000
#: Rows of one key in one chunk beyond which the chunk is cut.
CELL = 16_384
#: Inner cuts of such a chunk, a multiple of 16 less one.
CUTS = 255
#: Rows of a shard, about.
SHARD = 20_000

_JOIN = """
SELECT l.id, l.key, l.t, r.best, l.t - r.t AS lag, r.value, r.n
FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.cell = r.cell AND l.t >= r.t
"""


def _shard_join(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard: every left row with the latest tie group of its key and cell."""
    import duckdb

    global _CON
    if "_CON" not in globals():
        _CON = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    _CON.register("l", left)
    _CON.register("r", right)
    try:
        return _CON.sql(_JOIN).to_arrow_table().cast(_OUT)
    finally:
        _CON.unregister("l")
        _CON.unregister("r")


_OUT = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("t", pa.int64()), ("best", pa.int64()), ("lag", pa.int64()), ("value", pa.int64()), ("n", pa.int64())])


def tie_groups(events: DataFrame) -> DataFrame:
    """events(key, t, value, id) to one row per key and time: value and id of the best, and n.

    The larger value is better, then the larger id; null loses to everything.
    """
    best = F.max(F.struct("value", "id")).alias("b")
    some = events.filter("key is not null and t is not null")
    return some.groupBy("key", "t").agg(best, F.count("*").alias("n")).select("key", "t", F.col("b.value").alias("value"), F.col("b.id").alias("best"), "n")


def _cuts(left: DataFrame, right: DataFrame, tolerance: int, cell: int, cuts: int) -> DataFrame:
    """(hot_key, hot_base, cuts): sorted inner cuts of the chunks that hold more than ``cell`` rows of a key."""
    base = F.floor(F.col("t") / tolerance).cast("long").alias("base")
    both = left.select("key", "t").unionByName(right.select("key", "t")).select("key", "t", base)
    hot = both.groupBy("key", "base").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("key", "base")
    at = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    found = both.join(hot.hint("merge"), ["key", "base"], "left_semi").groupBy("key", "base").agg(F.count("*").alias("n"), F.percentile_approx("t", at, F.lit(10_000)).alias("cuts"))
    # every step-th quantile, so that a cell holds about ``cell`` rows
    step = F.greatest(F.lit(1), F.floor(F.lit(cuts + 1) / F.ceil(F.col("n") / cell))).cast("int")
    kept = F.transform(F.sequence(step, F.lit(cuts), step), lambda i: F.element_at("cuts", i))
    return found.select(F.col("key").alias("hot_key"), F.col("base").alias("hot_base"), kept.alias("cuts"))


def _below(cuts: Column, t: Column, strict: bool) -> Column:
    """How many of the sorted cuts lie below (or at) ``t``: over every sixteenth, then inside one stretch."""
    less = (lambda c: c < t) if strict else (lambda c: c <= t)
    steps = F.sequence(F.lit(16), F.size(cuts), F.lit(16))
    whole = F.when(F.size(cuts) < 16, F.lit(0)).otherwise(F.size(F.filter(steps, lambda i: less(F.element_at(cuts, i)))))
    return whole * 16 + F.size(F.filter(F.slice(cuts, whole * 16 + 1, F.lit(16)), less))


def _celled(rows: DataFrame, hot: DataFrame, tolerance: int) -> DataFrame:
    """``rows`` with base, and the first and last cell that their time may lie in."""
    placed = rows.withColumn("base", F.floor(F.col("t") / tolerance).cast("long"))
    # the cuts grow with the rows: a merge join, whose hot keys adaptive execution splits, and no broadcast
    joined = placed.join(hot.hint("merge"), (F.col("key") == F.col("hot_key")) & (F.col("base") == F.col("hot_base")), "left")
    low = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(_below(F.col("cuts"), F.col("t"), strict=True))
    high = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(_below(F.col("cuts"), F.col("t"), strict=False))
    return joined.select(*placed.columns, low.cast("int").alias("low"), high.cast("int").alias("high"))


def asof_join(left: DataFrame, events: DataFrame, tolerance: int = TOLERANCE, cell: int = CELL, cuts: int = CUTS, shard: int = SHARD) -> DataFrame:
    """(id, key, t, best, lag, value, n) for every row of left(id, key, t), all longs, times in any unit.

    The match of a left row is the latest time of its key at which events(key, t, value, id) has
    rows, at or before t and at most ``tolerance`` earlier; best is the id of the row with the
    largest value, then the largest id, null losing; n counts the key's rows at that time, repeated rows as
    often as they occur. Without a match n is 0 and best, lag and value are null. A null key or
    time never matches, on either side. Repeated left rows are joined each; a null id is an id like any
    other. Empty tables on either side are no special case. Further columns are not read.
    """
    spark = left.sparkSession
    rows = left.select(F.col("id").cast("long"), F.col("key").cast("long"), F.col("t").cast("long"))
    rows, _ = stored(rows)
    groups, _ = stored(tie_groups(events.select(F.col("key").cast("long"), F.col("t").cast("long"), F.col("value").cast("long"), F.col("id").cast("long"))))
    some = rows.filter("key is not null and t is not null")
    hot, _ = stored(_cuts(some, groups, tolerance, cell, cuts).coalesce(8))
    shards = max(1, -(-(rows.count() + groups.count()) // shard))

    lefts = _celled(some, hot, tolerance).withColumn("cell", F.col("low") + F.pmod(F.xxhash64("id"), F.col("high") - F.col("low") + 1).cast("int"))
    rights = _celled(groups, hot, tolerance).withColumn("cell", F.explode(F.sequence("low", "high")))
    place = ["key", "base", "cell"]
    own = ["t", "value", "best", "n"]
    last = rights.groupBy(*place).agg(F.max(F.struct(*own)).alias("last"))
    wanted = lefts.select(*place, F.lit(None).cast(last.schema["last"].dataType).alias("last")).distinct()
    cells = last.unionByName(wanted).groupBy(*place).agg(F.max("last").alias("last"), F.max(F.col("last").isNull()).alias("asked"))
    before = Window.partitionBy("key").orderBy("base", "cell").rowsBetween(Window.unboundedPreceding, -1)
    halo = cells.withColumn("halo", F.last("last", ignorenulls=True).over(before)).filter("asked and halo is not null").select(*place, "halo.*")

    number = F.pmod(F.xxhash64(*place), F.lit(shards)).alias("shard")
    # a cell's number within its key
    at = (F.col("base") * (cuts + 1) + F.col("cell")).alias("cell")
    one = lefts.select(number, "id", "key", at, "t")
    two = rights.select(*place, *own).unionByName(halo).select(number, "key", at, *own)
    matched = one.groupBy("shard").cogroup(two.groupBy("shard")).applyInArrow(
        lambda a, b: _shard_join(a, b), "id long, key long, t long, best long, lag long, value long, n long"
    )
    none = [F.lit(None).cast("long").alias(c) for c in ("best", "lag", "value", "n")]
    found = matched.unionByName(rows.filter("key is null or t is null").select("id", "key", "t", *none))
    good = F.col("lag").isNotNull() & (F.col("lag") <= tolerance)
    keep = [F.when(good, F.col(c)).alias(c) for c in ("best", "lag", "value")]
    return found.select("id", "key", "t", *keep, F.when(good, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"))


_SIX_HOURS = 6 * 3600 * 1_000_000


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 (UTC); a time without a zone is read as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        since = F.expr(f"cast(({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00') as interval second)")
        return (since.cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(column).cast("timestamp"))


def _used(t: Column, number: Column) -> Column:
    """The contract's time: floored to six hours where the number's crc32 is odd."""
    return F.when(F.pmod(F.crc32(number.cast("string").cast("binary")), F.lit(2)) == 1, t - F.pmod(t, F.lit(_SIX_HOURS))).otherwise(t)


def op13_tolerant_asof_join(spark, sf_dir):
    """Contract query over all ``clicks`` and ``sales``."""
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    once = clicks.select("click_id", F.struct("client_id", micros(clicks, "ts").alias("t")).alias("x")).groupBy("click_id").agg(F.min("x").alias("x"))
    left = once.select(F.col("click_id").alias("id"), F.col("x.client_id").alias("key"), _used(F.col("x.t"), F.col("click_id")).alias("t"))
    cents = F.when(F.abs("total") < 1e16, F.floor(100 * F.col("total") + F.lit(0.5)))
    orders = sales.select(F.col("client_id").alias("key"), _used(micros(sales, "sold_at"), F.col("sale_id")).alias("t"), cents.cast("long").alias("value"), F.col("sale_id").alias("id"))
    twice = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) != 0
    ids = F.when(twice, F.array(F.col("id"), -1 - F.col("id"))).otherwise(F.array("id"))
    found = asof_join(left, orders.withColumn("id", F.explode(ids)))
    return found.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("t").alias("ts_us"), F.col("best").alias("sale_id"),
        F.col("lag").alias("lag_us"), F.col("value").alias("total_cents"), F.col("n").alias("n_tied"),
    )


#: The contract by a window over both tables' rows; crc32 from its polynomial.
ORACLE_SQL = """
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
c0 AS (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS t,
         xor(list_reduce(list_transform(string_split(click_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h
       FROM clicks, crc),
c AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN t - ((t % 21600000000) + 21600000000) % 21600000000 ELSE t END AS t FROM c0),
s0 AS (SELECT sale_id, client_id, epoch_us(sold_at) AS t, floor(100 * total + 0.5)::BIGINT AS cents,
         xor(list_reduce(list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h
       FROM sales, crc),
s1 AS (SELECT sale_id, client_id, cents, h, CASE WHEN h % 2 = 1 THEN t - ((t % 21600000000) + 21600000000) % 21600000000 ELSE t END AS t FROM s0),
s AS (SELECT sale_id, client_id, cents, t FROM s1 UNION ALL SELECT -1 - sale_id, client_id, cents, t FROM s1 WHERE h % 3 <> 0),
g AS (SELECT client_id, t, count(*) AS n, first(cents ORDER BY cents DESC NULLS LAST, sale_id DESC NULLS LAST) AS cents, first(sale_id ORDER BY cents DESC NULLS LAST, sale_id DESC NULLS LAST) AS sale_id
      FROM s WHERE client_id IS NOT NULL AND t IS NOT NULL GROUP BY client_id, t),
m AS (SELECT c.click_id, c.client_id, c.t, g.t AS st, g.sale_id, g.cents, g.n FROM c ASOF LEFT JOIN g ON c.client_id = g.client_id AND c.t >= g.t)
SELECT click_id, client_id, t AS ts_us, CASE WHEN t - st <= 2592000000000 THEN sale_id END AS sale_id, CASE WHEN t - st <= 2592000000000 THEN t - st END AS lag_us,
  CASE WHEN t - st <= 2592000000000 THEN cents END AS total_cents, (CASE WHEN t - st <= 2592000000000 THEN n ELSE 0 END)::BIGINT AS n_tied
FROM m
"""
