import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terralith.llm import asof


def slow(left, events, tolerance):
    out = []
    lower = lambda x: (x is not None, x or 0)
    for i, key, t in left:
        mine = [e for e in events if e[0] is not None and e[0] == key and e[1] is not None and t is not None and t - tolerance <= e[1] <= t]
        if not mine:
            out.append((i, key, t, None, None, None, 0))
            continue
        at = max(e[1] for e in mine)
        tied = [e for e in mine if e[1] == at]
        best = max(tied, key=lambda e: (lower(e[2]), lower(e[3])))
        out.append((i, key, t, best[3], t - at, best[2], len(tied)))
    return sorted(out, key=repr)


def rows(spark, left, events):
    a = spark.createDataFrame([(*r, "x", 1) for r in left], "id long, key long, t long, n string, cell int")
    b = spark.createDataFrame([(*r, "y", 2) for r in events], "key long, t long, value long, id long, base string, best int")
    return a, b


@pytest.mark.parametrize(("cell", "cuts", "shard"), [(10**6, 255, 20_000), (6, 15, 7), (3, 31, 50), (1, 15, 1000)])
def test_hot_keys_ties_and_nulls(spark, cell, cuts, shard):
    rng = random.Random(cell)
    key = lambda: rng.choice([7, 7, 7, 7, 1, 2, 3, None])
    time = lambda: rng.choice([rng.randrange(-3000, 3000), rng.randrange(-3000, 3000), 1500, 1500, -2000, None])
    left = [(i, key(), time()) for i in range(400)]
    left += [left[0], left[1], (None, 7, 10), (None, 7, 10)]
    events = [(key(), time(), rng.choice([None, 1, 2, 2]), rng.choice([None, i, i, i, 5])) for i in range(250)]
    events += [events[3], events[4], (9, 0, 1, 1)]
    left += [(9000, 9, 0), (9001, 9, 1000), (9002, 9, 1001), (9003, 9, -1)]
    got = asof.asof_join(*rows(spark, left, events), tolerance=1000, cell=cell, cuts=cuts, shard=shard)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(left, events, 1000)


def test_one_instant_holds_everything(spark):
    left = [(i, 1, 50) for i in range(300)]
    events = [(1, 50, i, i) for i in range(40)] + [(1, 49, 1, 1)]
    got = asof.asof_join(*rows(spark, left, events), tolerance=100, cell=8, cuts=15, shard=10)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(left, events, 100)


def test_empty_sides(spark):
    left, events = [(1, 1, 5)], [(1, 5, 1, 1)]
    a, b = rows(spark, left, events)
    assert [tuple(r) for r in asof.asof_join(a, b.limit(0)).collect()] == [(1, 1, 5, None, None, None, 0)]
    assert asof.asof_join(a.limit(0), b).count() == 0


def test_time_without_zone_is_utc(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 0, 5),), (datetime(1969, 12, 31, 23, 0),), (None,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in df.select(asof.micros(df, "t")).collect()] == [1710037800000005, -3600000000, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    stamped = spark.createDataFrame([(5,)], "u long").select(F.timestamp_micros("u").alias("t"))
    assert stamped.select(asof.micros(stamped, "t")).first()[0] == 5


def test_query_against_brute_force(spark):
    import zlib

    d = "/root/testdata/sf0.001"
    micros = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds()) * 10**6 + t.microsecond

    def used(t, n):
        return t if t is None or zlib.crc32(str(n).encode()) % 2 == 0 else t - t % asof._SIX_HOURS

    clicks = {r.click_id: (r.client_id, used(micros(r.ts), r.click_id)) for r in spark.read.parquet(f"{d}/clicks.parquet").collect()}
    orders = []
    for r in spark.read.parquet(f"{d}/sales.parquet").collect():
        cents = None if r.total is None else int(100 * r.total + 0.5 // 1)
        orders.append((r.client_id, used(micros(r.sold_at), r.sale_id), cents, r.sale_id))
        if zlib.crc32(str(r.sale_id).encode()) % 3:
            orders.append((*orders[-1][:3], -1 - r.sale_id))
    by = {}
    for o in orders:
        by.setdefault(o[0], []).append(o)
    got = {r.click_id: r for r in asof.op13_tolerant_asof_join(spark, d).collect()}
    assert set(got) == set(clicks)
    for i, (key, t) in clicks.items():
        want = slow([(i, key, t)], by.get(key, []), asof.TOLERANCE)[0]
        r = got[i]
        assert (r.click_id, r.client_id, r.ts_us, r.sale_id, r.lag_us) == want[:5] and r.n_tied == want[6]
        assert r.total_cents is None or abs(r.total_cents - want[5]) <= 1
