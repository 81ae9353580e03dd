"""The driver's tables read as survey data; the ``*_SQL`` texts are the same for DuckDB.

obs: customers on a 40-wide grid. boxes: one box per nation. voxels: parts on a 10 x 10 grid,
top down. mesh: customers as a height field. intervals: line items as drill intervals of their
supplier, laid end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.operators.storage import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("obs_id"),
        ((k % 40) * 100.0).alias("x"),
        (F.floor(k / 40) * 100.0).alias("y"),
        F.lit(0.0).alias("z"),
        (F.col("c_acctbal") / 1000.0).alias("value"),
        F.when(F.col("c_nationkey") % 5 == 0, 0.0).otherwise(0.5).alias("std"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("line"),
    )


OBS_SQL = """obs AS (SELECT c_custkey AS obs_id, (c_custkey % 40) * 100.0::DOUBLE AS x, (c_custkey // 40) * 100.0::DOUBLE AS y, 0.0::DOUBLE AS z,
  c_acctbal / 1000.0::DOUBLE AS value, CASE WHEN c_nationkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS std, c_mktsegment AS segment, c_nationkey AS line
  FROM customer)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return read(spark, sf_dir, "nation").select(
        n.alias("group_id"), (n * 200.0).alias("cx"), (r * 300.0).alias("cy"), F.lit(-300.0).alias("cz"), F.lit(50.0).alias("half"),
        (2.3 + 0.1 * r).alias("density"), (0.01 * (1 + r)).alias("susceptibility"),
    )


BOXES_SQL = """boxes AS (SELECT n_nationkey AS group_id, n_nationkey * 200.0::DOUBLE AS cx, n_regionkey * 300.0::DOUBLE AS cy, -300.0::DOUBLE AS cz, 50.0::DOUBLE AS half,
  2.3::DOUBLE + 0.1::DOUBLE * n_regionkey AS density, 0.01::DOUBLE * (1 + n_regionkey) AS susceptibility FROM nation)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("cell_id"), (k % 10).cast("int").alias("ix"), (F.floor(k / 10) % 10).cast("int").alias("iy"), F.floor(k / 100).cast("int").alias("iz"),
        (F.col("p_size") % 4).alias("label"), (F.col("p_retailprice") / 500.0).alias("density"), (F.col("p_size") / 1000.0).alias("susceptibility"),
    )


VOXELS_SQL = """voxels AS (SELECT p_partkey AS cell_id, (p_partkey % 10)::INT AS ix, ((p_partkey // 10) % 10)::INT AS iy, (p_partkey // 100)::INT AS iz,
  p_size % 4 AS label, p_retailprice / 500.0::DOUBLE AS density, p_size / 1000.0::DOUBLE AS susceptibility FROM part)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height field: v_id on a 40-wide grid, with a freedom class by nation."""
    k = F.col("c_custkey")
    free = F.element_at(F.array(*[F.lit(x) for x in ("FIXED", "Z_ONLY", "XY_FREE", "XYZ_FREE", "Z_ONLY")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(
        k.alias("v_id"), ((k % 40) * 100.0).alias("x"), (F.floor(k / 40) * 100.0).alias("y"), (-F.col("c_acctbal") / 10.0).alias("z"), free.alias("freedom")
    )


VERTICES_SQL = """vertices AS (SELECT c_custkey AS v_id, (c_custkey % 40) * 100.0::DOUBLE AS x, (c_custkey // 40) * 100.0::DOUBLE AS y, -c_acctbal / 10.0::DOUBLE AS z,
  (['FIXED','Z_ONLY','XY_FREE','XYZ_FREE','Z_ONLY'])[(c_nationkey % 5 + 1)::INT] AS freedom FROM customer)"""


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for every cell of the height field whose four vertices exist."""
    from terralith.operators.mesh import grid_triangles

    return grid_triangles(vertices(spark, sf_dir).select("v_id"), 40)


TRIANGLES_SQL = """cells AS (SELECT a.c_custkey AS v FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 41 WHERE a.c_custkey % 40 < 39),
triangles AS (SELECT 2 * v AS t_id, v AS v0, v + 1 AS v1, v + 41 AS v2 FROM cells UNION ALL SELECT 2 * v + 1, v, v + 41, v + 40 FROM cells)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of holes, dealt by hole and number: depth runs on by quantity, property is the discount."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    to = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return dealt(read(spark, sf_dir, "lineitem"), "l_suppkey").select(
        F.col("l_suppkey").alias("hole_id"), (to - F.col("l_quantity")).alias("from_m"), to.alias("to_m"), F.col("l_returnflag").alias("grp"),
        (F.col("l_discount") * 10 + 2.0).alias("density"), F.col("l_tax").alias("susceptibility"),
    )


INTERVALS_SQL = """laid AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS to_m FROM lineitem),
intervals AS (SELECT l_suppkey AS hole_id, to_m - l_quantity AS from_m, to_m, l_returnflag AS grp, l_discount * 10 + 2.0::DOUBLE AS density, l_tax AS susceptibility FROM laid)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as points of their first three components."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_id"), *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")], "label")


POINTS_SQL = "points AS (SELECT vec_id AS p_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster properties: one per nation, every third without a group."""
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        n.alias("cluster_id"), F.col("n_name").alias("working_name"), (n * 7 % 25 + 10).cast("long").alias("sample_count"),
        (2.4 + n * 11 % 25 * 0.03).alias("density"), (n * 3 % 25 * 0.004).alias("susceptibility"),
    )


CLUSTERS_SQL = """clusters AS (SELECT n_nationkey AS cluster_id, n_name AS working_name, (n_nationkey * 7 % 25 + 10)::BIGINT AS sample_count,
  2.4::DOUBLE + n_nationkey * 11 % 25 * 0.03::DOUBLE AS density, n_nationkey * 3 % 25 * 0.004::DOUBLE AS susceptibility FROM nation)"""
