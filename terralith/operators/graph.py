"""Connected components by alternating star contraction; every round is written, none is local."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.storage import discard, stored_at


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node of the component of every node of ``nodes(node)``.

    edges(a, b) in any direction; nodes without edges are their own root. A round removes the
    table of the round before.
    """
    now, path = stored_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        old = path
        now, path = stored_at(_small(_large(now)))
        discard(edges.sparkSession, old)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def face_components(triangles: DataFrame, by_edge: bool = True) -> DataFrame:
    """(t_id, root): components of triangles that share an edge, or (else) any vertex.

    Bodies that touch in one vertex are two by edges and one by vertices. Triangles hang on
    their smallest fellow at each edge or vertex, so shared ones give one edge each.
    """
    if by_edge:
        from terralith.operators.mesh import directed_edges

        keyed = directed_edges(triangles).select("t_id", F.least("a", "b").alias("k1"), F.greatest("a", "b").alias("k2"))
    else:
        keyed = triangles.select("t_id", F.explode(F.array("v0", "v1", "v2")).alias("k1")).withColumn("k2", F.lit(0).cast("long"))
    low = keyed.groupBy("k1", "k2").agg(F.min("t_id").alias("low"))
    edges = keyed.join(low, ["k1", "k2"]).select(F.col("t_id").alias("a"), F.col("low").alias("b"))
    return components(triangles.select(F.col("t_id").alias("node")), edges).withColumnRenamed("node", "t_id")


def component_sizes(parts: DataFrame, least: int = 1) -> DataFrame:
    """Components of at least ``least`` members, largest first (rank 1), ties by root.

    Ranks come from sorted ranges and their offsets, not from a window over all components.
    """
    from terralith.operators.mesh import dense_number

    sizes = parts.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("__last", -F.col("n"))
    return dense_number(sizes, ["__last", "root"], "rank", 1).drop("__last")


def chains(edges: DataFrame, keys: list[str], max_rounds: int = 62) -> DataFrame:
    """Directed edges (keys, a, b) in the order in which they follow each other: (keys, a, b, chain, ord, size, closed).

    At each vertex the k-th edge in (by its start) goes on as the k-th edge out (by its end).
    Edges form closed loops, or open chains where ends are left over. Lists are ranked by
    pointer doubling: an edge knows the smallest edge of the stretch ahead of it and how far it
    is, and each round joins the stretch with the one behind it, so a loop of n edges takes
    log2(n) rounds, each written and the one before removed. ``ord`` counts from the loop's
    smallest edge, or from an open chain's beginning; ``chain`` is its smallest edge (a, b).
    """
    spark = edges.sparkSession
    own = edges.select(*keys, "a", "b").distinct()
    out = own.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("b")))
    into = own.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "b").orderBy("a")))
    after = out.select(*keys, F.col("a").alias("b"), F.col("b").alias("nb"), "k")
    me = F.struct("a", "b")
    first = into.join(after, [*keys, "b", "k"], "left").select(
        *keys, "a", "b", F.when(F.col("nb").isNotNull(), F.struct(F.col("b").alias("a"), F.col("nb").alias("b"))).alias("next"),
        F.lit(1).cast("long").alias("span"), me.alias("low"), F.lit(0).cast("long").alias("at"), me.alias("last"),
    )
    now, path = stored_at(first)
    for _ in range(max_rounds):
        then = now.select(*keys, me.alias("next"), *[F.col(c).alias(f"t_{c}") for c in ("next", "span", "low", "at", "last")])
        joined = now.join(then, [*keys, "next"], "left")
        more = F.col("t_span").isNotNull()
        better = more & (F.col("t_low") < F.col("low"))
        step = joined.select(
            *keys, "a", "b", F.col("t_next").alias("next"), (F.col("span") + F.coalesce("t_span", F.lit(0))).alias("span"),
            F.when(better, F.col("t_low")).otherwise(F.col("low")).alias("low"), F.when(better, F.col("span") + F.col("t_at")).otherwise(F.col("at")).alias("at"),
            F.when(more, F.col("t_last")).otherwise(F.col("last")).alias("last"), (better | (more & F.col("t_next").isNull())).alias("changed"),
        )
        old = path
        now, path = stored_at(step)
        discard(spark, old)
        if now.filter("changed").isEmpty():
            break
        now = now.drop("changed")
    else:
        raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    closed = F.col("next").isNotNull()
    named = now.select(*keys, "a", "b", closed.alias("closed"), F.when(closed, F.col("low")).otherwise(F.col("last")).alias("mark"), "span", "at", me.alias("own"))
    sizes = named.groupBy(*keys, "closed", "mark").agg(F.count("*").alias("size"), F.min("own").alias("chain"))
    place = F.when(F.col("closed"), F.pmod(F.col("size") - F.col("at"), F.col("size"))).otherwise(F.col("size") - F.col("span"))
    return named.join(sizes, [*keys, "closed", "mark"]).select(*keys, "a", "b", "chain", place.alias("ord"), "size", "closed")
