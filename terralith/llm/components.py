"""Connected components by alternating star contraction, without driver-side graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import discard, few_files, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct edges (a, b) with a > b.

    Large: every node hands its larger neighbours to its smallest one. Small: every node hands
    its smaller neighbours, and itself, to its smallest one. Both keep the components and need
    one grouped minimum (combined before the shuffle) and one join that adaptive execution
    may split where a node has very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        joined = both.filter("b > a").join(low, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = joined.unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Nodes without an edge are not listed (their root is themselves). Self-loops, repeated and
    null ends are ignored. Each round writes its edges to the shared folder and removes those before; the loop ends
    when two rounds give the same edges, compared by count and an order-free checksum. ``rows``:
    about how many edges there are, if that is known; tables are written in as few files as
    their rows are worth.
    """
    spark = edges.sparkSession
    clean = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(clean if rows is None else few_files(clean, rows))
    count, before = now.count(), None
    for _ in range(max_rounds):
        old = path
        now, path = stored(few_files(_star(_star(now, large=True), large=False), count))
        discard(spark, old)
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
        ).first()
        if seen == before:
            break
        count, before = seen["n"], seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
