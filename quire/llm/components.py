"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_dir, materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(2**40 - 1))).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, of every node of edges (a, b) but the roots themselves.

    a and b have any type with an order. Every step shuffles the edges once and ends in a table in the shared folder, which cuts
    the lineage; the table of the step before is dropped. The number of edges never grows, and the steps are as many as the
    logarithm of the number of nodes in a component at most, squared.
    """
    spark = edges.sparkSession
    to_b = Window.partitionBy("a")
    edges, at = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.select("a", "b", F.least("a", F.min("b").over(to_b)).alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = down.select("a", "b", F.min("b").over(to_b).alias("m"))
        edges, new = materialize(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop_dir(spark, at)
        at = new
        before, seen = seen, _mark(edges)
        if seen == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
