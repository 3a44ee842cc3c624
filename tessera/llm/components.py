"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not its component's smallest node.

    Each round points the neighbours of a node at the smallest of them (large
    star), then does the same among smaller neighbours (small star); minima are
    pre-aggregated on the map side and the rows that meet a busy node are only
    joined, so adaptive execution can split them. Nulls, loops and repeated
    edges are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = scratch.write(e, f"{label}0")
    seen, step = _digest(e), 0
    while seen[0]:
        step += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"{label}{step}l")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{label}{step}s")
        scratch.drop(f"{label}{step}l")
        scratch.drop(f"{label}0" if step == 1 else f"{label}{step - 1}s")
        e, now = small, _digest(small)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.x, row.s
