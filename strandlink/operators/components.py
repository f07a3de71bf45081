"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.plans.stages import drop, materialize


def _star(pairs: DataFrame, keep_up: bool) -> DataFrame:
    """One star step over directed ``pairs(u, v)``: every neighbour of ``u`` (and for the small star ``u``)
    is linked to the least vertex around ``u``.  The least vertex is a partial aggregate, and the join back
    has one row for each key on its right side, so a hot vertex can be split by adaptive execution."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if keep_up:  # large star: only neighbours above u move
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _ordered(edges: DataFrame, src: str, dst: str) -> DataFrame:
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def contract(cur: DataFrame) -> DataFrame:
    """One round, a large star and a small star, over edges ``(a, b)`` with ``a > b``: edges of the same components.

    Copies of an edge change nothing; the edges of the large star keep theirs, which the small star's distinct drops.
    """
    both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        cur.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    large = _star(both, True).filter("a != b")
    return _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).filter("a != b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex with an edge to another vertex; ``component`` is the least id.

    Self-loops, repeated edges and nulls carry no information and are ignored.  Vertices without edges are
    not returned: callers attach them with a left join.  Each round writes its edges to the shared folder.
    Rounds are O(log^2 n) in the longest path in theory and a handful in practice.
    """
    cur = materialize(_ordered(edges, src, dst), "cc")
    seen = None
    for _ in range(max_rounds):
        nxt = materialize(contract(cur), "cc")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = pairs.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.union(roots)
