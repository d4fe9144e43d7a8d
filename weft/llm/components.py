"""Connected components of a distributed list of links, by alternating large-star and small-star steps
(Kiveris and others, Connected components in MapReduce and beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). large: each node's larger neighbours go to the least of its neighbourhood;
    else the smaller neighbours and the node itself do. Least neighbours come from an aggregate with partial sums,
    and the join back holds no other operator, so that a node with very many links is split, not gathered."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # (node n, larger neighbour): n is the b of an edge
        out = edges.join(least, edges["b"] == least["n"]).select(F.col("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = edges.join(least, edges["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.where("a <> b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every node that has a link to another, the least node that can be reached.

    Links are two bigint columns in any direction; repeated links, links of a node to itself and links with a null
    end count for nothing. No links give an empty table. Each round is written to the shared folder."""
    ends = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges = written(ends.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "links")
    sign = _sign(edges)
    while sign[0]:
        step = written(_star(_star(edges, True), False), "links")
        before, sign = sign, _sign(step)
        forget(edges)
        edges = step
        if sign == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _sign(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of edges."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), F.coalesce(total, F.lit(0))).head())
