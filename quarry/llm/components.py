"""Connected components of a link table by alternating large-star and small-star rounds; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let_go, written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b) the smallest node of its component. Any ordered column type.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest; the rounds end when the edges
    are stars, which a look at the edges alone tells. Minima are aggregates, so a node with very many links is combined
    before the shuffle. Self-links are ignored; an empty table gives an empty table. Tables of each round are written to
    the shared folder.
    """
    edges = written(_undirected(links).distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        edges = written(_star(_star(edges, larger=True), larger=False).distinct(), "edges")
        let_go(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    # Every edge now runs from a node (a) to the smallest node of its component (b).
    own = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return own.unionByName(roots)


def _undirected(links: DataFrame) -> DataFrame:
    """Edges with the larger node first."""
    return links.where(F.col("a") != F.col("b")).select(F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a") > F.col("b"), F.col("b")).otherwise(F.col("a")).alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges, the larger node first, are stars: a node that hangs on another has no second edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and n > 1").count()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each node's larger neighbours (large star) or itself and its smaller ones (small star) to its smallest neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.when(F.col("m") < F.col("a"), F.col("m")).otherwise(F.col("a")).alias("m"))
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b"))
