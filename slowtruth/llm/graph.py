"""Connected components of a table of edges, by alternating stars.

Every round hooks the larger neighbours of a node to its smallest one, then the smaller ones, so the number
of rounds grows with the logarithm of the longest chain. Edges stay rows: no node's neighbours are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtruth.session import materialize

MAX_ROUNDS = 60
PARTITION_EDGES = 500_000


def _hook(edges: DataFrame, parts: int) -> DataFrame:
    """Point all neighbours below ``u`` (edges with u > v), and u itself, to the smallest of them."""
    edges = _packed(edges, parts)
    least = _least(edges.groupBy("u").agg(F.min("v").alias("m")), parts)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    both = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return _packed(both.where("u > v"), parts).distinct()


def _raise(edges: DataFrame, parts: int) -> DataFrame:
    """Point all neighbours above ``u`` to the smallest of u and its neighbours."""
    sides = _packed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts)
    least = _least(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), parts)
    moved = sides.where("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _packed(df: DataFrame, parts: int) -> DataFrame:
    """Edges that fit one partition stay in one, where no step needs an exchange."""
    return df.coalesce(1) if parts == 1 else df


def _least(df: DataFrame, parts: int) -> DataFrame:
    """Written if it is joined by an exchange, so that a node with very many edges can be split there."""
    return df if parts == 1 else materialize(df, "least")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge: the smallest node it is connected with.

    Self-loops count as nodes; null ends are left out. Repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = now.where("u = v").select(F.col("u").alias("node"))
    now, mark = now.where("u > v"), None
    parts = -(-now.count() // PARTITION_EDGES) or 1
    for _ in range(MAX_ROUNDS):
        now = materialize(_hook(materialize(_raise(now, parts), "raised"), parts), "hooked")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root")
    loops = nodes.select("node", F.col("node").alias("root")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots).unionByName(loops).distinct()
