"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewmill.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links: equal only if nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, get the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least")
    moved = moved.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    `edges` has two columns of one ordered type; order and repeats do not matter.
    Each round is written to the shared folder.  A node with very many links
    costs no more than they do: smallest neighbours are combined before the
    shuffle, and the joins can be split by key.
    """
    a, b = (F.col(c) for c in edges.columns)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = staged(edges.distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = staged(_small_star(_large_star(edges)), "links")
        if (new := _state(edges)) == state:
            break
        state = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
