"""Connected components of a graph given by links, by alternating stars.

Each round links every node's larger neighbours to its least neighbour, and
then every node and its smaller neighbours to the least of them; rounds go on
until the links no longer change, when each node is linked to the least node
of its component. The work of a round is linear in the links. Minima are
written before they are joined, so that a node with very many links is an
ordinary skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import drop_written, written


def _towards_least(links: DataFrame, node: str, other: str) -> DataFrame:
    """links with m, the least of node and its others."""
    least = written(links.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("m")), "least")
    return links.join(least, node)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links, whose columns a and b are numbers.

    component is the least node that can be reached. Nodes with no link other
    than to themselves are left out; repeated links and either direction count
    once; rows with nulls are ignored; no links give an empty table.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_towards_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        starred = _towards_least(large, "u", "v")
        small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "small-star")
        drop_written(edges)
        drop_written(large)
        edges, before, state = after, state, _state(after)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
