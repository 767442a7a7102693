"""Connected components by alternating large-star and small-star.

Kiveris et al., Connected Components in MapReduce and Beyond, 2014.  Neighbours are
never gathered: a step takes the smallest neighbour of each node as an aggregate,
writes it, and joins the edges with it, so that a hub is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearset.runtime import write_once


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # without its own minimum a node that has larger neighbours only changes nothing
    least = write_once(least, "least")
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = write_once(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("m").alias("a"), "b").unionAll(moved)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Repeated edges, edges in either direction and loops are allowed; rows with a
    null end are no edges.  Without edges the result is empty.
    """
    edges = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = write_once(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = write_once(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    # at the end every edge leads to the smallest node
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.unionAll(roots)
