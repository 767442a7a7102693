"""The similarity join for sets too large to nest in one row.

Everything stays in (set, item) rows: positions come from a cluster-wide sort,
overlaps from counting joined rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators.blocks import blocked_sides
from nearset.operators.itemsets import set_sizes
from nearset.operators.signatures import Scheme, rank_large_sets
from nearset.runtime import write_once


def _part(parts: int) -> Column:
    """Part of its set a row belongs to, so that no task gets a whole large set."""
    return F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")


def _every_part(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def set_apart(
    rows: DataFrame, members: DataFrame | None, scheme: Scheme, split_rows: int, parts: int
) -> tuple[DataFrame, DataFrame]:
    """(rows of the other sets, rows of sets that may pair with a large one).

    Both hold one representative per content.  The second part has ``n`` and starts
    at ``threshold * split_rows`` items.  Rows are matched on (set_id, part of the
    items), so the rows of one huge set stay spread out.
    """
    rows = rows.withColumn("part", _part(parts))
    keys = ["set_id", "part"]
    sizes = set_sizes(rows)
    away = sizes.where(F.col("n") > split_rows).select("set_id")
    near = sizes.where(F.col("n") >= math.floor(scheme.threshold * split_rows))
    if members is not None:
        repeats = members.where(F.col("set_id") != F.col("rep")).select("set_id")
        away = away.unionByName(repeats).distinct()
        near = near.join(repeats, "set_id", "left_anti")
    others = rows.join(away.withColumn("part", _every_part(parts)), keys, "left_anti")
    near_rows = rows.join(near.withColumn("part", _every_part(parts)), keys)
    return others.drop("part"), near_rows.drop("part")


def large_candidates(
    rows: DataFrame, scheme: Scheme, split_rows: int, block_rows: int
) -> DataFrame:
    """Pairs that share enough prefix items and of which one set is large.

    Out: (a, b, n_a, n_b, copies_a, copies_b, shared).
    """
    ranked = rank_large_sets(rows, scheme.order, split_rows)
    prefix = ranked.where((F.col("rk") <= scheme.prefix(F.col("n"))) & (F.col("df") != 1))
    # written before it is joined, so that a hot item is split over tasks
    prefix = write_once(prefix, "prefix")
    holders = write_once(prefix.groupBy("item").agg(F.count("*").alias("rows")), "holders")
    left, right = blocked_sides(prefix.join(holders, "item"), "set_id", "rows", block_rows)
    keys = ["item", "left_block", "right_block"]

    def side(df: DataFrame, name: str) -> DataFrame:
        columns = {"set_id": name, "n": f"n_{name}", "copies": f"copies_{name}", "rk": f"rk_{name}"}
        return df.select(*keys, *[F.col(c).alias(as_) for c, as_ in columns.items()])

    n_a, n_b = F.col("n_a"), F.col("n_b")
    near = (
        ((n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b"))))
        & S.length_filter(n_a, n_b, scheme.threshold)
        & (n_b > split_rows)
    )
    if scheme.length_classes:
        near = near & F.arrays_overlap(scheme.classes(n_a), scheme.classes(n_b))
    # the bound is largest at the first shared item, which is the one it holds for
    bound = S.overlap_bound(n_a, F.col("rk_a"), n_b, F.col("rk_b"), F.lit(1))
    return (
        side(left, "a")
        .join(side(right, "b"), keys)
        .where(near)
        .groupBy("a", "b", "n_a", "n_b", "copies_a", "copies_b")
        .agg(F.count("*").cast("int").alias("shared"), F.max(bound).alias("bound"))
        .where(F.col("shared") >= scheme.size)
        .where(F.col("bound") >= S.required_overlap(n_a, n_b, scheme.threshold))
        .drop("bound")
    )


def similar_large_sets(
    rows: DataFrame, scheme: Scheme, split_rows: int, block_rows: int
) -> DataFrame:
    """Similar pairs with at least one large set (schema of the nested join)."""
    pairs = large_candidates(rows, scheme, split_rows, block_rows)
    largest = rows.agg(F.max("n")).first()[0]
    parts = math.ceil(largest / split_rows)
    smaller = rows.select(F.col("set_id").alias("a"), "item", _part(parts).alias("part"))
    larger = rows.select(F.col("set_id").alias("b"), "item")
    return (
        pairs.withColumn("part", _every_part(parts))
        .join(smaller, ["a", "part"])
        .join(larger, ["b", "item"])
        .groupBy(*pairs.columns)
        .agg(F.count("*").cast("int").alias("overlap"))
        .withColumn("jaccard", S.jaccard(F.col("overlap"), F.col("n_a"), F.col("n_b")))
        .where(F.col("jaccard") >= F.lit(float(scheme.threshold)))
    )
