"""Rare-first order, prefixes and signatures of sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators.itemsets import (
    SPLIT_ROWS,
    item_frequency,
    largest_set,
    set_sizes,
    unique_rows,
)
from nearset.runtime import is_written, write_once


# Rows that one task ranks, where the session's shuffle partitions would hold more.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Scheme:
    """What makes two sets candidates of each other.

    ``size``           items per signature.  1 is exact; from 2 on, pairs that
                       share fewer prefix items are missed.
    ``length_classes`` None, "reference" (two classes, can miss pairs) or
                       "complete".
    ``order``          "frequency" (rare items first) or "item".
    ``prefix_items``   a fixed number of rarest items instead of the length
                       the threshold asks for; can miss pairs.
    ``adaptive``       signatures of one or two items, chosen for each set; exact.
    """

    threshold: float = 0.9
    size: int = 1
    length_classes: str | None = None
    order: str = "frequency"
    prefix_items: int | None = None
    adaptive: bool = False

    def __post_init__(self):
        if not 0.0 < self.threshold <= 1.0:
            raise ValueError("threshold must be above 0 and at most 1")
        if self.size < 1:
            raise ValueError("signature size must be at least 1")
        if self.length_classes not in (None, "reference", "complete"):
            raise ValueError(f"unknown length class mode: {self.length_classes!r}")
        if self.order not in ("frequency", "item"):
            raise ValueError(f"unknown item order: {self.order!r}")
        if self.prefix_items is not None and self.prefix_items < self.size:
            raise ValueError("prefix_items must be at least the signature size")
        if self.adaptive and (self.size, self.length_classes, self.order, self.prefix_items) != (1, None, "frequency", None):
            raise ValueError("adaptive signatures set the size themselves and need the order by frequency")

    def prefix(self, n: Column) -> Column:
        """Prefix length of a set of ``n`` items, never beyond the set itself."""
        if self.prefix_items is not None:
            return F.least(n, F.lit(self.prefix_items).cast("bigint"))
        return F.least(n, S.prefix_length(n, self.threshold, self.size))

    def classes(self, n: Column) -> Column:
        return S.length_classes(n, self.threshold, self.length_classes)


def with_classes(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Add ``classes``, if the scheme has length classes: worked out once for each size ``n``."""
    if scheme.length_classes is None:
        return sets
    sizes = write_once(sets.select("n").distinct(), "sizes")
    return sets.join(write_once(sizes.withColumn("classes", scheme.classes(F.col("n"))), "classes"), "n")


def _order_columns(order: str) -> list[str]:
    return ["df", "item"] if order == "frequency" else ["item"]


def rank_large_sets(rows: DataFrame, order: str, split_rows: int) -> DataFrame:
    """Add ``rk`` to rows of sets too large to sort in one task.

    The rows are sorted once across the cluster by (set, order), into ranges of
    about ``split_rows`` rows (or of up to SPLIT_ROWS, where that would be more ranges than
    the session has shuffle partitions); each range is then numbered by itself and shifted
    by the rows of the same set in earlier ranges.  The sorted rows are written
    once, so both steps see the same range boundaries.
    """
    columns = _order_columns(order)
    count = rows.count()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(math.ceil(count / split_rows), max(partitions, math.ceil(count / SPLIT_ROWS))))
    sorted_rows = write_once(
        rows.repartitionByRange(ranges, "set_id", *columns).withColumn(
            "part", F.spark_partition_id()
        ),
        "sorted-rows",
    )
    # one row per (set, range)
    before = W.partitionBy("set_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sorted_rows.groupBy("set_id", "part")
        .agg(F.count("*").alias("rows"))
        .select(
            "set_id", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
        )
    )
    inside = W.partitionBy("set_id", "part").orderBy(*columns)
    return (
        sorted_rows.join(offsets, ["set_id", "part"])
        .withColumn("rk", F.row_number().over(inside) + F.col("offset"))
        .drop("part", "offset")
    )


def _by_set(rows: DataFrame, count: int) -> DataFrame:
    """Rows dealt out by set, if ``count`` rows are too many for the session's partitions."""
    if count <= TASK_ROWS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(math.ceil(count / TASK_ROWS), "set_id")


def rank_items(
    rows: DataFrame,
    order: str = "frequency",
    split_rows: int = SPLIT_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Position of every item in its set's order: (set_id, item, df, n, rk).

    ``unique`` promises that the rows are distinct already.
    """
    # written once, as the rows are read several times
    if not unique:
        rows = unique_rows(rows)
    elif not is_written(rows):
        rows = write_once(rows, "rows")
    columns = ["set_id", "item", "df", "n", "rk"]
    # and the frequencies before they are joined, so that a hot item is split over tasks
    with_df = rows.join(write_once(item_frequency(rows), "frequency"), "item")
    by_order = W.partitionBy("set_id").orderBy(*_order_columns(order))
    if largest_set(rows) <= split_rows:
        whole_set = W.partitionBy("set_id")
        # the places first: their order serves the count as well, so rows are sorted once
        return (
            _by_set(with_df, rows.count()).withColumn("rk", F.row_number().over(by_order).cast("bigint"))
            .withColumn("n", F.count("*").over(whole_set))
            .select(columns)
        )
    with_n = with_df.join(write_once(set_sizes(rows), "sizes"), "set_id")
    small = with_n.where(F.col("n") <= split_rows)
    large = with_n.where(F.col("n") > split_rows)
    return (
        small.withColumn("rk", F.row_number().over(by_order).cast("bigint"))
        .select(columns)
        .unionByName(rank_large_sets(large, order, split_rows).select(columns))
    )


def prefix_rows(ranked: DataFrame, scheme: Scheme) -> DataFrame:
    """Keep the rows of each set's prefix."""
    return ranked.where(F.col("rk") <= scheme.prefix(F.col("n")))


def rarest_items(ranked: DataFrame, count: int) -> DataFrame:
    """The ``count`` rarest items of each set."""
    return ranked.where(F.col("rk") <= count)


def combine_prefix(sets: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """All ``size``-combinations of the first ``p`` items, in prefix order.

    ``sets`` has ``items``, ``p`` and ``skip`` (leading items to leave out).
    Adds ``sig`` (the combination) and ``last`` (position of its last item).
    Works inside each row: one explode per item of the combination, no shuffle.
    """
    out = sets.withColumns(
        {"last": F.col("skip").cast("int"), "sig": F.slice("items", 1, 0)}
    )
    for i in range(size):
        # leave room in the prefix for the items still to come
        room = F.greatest(F.col("p").cast("int") - F.lit(size - 1 - i) - F.col("last"), F.lit(0))
        out = out.select(
            *keep,
            "items",
            "p",
            "sig",
            "last",
            F.posexplode(F.slice("items", F.col("last") + 1, room)).alias("step", "next"),
        ).select(
            *keep,
            "items",
            "p",
            F.array_append("sig", F.col("next")).alias("sig"),
            (F.col("last") + F.col("step") + 1).alias("last"),
        )
    return out.drop("items", "p")


def nest_prefix(prefix: DataFrame) -> DataFrame:
    """Nest prefix rows into one row per set: (set_id, n, items), items in order.

    Ranked rows lie in the order of their sets already.  A window keeps to it, where an
    aggregate would hold and sort all rows of a task again.
    """
    pairs = F.collect_list(F.struct("rk", "item")).over(W.partitionBy("set_id"))
    return (
        prefix.withColumn("pairs", pairs)
        .where(F.col("rk") == 1)
        .select("set_id", "n", F.sort_array("pairs")["item"].alias("items"))
    )


def combine_rows(prefix: DataFrame, size: int, block_rows: int) -> DataFrame:
    """All ``size``-combinations of prefixes too long to nest: (set_id, n, sig).

    Pairs every combination so far with the later items of its set.  Both sides
    are cut into blocks of positions, so a task meets ``block_rows`` by
    ``block_rows`` rows at most per block pair.
    """
    block = F.floor((F.col("rk") - 1) / F.lit(block_rows))
    items = prefix.select("set_id", "n", "rk", "item", block.alias("block"))
    blocks = F.floor((F.col("rks") - 1) / F.lit(block_rows))
    rows_of = prefix.groupBy("set_id").agg(F.max("rk").alias("rks"))
    last_block = rows_of.select("set_id", blocks.alias("last_block"))
    items = items.join(last_block, "set_id")
    later = items.select(
        "set_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("from_block"),
        F.col("block").alias("to_block"),
        F.col("rk").alias("next_rk"),
        F.col("item").alias("next"),
    )
    out = items.withColumn("sig", F.array("item"))
    for _ in range(size - 1):
        out = (
            out.withColumn("to_block", F.explode(F.sequence("block", "last_block")))
            .withColumnRenamed("block", "from_block")
            .join(later, ["set_id", "from_block", "to_block"])
            .where(F.col("next_rk") > F.col("rk"))
            .select(
                "set_id",
                "n",
                "last_block",
                F.col("next_rk").alias("rk"),
                F.col("to_block").alias("block"),
                F.array_append("sig", F.col("next")).alias("sig"),
            )
        )
    return out.select("set_id", "n", "sig")


def signature_rows(
    ranked: DataFrame, scheme: Scheme, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Signatures of every set: (set_id, n, sig, class).

    All ``size``-combinations of the prefix; a prefix shorter than that is
    itself the only signature.  With length classes, one copy per class;
    without, ``class`` is 0.
    """
    prefix = prefix_rows(ranked, scheme)
    if scheme.size == 1:
        signed = prefix.select("set_id", "n", F.array("item").alias("sig"))
    else:
        long = scheme.prefix(F.col("n")) > split_rows
        sets = nest_prefix(prefix.where(~long)).withColumns({"p": F.size("items"), "skip": F.lit(0)})
        short = F.col("p") < scheme.size
        combined = combine_prefix(sets.where(~short), scheme.size, ["set_id", "n"])
        signed = (
            combined.select("set_id", "n", "sig")
            .unionByName(sets.where(short).select("set_id", "n", F.col("items").alias("sig")))
            .unionByName(combine_rows(prefix.where(long), scheme.size, split_rows))
        )
    if scheme.length_classes is None:
        return signed.withColumn("class", F.lit(0).cast("bigint"))
    return signed.withColumn("class", F.explode(scheme.classes(F.col("n"))))


def make_signatures(
    ranked: DataFrame, scheme: Scheme, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Signatures as text, ``[<class>_]item;item;...``: (set_id, signature)."""
    in_class = F.col("class") if scheme.length_classes else None
    return signature_rows(ranked, scheme, split_rows).select(
        "set_id", S.signature_text(F.col("sig"), in_class).alias("signature")
    )
