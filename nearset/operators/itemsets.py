"""Sets held as rows: one row per (set_id, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearset.runtime import drop, only_row, write_once

# Rows of one set that may meet in one task.  Larger sets are split.
SPLIT_ROWS = 200_000


def item_rows(df: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """Name the columns ``set_id`` and ``item`` and leave everything else unread."""
    # rows with a null set or item belong to no set
    return df.select(F.col(set_col).alias("set_id"), F.col(item_col).alias("item")).where(
        F.col("set_id").isNotNull() & F.col("item").isNotNull()
    )


def unique_rows(rows: DataFrame) -> DataFrame:
    """De-duplicate (set_id, item) rows and write them once.

    Both columns decide where a row goes, so a huge set spreads over all tasks.
    The written table is narrow and serves every later step, so the input is
    read and parsed once.
    """
    return write_once(rows.dropDuplicates(["set_id", "item"]), "rows")


def largest_set(rows: DataFrame) -> int:
    """Rows of the largest set (runs one small job).

    Reads the id column only and combines on the map side.
    """
    return only_row(rows.groupBy("set_id").count().agg(F.max("count")))[0] or 0


def item_frequency(rows: DataFrame) -> DataFrame:
    """Rows per item: (item, df)."""
    return rows.groupBy("item").agg(F.count("*").alias("df"))


def set_sizes(rows: DataFrame) -> DataFrame:
    """Rows per set: (set_id, n)."""
    return rows.groupBy("set_id").agg(F.count("*").alias("n"))


def frequency_histogram(rows: DataFrame) -> DataFrame:
    """How many items have how many rows: (n_ratings, n_movies), ascending."""
    return (
        item_frequency(rows)
        .groupBy(F.col("df").alias("n_ratings"))
        .agg(F.count("*").alias("n_movies"))
        .orderBy("n_ratings")
    )


def to_sets(rows: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Nest rows into sorted arrays: (set_id, chunk, items, n_items).

    ``n_items`` is the size of the whole set.  A set above ``split_rows`` comes in
    chunks of that many items: chunk 0 holds its smallest ones, and the chunks in
    order are the set in order.  So no task ever nests more than that many items.
    """
    from nearset.operators.signatures import rank_large_sets

    rows = unique_rows(rows)
    sizes = write_once(set_sizes(rows).where(F.col("n") > split_rows), "large-sizes")
    nested = F.sort_array(F.collect_list("item")).alias("items")
    if sizes.isEmpty():
        small = rows
    else:
        small = rows.join(sizes, "set_id", "left_anti")
    whole = small.groupBy("set_id").agg(nested).select(
        "set_id", F.lit(0).alias("chunk"), "items", F.size("items").cast("bigint").alias("n_items")
    )
    if sizes.isEmpty():
        return whole
    ranked = rank_large_sets(rows.join(sizes, "set_id"), "item", split_rows)
    chunk = F.floor((F.col("rk") - 1) / F.lit(split_rows)).cast("int")
    chunks = ranked.withColumn("chunk", chunk).groupBy("set_id", "chunk", "n").agg(nested)
    return whole.unionByName(chunks.select("set_id", "chunk", "items", F.col("n").alias("n_items")))


def content_profile(rows: DataFrame) -> DataFrame:
    """Size and 128-bit order-free content hash per set: (set_id, n, h1, h2).

    Combines on the map side and never gathers a set's items.
    """
    return rows.groupBy("set_id").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("item")).alias("h1"),
        # the seed comes first, so that the two hashes of an item do not depend on each other
        F.bit_xor(F.xxhash64(F.lit("second"), "item")).alias("h2"),
    )


def content_groups(profile: DataFrame) -> DataFrame:
    """Sets with equal content, one row per group: (n, h1, h2, rep, copies).

    ``rep`` is the smallest set id of the group.
    """
    return profile.groupBy("n", "h1", "h2").agg(
        F.min("set_id").alias("rep"), F.count("*").alias("copies")
    )


def copied_sets(rows: DataFrame) -> DataFrame:
    """Sets whose content occurs more than once, written: (set_id, rep, n, copies)."""
    profile = write_once(content_profile(rows), "profile")
    # written before it is joined, so that a huge group is split over tasks
    groups = write_once(content_groups(profile).where(F.col("copies") > 1), "groups")
    copies = write_once(profile.join(groups, ["n", "h1", "h2"]).select("set_id", "rep", "n", "copies"), "copies")
    drop(profile, groups)
    return copies
