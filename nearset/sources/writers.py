"""Writing pairs, statistics and user-bucketed ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearset.functions import text as T


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Pairs as text ``(a,b)``: (value)."""
    return pairs.select(
        F.concat(
            F.lit("("), F.col("id_a").cast("string"), F.lit(","), F.col("id_b").cast("string"), F.lit(")")
        ).alias("value")
    )


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write pairs as "parquet" or "csv" (all columns) or as "text" lines ``(a,b)``.

    An earlier result at ``path`` is replaced.
    """
    if fmt == "text":
        pair_lines(pairs).write.mode("overwrite").text(path)
    elif fmt in ("parquet", "csv"):
        pairs.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}")


def write_stats(stats: DataFrame, path: str) -> None:
    """Write bucket sizes, histograms or counters as CSV, replacing earlier ones."""
    stats.write.mode("overwrite").csv(path)


def bucketed(ratings: DataFrame, buckets: int = 1000, key: str = "user") -> DataFrame:
    """Add ``bucket``: the key modulo the number of buckets."""
    return ratings.withColumn("bucket", T.bucket_of(F.col(key), buckets))


def write_bucketed(ratings: DataFrame, path: str, buckets: int = 1000, key: str = "user") -> None:
    """One folder of CSV files per bucket of users, replacing earlier ones.

    Rows are gathered by bucket so that a bucket gets few files; the rebalance
    hint lets adaptive execution cut a bucket that is much larger than others.
    """
    (
        bucketed(ratings, buckets, key)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", key)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .csv(path)
    )


def preview(df: DataFrame, *order: str, rows: int = 10) -> DataFrame:
    """The first rows in a given order."""
    return df.orderBy(*order).limit(rows)
