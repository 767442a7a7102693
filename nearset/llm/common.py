"""Helpers that several operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearset.runtime import write_once

#: Word separators, as a Java and SQL character class: ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text is empty.  Other columns are not read."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


#: Column that ``row_keys`` adds.
ROW_KEY = "_row_key"


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a bigint that names each row's document, in the column ROW_KEY.

    It is the id, or, where an id is null or names several different texts, a negative
    hash of id and text.  So repeated rows share a key and other rows do not.  Only the
    ids of all rows are grouped; texts are read again for ids that come more than once.
    """
    key, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    again = docs.groupBy(key.alias("again_id")).count().where("count > 1 AND again_id IS NOT NULL")
    again = write_once(again.select("again_id"), "again")
    hashes = docs.select(key.alias("several_id"), F.xxhash64(text).alias("h"))
    hashes = hashes.join(again, hashes["several_id"] == again["again_id"], "left_semi").groupBy("several_id")
    several = hashes.agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    several = write_once(several.select("several_id"), "several")
    hashed = F.xxhash64(key, text).bitwiseOR(F.lit(-(1 << 63)))
    own = F.when(several["several_id"].isNotNull() | key.isNull(), hashed).otherwise(key)
    joined = docs.join(several, key == several["several_id"], "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], own.alias(ROW_KEY))


def kept_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` without those whose id is a doc_id of ``gone``; rows without an id stay.

    The ids are written first, so that Spark sees their size before it joins.
    """
    ids = write_once(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(ids, docs[id_col] == ids["gone_id"], "left_anti")


def ready(spark: SparkSession, rows: int = 256) -> None:
    """Before texts go to Python workers.

    At most ``rows`` texts and 32 MB go there at a time, as some are very long.  Workers on
    this machine find the package where the driver found it; a cluster ships it
    with ``--py-files`` or has it installed.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(name, "32m")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, without bringing a key into one task.

    ``df`` must be a written table with a column ``part`` that splits each key into
    pieces of bounded size.  Rows are numbered within (key, part), and each part
    starts at the number of rows of the parts before it.
    """
    from pyspark.sql import Window as W

    sizes = df.groupBy(*keys, "part").agg(F.count("*").alias("size"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order)) - 1
    numbered = df.withColumn("inside", inside)
    return (
        numbered.join(starts, [*keys, "part"])
        .withColumn(name, (F.col("first") + F.col("inside")).cast("bigint"))
        .drop("first", "inside")
    )


def sums_before(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, for each name of ``values``, the sum of its column over all earlier rows.

    Rows are ordered by ``part`` and then by ``order``, which must order the rows of
    a part fully.  A part is summed by one task, so parts must be of bounded size;
    of the parts only their totals meet.
    """
    from pyspark.sql import Window as W

    total = [F.sum(v).alias(f"{k}_all") for k, v in values.items()]
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy("part").agg(*total)
    starts = starts.select(
        "part", *[F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_all") for k in values]
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = df.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    out = summed.join(starts, "part")
    added = {k: (F.col(k) + F.col(f"{k}_all")).cast("bigint") for k in values}
    return out.withColumns(added).drop(*[f"{k}_all" for k in values])
