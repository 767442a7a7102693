"""Token ids as Parquet files: one row per document, in order of id.

Columns: doc_id, n_tokens, part and place (order of files, and of rows in a file) and
tokens, a list.
Ids are delta-encoded (or in a dictionary), ids and counts are pages of their own, row
groups and pages have set sizes, and Parquet's page indexes hold the bounds of doc_id
of each page.  A reader of a few documents or of the counts alone reads few pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearset.llm.common import ready, sums_before, texts
from nearset.llm.encode import encoded
from nearset.runtime import write_once


def token_lists(docs: DataFrame, tokenizer: str, end_id: int | None = 0, special_tokens: bool = False) -> DataFrame:
    """(doc_id, n_tokens, tokens) of (doc_id, text); ``end_id`` ends each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids, n in encoded(batches, tokenizer, end_id, special_tokens):
            places = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(ids.astype(np.int32)))
            columns = [table.column("doc_id"), pa.array(n), lists]
            yield from pa.table(columns, ["doc_id", "n_tokens", "tokens"]).to_batches(1024)

    ready(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 0,
    encoding: str = "delta",
    row_group_bytes: int = 16 << 20,
    page_rows: int = 1000,
    special_tokens: bool = False,
) -> None:
    """Encode every whole text and write the token files to ``path``, in order of id.

    Documents are placed by ranges of (id, text), so a file holds a range of ids, and
    neither one id nor one text needs to fit a task.  Null texts are empty, null ids
    come first, documents of one id stand in the order of their texts; an empty text
    is the end id alone.  ``encoding`` is "delta" or "dictionary".
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding: {encoding!r}")
    docs = texts(docs, id_col, text_col)
    placed = docs.repartitionByRange(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    lists = token_lists(placed, tokenizer, end_id, special_tokens)
    part, place = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    lists = lists.select("doc_id", "n_tokens", part, place, "tokens")
    (
        lists.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files as rows; name ``columns`` to read only those."""
    schema = "doc_id bigint, n_tokens bigint, part int, place bigint, tokens array<int>"
    files = spark.read.schema(schema).parquet(path)
    return files.select(*columns) if columns else files


def token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids_crc32) from the lists.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends, ids = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
            sums = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            columns = [
                batch.column("doc_id"),
                batch.column("part"),
                batch.column("place"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint"
    return files.select("doc_id", "part", "place", "tokens").mapInArrow(run, schema)


def token_starts(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): start is the number of ids of all documents before."""
    digests = write_once(token_digests(files), "digests")
    starts = sums_before(digests, ["place"], {"start": "n_tokens"})
    return starts.select("doc_id", "start", "n_tokens", "ids_crc32")
