"""Exact token counts for every context limit, from one histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import ready, sums_before, texts
from nearset.llm.encode import encoded

#: Lengths of one part of the histogram when it is summed.
PART = 1024


def encoded_lengths(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, special_tokens: bool = False
) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; a null text is empty, ``end`` counts one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, n in encoded(batches, tokenizer, special_tokens=special_tokens):
            columns = [table.column("doc_id"), pa.array(n + end)]
            yield from pa.table(columns, ["doc_id", "n_tokens"]).to_batches()

    ready(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents per encoded length: (length, n_docs)."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def length_totals(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, what a context limit of that length means.

    (length, n_docs, docs_longer, docs_up_to, tokens_up_to, tokens_truncated):
    documents of the length, longer ones, those not longer and their tokens, and the
    tokens of all documents cut at the length.  Every number is exact; limits between
    two lengths follow from ``truncated_total``.  An empty histogram gives no rows.
    """
    rows = histogram.select(
        "length",
        "n_docs",
        (-F.col("length")).alias("down"),
        (F.col("length") * F.col("n_docs")).alias("tokens"),
        (-F.floor(F.col("length") / PART)).alias("part"),
    )
    summed = sums_before(rows, ["down"], {"docs_longer": "n_docs", "tokens_longer": "tokens"})
    all_docs = histogram.agg(F.sum("n_docs")).scalar()
    all_tokens = histogram.agg(F.sum(F.col("length") * F.col("n_docs"))).scalar()
    up_to = all_tokens - F.col("tokens_longer")
    return summed.select(
        "length",
        "n_docs",
        "docs_longer",
        (all_docs - F.col("docs_longer")).alias("docs_up_to"),
        up_to.alias("tokens_up_to"),
        (up_to + F.col("docs_longer") * F.col("length")).alias("tokens_truncated"),
    )


def quantile(totals: DataFrame, share: float) -> DataFrame:
    """The smallest length with at least ``share`` of the documents not longer: (length)."""
    enough = F.col("docs_up_to") >= share * (F.col("docs_up_to") + F.col("docs_longer"))
    return totals.where(enough).agg(F.min("length").alias("length"))


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """Tokens of all documents cut at ``limit``, and the documents it cuts: (tokens, docs_cut)."""
    last = F.max_by(F.struct("tokens_up_to", "docs_longer"), "length")
    fits = totals.where(F.col("length") <= limit).agg(last.alias("last"))
    every = totals.agg(F.max(F.col("docs_up_to") + F.col("docs_longer"))).scalar()
    longer = F.coalesce(F.col("last.docs_longer"), every, F.lit(0))
    tokens = F.coalesce(F.col("last.tokens_up_to"), F.lit(0)) + longer * limit
    return fits.select(tokens.alias("tokens"), longer.alias("docs_cut"))
