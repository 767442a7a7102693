"""A corpus pipeline over ``documents``: each stage works on what the one before kept.

Rows are told apart by id, and by id and text where an id is null or names several texts.
So a row goes only by its own text, and no row for another of its id.  Null texts are
empty.  Labels of an id that names several texts teach nothing, as they may mean any of
them.  An empty table of documents gives none; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearset.llm.common import ROW_KEY, kept_rows, row_keys, table
from nearset.llm.decontaminate import clean_documents
from nearset.llm.gbdt import quality_scores
from nearset.llm.minhash import near_duplicates
from nearset.llm.packing import pack, token_pieces
from nearset.llm.queries import tokenizer
from nearset.llm.rules import quality_rules
from nearset.runtime import write_once


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees score below 0.7 go; without labels all go, at a score of 0.5."""
    keyed = row_keys(docs)
    scored = quality_scores(keyed, table(spark, sf_dir, "labels"), id_col=ROW_KEY)
    return kept_rows(keyed, scored.where("predicted = 0"), ROW_KEY).drop(ROW_KEY)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned one go; without labels the base rule alone decides."""
    keyed = row_keys(docs)
    judged, _ = quality_rules(keyed, table(spark, sf_dir, "labels"), id_col=ROW_KEY)
    return kept_rows(keyed, judged.where("NOT kept"), ROW_KEY).drop(ROW_KEY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest key; of repeated rows, one."""
    keyed = row_keys(docs)
    linked = near_duplicates(keyed, id_col=ROW_KEY, words=5, percent=80)
    rest = kept_rows(keyed, linked.where("NOT kept"), ROW_KEY)
    again = linked.where("kept").groupBy("doc_id").count().where("count > 1")
    again = write_once(again.select("doc_id"), "again")
    if again.isEmpty():
        return rest.drop(ROW_KEY)
    once = rest.join(again, rest[ROW_KEY] == again["doc_id"], "left_semi").dropDuplicates([ROW_KEY])
    return kept_rows(rest, again, ROW_KEY).unionByName(once).drop(ROW_KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; without items all stay."""
    return clean_documents(row_keys(docs), table(spark, sf_dir, "benchmark"), ROW_KEY).drop(ROW_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its sequence and place; an empty text is its end id."""
    return pack(token_pieces(docs, tokenizer("word_bpe_49k.json"), 2048), 2048, ["doc_id", "piece"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models and tokenizers have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
