"""Reading rating files, per-item header files and N-Triples text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.functions import text as T

RATINGS = "user INT, movie INT"


def empty_ratings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RATINGS)


def parse_ratings(lines: DataFrame, with_rating: bool = False, kind: str = "int") -> DataFrame:
    """Lines ``user,movie[,rating,...]`` as columns; further fields are ignored.

    ``kind`` is the type of the ids; "bigint" for ids beyond 32 bits.
    """
    value = F.col("value")
    columns = [
        T.number_field(value, 0, kind).alias("user"),
        T.number_field(value, 1, kind).alias("movie"),
    ]
    if with_rating:
        columns.append(T.number_field(value, 2).alias("rating"))
    return lines.select(columns)


def read_ratings(
    spark: SparkSession, paths: str | list[str], with_rating: bool = False, kind: str = "int"
) -> DataFrame:
    """Rating files: (user, movie[, rating]).  Folders and globs work as well."""
    return parse_ratings(spark.read.text(paths), with_rating, kind)


def read_item_files(
    spark: SparkSession, paths: str | list[str], kind: str = "int"
) -> DataFrame:
    """Files of blocks ``item:`` followed by lines ``user,rating[,...]``.

    Out: (user, movie, rating).  A file may be larger than one task should read:
    each file split finds the header of its own lines, and the lines before its
    first header take the last header of the splits before.
    """
    lines = (
        spark.read.text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        )
        # ascending within a split, which one task reads in order
        .withColumn("seq", F.monotonically_increasing_id())
        .where(F.trim("value") != "")
    )
    value = F.col("value")
    header = F.when(T.is_header(value), T.header_id(value, kind))
    lines = lines.withColumn("header", header)
    of_split = W.partitionBy("file", "start").orderBy("seq")
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        lines.groupBy("file", "start")
        .agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("seq"))).alias("last"))
        .select(
            "file", "start", F.last("last", ignorenulls=True).over(earlier).alias("carried")
        )
    )
    inside = lines.withColumn(
        "inside", F.last("header", ignorenulls=True).over(of_split.rowsBetween(W.unboundedPreceding, 0))
    ).where(F.col("header").isNull())
    return inside.join(carried, ["file", "start"]).select(
        T.number_field(value, 0, kind).alias("user"),
        F.coalesce("inside", "carried").alias("movie"),
        T.number_field(value, 1).alias("rating"),
    )


def parse_ntriples(lines: DataFrame, mode: str = "default") -> DataFrame:
    """Statements ``<subject> <predicate> "text"@lang .`` as columns.

    ``"default"``    (subject, predicate, text, lang); escaped quotes stay inside
                     the text, escapes are not decoded.
    ``"reference"``  (subject, text) by plain splitting: the subject keeps its
                     closing ``> `` and the text ends at the first quote.
    Comment lines are left out, and in the default mode so are lines without a literal;
    repeated subjects stay separate rows.
    """
    value = F.col("value")
    lines = lines.where(~F.startswith(value, F.lit("#")) & (F.trim(value) != ""))
    if mode == "reference":
        return lines.select(
            T.plain_subject(value).alias("subject"), T.plain_literal(value).alias("text")
        )
    if mode != "default":
        raise ValueError(f"unknown N-Triples mode: {mode!r}")
    names = ["subject", "predicate", "text", "lang"]
    # statements with another object, and lines that are none, hold no text
    lines = lines.where(value.rlike(T.TRIPLE))
    return lines.select(*[T.triple_field(value, i + 1).alias(n) for i, n in enumerate(names)])


def read_ntriples(
    spark: SparkSession, paths: str | list[str], mode: str = "default"
) -> DataFrame:
    return parse_ntriples(spark.read.text(paths), mode)


def parse_statements(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, rejects) of lines (value) in the whole N-Triples grammar.

    Statements are (subject, predicate, object, kind, lang, datatype): kind is "iri",
    "blank" or "literal", blank nodes keep their ``_:``, literals are decoded, and lang
    and datatype are null where they are not given.  Rejects are all other lines but empty
    ones and comments, with all their columns.
    """
    value = F.col("value")
    lines = lines.where(~F.startswith(F.trim(value), F.lit("#")) & (F.trim(value) != ""))

    def part(group: int):
        return T.statement_part(value, group)

    def blank(group: int):
        return F.concat(F.lit("_:"), part(group))

    def given(group: int):
        return F.when(part(group) != "", part(group))

    good = T.is_statement(value)
    kind = T.object_kind(value)
    statements = lines.where(good).select(
        F.when(part(2) != "", blank(2)).otherwise(part(1)).alias("subject"),
        part(3).alias("predicate"),
        F.when(kind == "blank", blank(5)).when(kind == "iri", part(4)).otherwise(T.unescaped(part(6))).alias("object"),
        kind.alias("kind"),
        given(7).alias("lang"),
        given(8).alias("datatype"),
    )
    return statements, lines.where(~good)


def read_statements(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(statements, rejects) of N-Triples files; rejects are (line, value), numbered in file order."""
    return parse_statements(number_lines(spark.read.text(paths)))


def number_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """Add a unique BIGINT per row, for documents whose own ids repeat."""
    return df.withColumn(column, F.monotonically_increasing_id())


def read_stop_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stop list, one word per line: (word)."""
    word = F.trim("value")
    return spark.read.text(paths).select(word.alias("word")).where(word != "").distinct()
