"""Lines that many documents hold stay in one of them; documents can be added and taken out again.

An index holds three tables.  ``lines`` has a row for each line with a key that is long
enough: (k1, k2, holder, row, pos), where k1 and k2 are two 64-bit hashes of the key and
(holder, row) names the document's row.  ``changes`` are exact reference counts: for each
insertion and deletion the keys it touched, by how many documents and lines, and the
largest document after it.  ``filters`` has a cuckoo filter for each shard of the keys that
are referenced.  An insertion asks the filters first: keys that are surely new need no
look-up in the tables before; only keys that are perhaps held meet them.  A deletion takes
the keys that lost their last document out of the filters, which Bloom filters could not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearset.llm.common import ready
from nearset.llm.cuckoo import CuckooFilter
from nearset.runtime import write_once

#: Keys of a shard of the filters that the first insertion aims at.
SHARD_KEYS = 1 << 18
#: Keys with more than this share of all lines are joined by broadcast: there are fewer than 1024.
HOT_SHARE = 1024
_KEY = ["k1", "k2"]
_REF = ["k1", "k2", "holder"]
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES = "k1 bigint, k2 bigint, holder bigint, row bigint, pos int"
_CHANGES = "k1 bigint, k2 bigint, docs bigint, lines bigint, last bigint, version int"
_FILTERS = "shard int, buckets int, prints binary"
_ASKED = "shard int, buckets int, prints binary, k1 bigint, k2 bigint, known boolean"


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index; operations return a new one and leave the old one valid."""

    lines: DataFrame
    changes: DataFrame
    filters: DataFrame
    shards: int
    version: int
    min_chars: int


def empty_index(spark: SparkSession, shards: int = 0, min_chars: int = 20) -> LineIndex:
    """An index without documents.  ``shards`` 0: set by the size of the first insertion."""
    tables = [spark.createDataFrame([], schema) for schema in (_LINES, _CHANGES, _FILTERS)]
    return LineIndex(*tables, shards, 0, min_chars)


def _holder(id_col: str) -> Column:
    """The id as a number that is never null: rows without an id are one document, before all others."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, holder, row, lines); a null text is empty and has one empty line.

    Rows of one id and one text have the same ``row``: their lines stand and go alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        _holder(id_col).alias("holder"),
        F.xxhash64(text).alias("row"),
        F.split(text, "\n", -1).alias("lines"),
    )


def line_rows(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, holder, row, pos) of all lines whose key has at least ``min_chars`` code points.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case.
    """
    lines = _split(docs, id_col, text_col).select("holder", "row", F.posexplode("lines").alias("pos", "line"))
    bare = F.btrim("line", F.lit(_BLANK))
    keys = lines.select("holder", "row", "pos", bare.alias("bare")).where(F.length("bare") >= min_chars)
    key = F.translate("bare", _UPPER, _LOWER)
    return keys.select(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"), "holder", "row", "pos")


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(np.uint64)


def _ask(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
    """The keys of a shard with what its filter said, and the filter with them added."""
    keys = _numbers(asked, "k2")
    if held.num_rows:
        shard = CuckooFilter.from_bytes(held.column("prints")[0].as_py(), held.column("buckets")[0].as_py())
    else:
        shard = CuckooFilter.sized(len(keys))
    known = shard.contains(keys)
    shard.add(keys[~known])
    n = len(keys)
    columns = [
        pa.array([key[0].as_py()] * (n + 1), pa.int32()),
        pa.array([None] * n + [len(shard.table)], pa.int32()),
        pa.array([None] * n + [shard.to_bytes()], pa.binary()),
        *(pa.concat_arrays([asked.column(k).combine_chunks(), pa.nulls(1, pa.int64())]) for k in _KEY),
        pa.concat_arrays([pa.array(known), pa.nulls(1, pa.bool_())]),
    ]
    return pa.table(columns, ["shard", "buckets", "prints", *_KEY, "known"])


def _forget(key: tuple, gone: pa.Table, held: pa.Table) -> pa.Table:
    """The filter of a shard without the keys that have no document any more."""
    shard = CuckooFilter.from_bytes(held.column("prints")[0].as_py(), held.column("buckets")[0].as_py())
    if gone.num_rows:
        shard.remove(_numbers(gone, "k2"))
    columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([len(shard.table)], pa.int32())]
    return pa.table([*columns, pa.array([shard.to_bytes()], pa.binary())], ["shard", "buckets", "prints"])


def _in_shards(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), *_KEY)


def _counts(index: LineIndex) -> DataFrame:
    """(k1, k2, docs, lines, last) as of the last change of each key; keys may have no document left."""
    return index.changes.groupBy(*_KEY).agg(
        F.sum("docs").alias("docs"), F.sum("lines").alias("lines"), F.max_by("last", "version").alias("last")
    )


def _per_key(lines: DataFrame) -> DataFrame:
    """(k1, k2, docs, lines, last) of line rows; a key in very many documents is counted in parts."""
    refs = lines.groupBy(*_REF).agg(F.count("*").alias("lines"))
    return refs.groupBy(*_KEY).agg(
        F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("holder").alias("last")
    )


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the documents added.

    Lines that the index holds already at the same place of the same row are not counted
    again, so an insertion may be repeated.  Null or empty texts and an empty table add
    nothing; other columns are not read.  Rows of one id are one document.
    """
    ready(docs.sparkSession)
    rows = write_once(line_rows(docs, index.min_chars, id_col, text_col), "line_rows")
    added = write_once(_per_key(rows), "line_keys")
    shards = index.shards or max(1, -(-added.count() // SHARD_KEYS))
    asked = (
        _in_shards(added, shards).groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_ask, _ASKED)
    )
    asked = write_once(asked, "line_filters")
    known = asked.where("known").select(*_KEY)
    version = index.version + 1
    if not index.version or known.isEmpty():
        changes = added
    else:
        # only keys that are perhaps held meet the rows and counts before
        again = rows.join(known, _KEY, "left_semi")
        place = [*_REF, "row", "pos"]
        new = write_once(again.join(index.lines, place, "left_anti"), "line_rows")
        before = index.lines.join(known, _KEY, "left_semi").select(*_REF).distinct().withColumn("held", F.lit(1))
        refs = new.groupBy(*_REF).agg(F.count("*").alias("lines")).join(before, _REF, "left")
        more = refs.groupBy(*_KEY).agg(
            F.sum(F.when(F.col("held").isNull(), 1).otherwise(0)).alias("docs"),
            F.sum("lines").alias("lines"),
            F.max("holder").alias("new_last"),
        )
        counts = _counts(index).where("docs > 0").select(*_KEY, F.col("last").alias("old_last"))
        more = more.join(counts, _KEY, "left").select(
            *_KEY, "docs", "lines", F.greatest("new_last", "old_last").alias("last")
        )
        rows = rows.join(known, _KEY, "left_anti").unionByName(new)
        changes = added.join(known, _KEY, "left_anti").unionByName(more)
    changes = write_once(changes.withColumn("version", F.lit(version)), "line_changes")
    touched = asked.where("prints IS NOT NULL").select("shard", "buckets", "prints")
    if index.version:
        rows, changes = index.lines.unionByName(rows), index.changes.unionByName(changes)
    return replace(index, lines=rows, changes=changes, filters=touched, shards=shards, version=version)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids; their keys count as if they had never come.

    Ids that the index does not hold, repeated ids and an empty table change nothing; a
    null id takes out the rows without an id.
    """
    if not index.version:
        return index
    ids = write_once(ids.select(_holder(id_col).alias("holder")).distinct(), "line_gone")
    gone = write_once(index.lines.join(ids, "holder", "left_semi"), "line_rows")
    lost = write_once(_per_key(gone), "line_keys")
    rows = write_once(index.lines.join(ids, "holder", "left_anti"), "line_rows")
    rest = _per_key(rows.join(lost.select(*_KEY), _KEY, "left_semi")).select(*_KEY, F.col("last").alias("rest"))
    version = index.version + 1
    changes = lost.join(rest, _KEY, "left").select(
        *_KEY, (-F.col("docs")).alias("docs"), (-F.col("lines")).alias("lines"), F.col("rest").alias("last")
    )
    changes = write_once(changes.withColumn("version", F.lit(version)), "line_changes")
    # a key without a largest document has no document left
    empty = _in_shards(changes.where("last IS NULL"), index.shards)
    filters = empty.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_forget, _FILTERS)
    return replace(
        index,
        lines=rows,
        changes=index.changes.unionByName(changes),
        filters=write_once(filters, "line_filters"),
        version=version,
    )


def dropped_lines(index: LineIndex, min_docs: int = 3) -> DataFrame:
    """(holder, row, pos) of lines whose key ``min_docs`` or more documents hold, but for the largest id.

    Keys with more than 1/1024 of all lines are fewer than 1,024 and are joined by
    broadcast; of the others none is large.
    """
    counts = write_once(_counts(index).where("docs > 0"), "line_counts")
    total = counts.agg(F.sum("lines")).first()[0] or 0
    often = counts.where(F.col("docs") >= min_docs)
    hot = F.col("lines") * HOT_SHARE > total
    lines = index.lines.alias("l")
    at = (F.col("l.k1") == F.col("c.k1")) & (F.col("l.k2") == F.col("c.k2")) & (F.col("holder") < F.col("last"))
    of_hot = lines.join(F.broadcast(often.where(hot).select(*_KEY, "last")).alias("c"), at)
    rest = write_once(often.where(~hot).select(*_KEY, "last"), "line_keys")
    of_rest = lines.join(rest.alias("c"), at)
    place = ["holder", "row", "pos"]
    return of_hot.select(*place).unionByName(of_rest.select(*place))


def kept_lines(
    docs: DataFrame, index: LineIndex, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of ``docs``, which the index must hold.

    Texts are split at line ends; n_lines counts the lines before.  A null or empty text is
    one empty line; a text that loses all its lines is empty.
    """
    dropped = dropped_lines(index, min_docs).groupBy("holder", "row").agg(F.collect_set("pos").alias("dropped"))
    split = _split(docs, id_col, text_col)
    joined = split.join(write_once(dropped, "line_drops"), ["holder", "row"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    return joined.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        text.alias("kept_text"),
    )
