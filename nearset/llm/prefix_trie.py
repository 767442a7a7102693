"""Prefix trie of conversations by van Emde Boas recursion: sequences are cut at half depth.

All sequences are cut at half of the greatest depth.  The cut prefixes get names, and then
the upper halves and the lower halves, each lower half under the name of its prefix, are
cut again, all together, until every piece is one turn: a round halves all pieces, so the
number of rounds is the logarithm of the depth.  The way back grafts: two pieces become one,
and the totals of the lower trees are added to the nodes above the cut.

Names are exclusive sums of two 64-bit hashes of (depth, turn): the name of a cut prefix is
the name of the prefix its piece hangs from, and the sum of the upper half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import SPACE, ready, row_numbers
from nearset.runtime import write_once

#: Turns of one conversation that are joined under one key.
CHUNK = 1 << 16
#: Characters of the ids that one row of a list of ends holds.
ENDS = 1 << 20
_NAME = ["depth", "p1", "p2"]
_NODE = ["conv_id", "depth"]


def numbered_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, i, t1, t2, words): the turns of each conversation from 0, as two hashes.

    Turns stand in the order of ``turn`` (null first), equal ones by role and text;
    repeated rows are turns of their own.  A null role or text is empty.  Rows without a
    conv_id belong to no conversation.  A conversation of any length is sorted by many
    tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        # equal rows can go to several tasks
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.size(F.filter(F.split("text", f"{SPACE}+", -1), lambda w: w != ""))
    placed = placed.select(
        "conv_id",
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit(1), "text", "role").alias("t2"),
        words.cast("bigint").alias("words"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    numbered = row_numbers(write_once(placed, "turns"), ["conv_id"], ["place"], "i")
    return numbered.select("conv_id", "i", "t1", "t2", "words")


def rebuilt(turns: DataFrame, step: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(paths, ends): conversations that share their first turns with one in ``step``.

    A conversation takes its first h turns, h = crc32(decimal conv_id) % ``most``, from
    conversation conv_id - conv_id % step (all if that has fewer, none if it is absent)
    and goes on with its own turns after its first h.  ``paths`` has (conv_id, depth, t1,
    t2, words) with depth from 1, ``ends`` has (conv_id, length) of all conversations, of
    turnless ones too.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = write_once(turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", h), "convs")
    first = turns.where(F.col("i") < most - 1).withColumnRenamed("conv_id", "base")
    based = convs.where("h > 0").select("conv_id", "h", (F.col("conv_id") - F.pmod("conv_id", F.lit(step))).alias("base"))
    taken = write_once(
        based.join(first, "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("depth"), "t1", "t2", "words"),
        "taken",
    )
    got = taken.groupBy("conv_id").agg(F.count("*").alias("got"))
    convs = convs.join(got, "conv_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    convs = write_once(convs, "convs")
    kept = turns.join(convs.select("conv_id", "h", "got"), "conv_id").where("i >= h")
    kept = kept.select("conv_id", (F.col("i") - F.col("h") + F.col("got") + 1).alias("depth"), "t1", "t2", "words")
    length = F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return kept.unionByName(taken), convs.select("conv_id", length.alias("length"))


def _marks(depth: Column) -> list[Column]:
    return [F.xxhash64(depth, "t1", "t2"), F.xxhash64(F.lit(1), depth, "t2", "t1")]


def _sums(*names: str) -> list[Column]:
    return [F.bit_xor(n).alias(n) for n in names]


def _span(paths: DataFrame) -> int:
    """The smallest power of two that is no less than the number of depths, the root's included."""
    most = paths.agg(F.max("depth")).first()[0] or 0
    return 1 << int(most).bit_length()


def prefix_names(paths: DataFrame, span: int) -> DataFrame:
    """(conv_id, depth, p1, p2) for the prefix of ``depth`` turns, for each depth below a path's length.

    ``paths`` has (conv_id, depth, t1, t2) with depth from 1.  Turn ``depth`` stands at
    place depth - 1; a piece [a, a + size) is named by its prefix of a turns.
    """
    marked = write_once(paths.select("conv_id", (F.col("depth") - 1).alias("at"), *[
        m.alias(n) for m, n in zip(_marks(F.col("depth")), ("m1", "m2"))
    ]), "marked")
    zero = F.lit(0).cast("bigint")
    names = marked.where("at = 0").select("conv_id", zero.alias("at"), zero.alias("p1"), zero.alias("p2"))
    size = span
    while size > 1:
        half = size // 2
        start = F.col("at") - F.col("at") % size
        upper = marked.where(F.col("at") % size < half).groupBy("conv_id", start.alias("at")).agg(*_sums("m1", "m2"))
        goes_on = marked.where(F.col("at") % size == half).select("conv_id", (F.col("at") - half).alias("at"))
        cut = names.join(upper, ["conv_id", "at"]).join(goes_on, ["conv_id", "at"])
        cut = cut.select(
            "conv_id",
            (F.col("at") + half).alias("at"),
            F.col("p1").bitwiseXOR(F.col("m1")).alias("p1"),
            F.col("p2").bitwiseXOR(F.col("m2")).alias("p2"),
        )
        names = write_once(names.unionByName(cut), "names")
        size = half
    return names.withColumnRenamed("at", "depth")


def _grafted(nodes: DataFrame, chains: DataFrame, span: int) -> DataFrame:
    """(conv_id, depth, leaves, tokens) of whole subtrees.

    ``nodes`` has each node's own leaves and tokens, ``chains`` (path, depth, conv_id) for
    the node that each path meets at each depth.  A round doubles the pieces: the roots of
    the lower halves, each on the path of its smallest member, add their totals to the
    nodes of that path between the start of the piece and the cut.
    """
    totals, half = nodes, 1
    while half < span:
        size = 2 * half
        start = F.col("depth") - half
        pieces = F.sequence(F.floor(start / CHUNK), F.floor((F.col("depth") - 1) / CHUNK))
        cut = totals.where(F.col("depth") % size == half).select(
            F.col("conv_id").alias("path"),
            F.floor(F.col("depth") / size).alias("piece"),
            F.explode(pieces).alias("chunk"),
            "leaves",
            "tokens",
        )
        above = chains.where(F.col("depth") % size < half).select(
            "path",
            F.floor(F.col("depth") / size).alias("piece"),
            F.floor(F.col("depth") / CHUNK).alias("chunk"),
            "conv_id",
            "depth",
        )
        more = above.join(cut, ["path", "piece", "chunk"]).select(*_NODE, "leaves", "tokens")
        summed = totals.unionByName(more).groupBy(*_NODE).agg(
            F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")
        )
        totals, half = write_once(summed, "totals"), size
    return totals


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of rows in order become lists of about ENDS characters for each node."""
    names = ["depth", "p1", "p2", "part", "place", "ids"]
    place, node, held, size = 0, None, [], 0

    def row() -> pa.RecordBatch:
        values = [*node, place, ",".join(held)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "part", "member")]
        for *name, member in zip(*columns):
            if held and (name != node or size >= ENDS):
                yield row()
                place, held, size = place + 1, [], 0
            node = name
            held.append(str(member))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each node, which come one after another."""
    node, digest, out = None, None, []

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [*_NAME, "ends_sha256"])

    for batch in batches:
        for *name, ids in zip(*(batch.column(c).to_pylist() for c in (*_NAME, "ids"))):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        if len(out) >= 4096:
            yield rows()
            out = []
    if node is not None:
        out.append((*node, digest.hexdigest()))
    yield rows()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): the digest of the ids of each node's ends, ascending, joined by commas.

    ``ends`` has (depth, p1, p2, member).  Ids are sorted by ranges over all tasks and
    joined to texts of a megabyte; the texts of one node are digested one after another,
    as SHA-256 demands, in a stream that holds one text at a time.
    """
    ready(ends.sparkSession, 4096)
    order = [*_NAME, "member"]
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    lists = ranged.mapInArrow(_joined_ids, "depth bigint, p1 bigint, p2 bigint, part int, place bigint, ids string")
    lists = write_once(lists, "ends")
    by_node = lists.repartition(*_NAME).sortWithinPartitions(*_NAME, "part", "place")
    return by_node.select(*_NAME, "ids").mapInArrow(_digests, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """The trie of sequences of turns, a row for each node.

    ``paths`` has (conv_id, depth, t1, t2, words), a row for each turn with depth from 1
    without gaps; ``ends`` has (conv_id, length) of every sequence, of empty ones too.
    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): conv_id is the smallest member, so (conv_id, depth) names a node;
    saved_tokens is what a cache of common prefixes saves in the node's subtree.  Without
    sequences there is no node; if all are empty there is the root alone.
    """
    # equal sequences are one from here on; their name is the sum of all their turns
    whole = paths.groupBy("conv_id").agg(*[F.bit_xor(m).alias(n) for m, n in zip(_marks(F.col("depth")), ("p1", "p2"))])
    zero = F.lit(0).cast("bigint")
    ends = ends.join(whole, "conv_id", "left").select(
        F.col("conv_id").alias("member"),
        F.col("length").cast("bigint").alias("depth"),
        F.coalesce("p1", zero).alias("p1"),
        F.coalesce("p2", zero).alias("p2"),
    )
    ends = write_once(ends, "ends")
    alike = write_once(ends.groupBy(*_NAME).agg(F.min("member").alias("path"), F.count("*").alias("weight")), "alike")
    one = alike.where("depth > 0").select(F.col("path").alias("conv_id"), "weight")
    paths = write_once(paths.join(one, "conv_id"), "paths")

    span = _span(paths)
    above = prefix_names(paths, span)
    turns = paths.join(above.withColumn("depth", F.col("depth") + 1), _NODE)
    named = [F.col(p).bitwiseXOR(m) for p, m in zip(("p1", "p2"), _marks(F.col("depth")))]
    turns = turns.select(
        F.col("conv_id").alias("path"), "depth", "words", "weight",
        F.col("p1").alias("up1"), F.col("p2").alias("up2"), named[0].alias("p1"), named[1].alias("p2"),
    )
    turns = write_once(turns, "path_nodes")
    inner = turns.groupBy(*_NAME).agg(
        F.min("path").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.max("words").alias("words"), F.max("up1").alias("up1"), F.max("up2").alias("up2"),
    )
    root = alike.agg(F.min("path").alias("conv_id"), F.sum("weight").alias("n_convs")).where("conv_id IS NOT NULL")
    root = root.select(
        *[zero.alias(n) for n in _NAME], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("bigint").alias(n) for n in ("up1", "up2")],
    )
    nodes = write_once(root.unionByName(inner.select(root.columns)), "nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = write_once(nodes, "nodes")

    own = nodes.select(
        *_NODE,
        (F.col("n_children") == 0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"),
    )
    named = nodes.select(*_NAME, "conv_id")
    chains = turns.select("path", *_NAME).join(named, _NAME).select("path", "depth", "conv_id")
    # every path starts at the root, which is one row
    top = turns.where("depth = 1").select("path", zero.alias("depth"))
    top = top.join(F.broadcast(named.where("depth = 0").select("depth", "conv_id")), "depth")
    chains = write_once(chains.unionByName(top.select("path", "depth", "conv_id")), "chains")
    totals = _grafted(own, chains, span)

    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"),
                           F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals, _NODE).join(parents, ["depth", "up1", "up2"], "left")
    out = out.join(end_digests(ends), _NAME, "left")
    return out.select(
        *_NODE, "parent_conv_id", F.col("n_convs").cast("bigint"), F.col("n_children").cast("bigint"),
        F.col("leaves").cast("bigint").alias("n_leaves"), F.col("tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
