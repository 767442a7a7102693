"""Pairs of sets whose Jaccard similarity reaches a threshold.

The steps, all on DataFrames:

1. ``prepare``      collapse sets of equal content to one representative, order
                    items rare first, write the sets once.
2. ``candidates``   sets that share a signature and whose sizes and positions
                    still allow the threshold.
3. ``verify``       exact overlap of the candidates that bitmaps leave.  Sets that
                    are as small as a bitmap travel with their signatures and
                    are compared where they meet (``verified_inline``).
4. ``expand``       back from representatives to all set ids.

Two facts about the data choose the plan, each read by a small aggregate job:
whether a set is too large for one task (``large_sets``), and whether a
signature is shared by too many sets for one task (``split_hot``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators import large_sets
from nearset.operators.adaptive import adaptive_signatures
from nearset.operators.blocks import (
    BLOCK_ROWS,
    PASS_BYTES,
    PASS_ROWS,
    block_count,
    block_of,
    blocked_sides,
    every_block,
    in_passes,
    passes,
)
from nearset.operators.itemsets import (
    SPLIT_ROWS,
    content_groups,
    content_profile,
    copied_sets,
    item_frequency,
    item_rows,
    largest_set,
    unique_rows,
)
from nearset.operators.signatures import Scheme, combine_prefix, with_classes
from nearset.operators.sketches import INLINE_ITEMS, parity, possible_pairs, unequal_bits
from nearset.runtime import drop, only_row, write_once

# Most item combinations one set may turn into; longer sets sign with single
# items and have the shared-item count checked on the pair instead.
_MAX_COMBINATIONS = 1000

_ANY = 2**62  # "no limit" for a BIGINT column

# Items that pairs with a set above INLINE_ITEMS must share in prefixes as much longer.
SHARED_ITEMS = 4

# The rows that meet are estimated from one signature in so many.
PART = 64


@dataclass(frozen=True)
class Prepared:
    """Input of the join after de-duplication.

    ``sets``     one row per distinct content: (set_id, n, copies, skip, items).
                 ``items`` is in order; the first ``skip`` occur in no other set.
                 In the order by frequency, items are given by their place in it.
    ``members``  (rep, set_id, n, copies) of every set that has copies, or None.
    ``large``    rows (set_id, n, copies, item, df) of sets that may pair with a
                 set above ``split_rows``, or None when there is no such set.
    """

    sets: DataFrame
    members: DataFrame | None
    large: DataFrame | None


def prepare(rows: DataFrame, scheme: Scheme, split_rows: int = SPLIT_ROWS) -> Prepared:
    """Collapse copies and write the distinct sets; ``rows`` are unique."""
    members = copied_sets(rows)
    if members.isEmpty():
        members, reps, own_rows = None, None, rows
    else:
        is_rep = F.col("set_id") == F.col("rep")
        reps = members.where(is_rep).select("set_id", "copies")
        own_rows = rows.join(members.where(~is_rep).select("set_id"), "set_id", "left_anti")

    large = None
    largest = largest_set(rows)
    if largest > split_rows:
        own_rows, large_rows = large_sets.set_apart(
            rows, members, scheme, split_rows, parts=math.ceil(largest / split_rows)
        )
        large_rows = _with_frequency(_with_copies(large_rows, reps), rows, scheme)
        large = write_once(large_rows, "large-sets")

    if scheme.order != "frequency":
        return Prepared(write_once(_with_copies(_nested(own_rows), reps), "sets"), members, large)
    numbered = numbered_items(rows)
    sets = write_once(_with_copies(_nested_places(own_rows, numbered, scheme), reps), "sets")
    drop(numbered)
    return Prepared(sets, members, large)


def _nested(own_rows: DataFrame) -> DataFrame:
    """Sets of ``own_rows`` as ``Prepared`` has them, without copies, in the order of the items."""
    items = F.sort_array(F.collect_list("item"))
    sets = own_rows.groupBy("set_id").agg(items.alias("items"))
    return sets.select("set_id", F.size("items").cast("bigint").alias("n"), F.lit(0).alias("skip"), "items")


def _nested_places(own_rows: DataFrame, numbered: DataFrame, scheme: Scheme) -> DataFrame:
    """The same in the order by frequency, with the places of ``numbered_items``."""
    # the items of one set are the first in the order
    single = numbered.where(F.col("df") == 1).count()
    row = F.struct("place", "df") if scheme.adaptive else F.struct("place")
    sets = own_rows.join(numbered, "item").groupBy("set_id").agg(F.sort_array(F.collect_list(row)).alias("ordered"))
    items = F.col("ordered.place")
    return sets.select(
        "set_id",
        F.size("ordered").cast("bigint").alias("n"),
        F.size(F.filter(items, lambda x: x <= single)).alias("skip"),
        items.alias("items"),
        *([F.col("ordered.df").alias("dfs")] if scheme.adaptive else []),
    )


def numbered_items(rows: DataFrame) -> DataFrame:
    """Items with their place in the order rare first, from 1: (item, df, place).

    A place is shorter than most items, and is all that has to travel.  Written before it is
    joined, so that a hot item is split over tasks.
    """
    ranges = item_frequency(rows).repartitionByRange("df", "item").withColumn("part", F.spark_partition_id())
    ranges = write_once(ranges, "frequency")
    # one row per range
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(W.partitionBy("part").orderBy("df", "item"))
    placed = ranges.withColumn("inside", inside).join(offsets, "part")
    places = write_once(placed.select("item", "df", (F.col("inside") + F.col("offset")).alias("place")), "places")
    drop(ranges)
    return places


def _with_frequency(rows: DataFrame, all_rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Add ``df``, counted over all sets, if the item order needs it."""
    if scheme.order == "frequency":
        # written before it is joined, so that a hot item is split over tasks
        return rows.join(write_once(item_frequency(all_rows), "frequency"), "item")
    return rows.withColumn("df", F.lit(0).cast("bigint"))


def _with_copies(df: DataFrame, reps: DataFrame | None) -> DataFrame:
    """Add ``copies``, 1 for sets without any."""
    one = F.lit(1).cast("bigint")
    if reps is None:
        return df.withColumn("copies", one)
    return df.join(reps, "set_id", "left").withColumn("copies", F.coalesce("copies", one))


def longest_combined(scheme: Scheme) -> int:
    """Largest set size whose prefix has at most ``_MAX_COMBINATIONS`` combinations."""

    def fits(n: int) -> bool:
        p = scheme.prefix_items or n - math.ceil(scheme.threshold * n) + scheme.size
        return math.comb(min(n, p), scheme.size) <= _MAX_COMBINATIONS

    low, high = 0, 1
    while high < 1 << 50 and fits(high):  # larger numbers are not exact as doubles
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def with_own_items(sets: DataFrame) -> DataFrame:
    """Add ``own``: (items, bits) of a set of up to INLINE_ITEMS, null for larger ones."""
    own = F.struct("items", parity(F.col("items")).alias("bits"))
    return sets.withColumn("own", F.when(F.col("n") <= INLINE_ITEMS, own))


def signed_sets(sets: DataFrame, scheme: Scheme, shared: int = 1) -> DataFrame:
    """Join keys of every set: (sig, set_id, n, copies, own, last, level, above, within).

    ``sig`` is a 64-bit hash of ``level`` items, the last of them at position
    ``last``.  A pair only counts when its larger set has more than ``above``
    items and it needs at most ``within`` shared items.  Hash collisions add
    candidates and are sorted out when the pair is verified.  ``own`` are the items
    of a set of up to INLINE_ITEMS.  With length classes there are ``classes`` as well, of
    which a pair must have one in common.  Prefixes are those of pairs that ``shared`` items
    are asked of.
    """
    prefix = scheme.prefix(F.col("n")) if shared == 1 else F.least(F.col("n"), S.prefix_length(F.col("n"), scheme.threshold, shared))
    sets = with_classes(with_own_items(sets), scheme).withColumn("p", prefix)
    classes = ["classes"] if scheme.length_classes else []

    def sign(part: DataFrame, level: int, above: int) -> DataFrame:
        signed = combine_prefix(part, level, ["set_id", "n", "copies", "own", *classes])
        return signed.select(
            F.xxhash64("sig").alias("sig"),
            "set_id",
            "n",
            "copies",
            "own",
            *classes,
            "last",
            F.lit(level).alias("level"),
            F.lit(above).cast("bigint").alias("above"),
            F.lit(_ANY).cast("bigint").alias("within"),
        )

    if scheme.size == 1:
        return sign(sets, 1, 0)
    cut = longest_combined(scheme)
    short = sign(sets.where(F.col("n") <= cut), scheme.size, 0)
    nearly = math.floor(scheme.threshold * cut)
    long = sign(sets.where(F.col("n") >= nearly), 1, cut)
    return short.unionByName(long)


def _meets(scheme: Scheme, shared: int = 1) -> Column:
    """Join condition of rows ``a`` (smaller set) and ``b`` under one signature.

    Where ``shared`` items are asked of a pair, this may be the last of them.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    needed = S.required_overlap(n_a, n_b, scheme.threshold)
    # rows of one signature agree in these three; both are named, so that neither side is filtered by itself
    level, within = F.greatest("level_a", "level_b"), F.greatest("within_a", "within_b")
    bound = S.overlap_bound(n_a, F.col("last_a"), n_b, F.col("last_b"), level + (shared - 1))
    meets = (
        ((n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b"))))
        & S.length_filter(n_a, n_b, scheme.threshold)
        & (n_b > F.least("above_a", "above_b"))
        & (needed <= within)
        & (bound >= needed)
    )
    if scheme.adaptive:
        meets = meets & (F.when(F.col("seeks_b"), n_b).otherwise(F.when(F.col("seeks_a"), F.lit(-1)).otherwise(F.lit(-2))) >= n_a)
    return meets & F.arrays_overlap("classes_a", "classes_b") if scheme.length_classes else meets


def _as_smaller(scheme: Scheme, shared: int = 1) -> Column:
    """Rows under which a set may be the smaller one of a pair: fewer than its prefix.

    The bound of ``_meets`` for a partner of its own size, which asks for the fewest items.
    """
    n = F.col("n")
    return F.col("level") + (shared - 1) + n - F.col("last") >= S.required_overlap(n, n, scheme.threshold)


def _side(df: DataFrame, name: str, keys: list[str], carried: dict[str, str]) -> DataFrame:
    own = ["n", "last", "level", "above", "within"]
    return df.select(
        *keys,
        F.col("set_id").alias(name),
        *[F.col(c).alias(f"{c}_{name}") for c in own],
        *[F.col(c).alias(f"{as_}_{name}") for c, as_ in carried.items()],
    )


def _met(
    signed: DataFrame,
    scheme: Scheme,
    block_rows: int | None,
    sought: DataFrame | None,
    columns: dict[str, str],
    shared: int = 1,
) -> DataFrame:
    """Pairs of rows that meet: (a, b, n_a, n_b) and ``columns`` of both, once per signature.

    With ``block_rows``, signatures shared by more rows are cut into blocks.  ``sought``
    are the rows of ``signed`` under which larger sets look for smaller ones, if not all.
    Where few sets meet, both sides are the same rows, which Spark shuffles once.
    """
    keys = ["sig"]
    alike = few_meet(scheme) and sought is None and block_rows is None
    left, right = signed if alike else signed.where(_as_smaller(scheme, shared)), signed if sought is None else sought
    if block_rows is not None:
        sizes = signed.groupBy("sig").agg(F.count("*").alias("rows"))
        large = write_once(sizes.where(F.col("rows") > block_rows), "large-signatures")

        def blocked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            sized = rows.join(large, "sig", "left").fillna(1, subset=["rows"])
            return blocked_sides(sized, "set_id", "rows", block_rows)

        left, right = blocked(left)[0], blocked(right)[1]
        keys = ["sig", "left_block", "right_block"]

    carried = {c: as_ for c, as_ in columns.items() if c != "level"}
    carried |= ({"classes": "classes"} if scheme.length_classes else {}) | ({"seeks": "seeks"} if scheme.adaptive else {})
    return (
        _side(left, "a", keys, carried)
        .join(_side(right, "b", keys, carried), keys)
        .where(_meets(scheme, shared))
        .select("a", "b", "n_a", "n_b", *[f"{as_}_{name}" for as_ in columns.values() for name in "ab"])
    )


def few_meet(scheme: Scheme) -> bool:
    """Whether signatures are of several items, so that sets that meet are mostly similar."""
    return scheme.size > 1 or scheme.adaptive


def pair_up(
    signed: DataFrame, scheme: Scheme, block_rows: int | None = None, sought: DataFrame | None = None
) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b), ``a`` the smaller set; each pair once."""
    return _met(signed, scheme, block_rows, sought, {}).distinct()


def verified_inline(
    signed: DataFrame, scheme: Scheme, block_rows: int | None = None, sought: DataFrame | None = None
) -> DataFrame:
    """Similar pairs of sets of up to INLINE_ITEMS (schema of ``verify``).

    Their items are in the rows that meet, so candidates are compared there and then,
    and only similar pairs are shuffled.  A word of parity bits ends most of them first.
    """
    few = F.col("n") <= INLINE_ITEMS
    met = _met(
        signed.where(few),
        scheme,
        block_rows,
        None if sought is None else sought.where(few),
        {"copies": "copies", "own.items": "items", "own.bits": "bits"},
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    room = n_a + n_b - unequal_bits(F.col("bits_a"), F.col("bits_b"))
    possible = met.where(room >= 2 * S.required_overlap(n_a, n_b, scheme.threshold)).drop("bits_a", "bits_b")
    return _confirmed(possible, scheme).distinct()


def split_hot(signed: DataFrame, sets: DataFrame, hot: DataFrame, scheme: Scheme, shared: int = 1) -> DataFrame:
    """Split signatures shared by many sets by the next item a pair must share.

    A pair that needs more shared items than its signature has must share
    another one further back; its place is bounded like the prefix.  So a hot
    signature can be replaced by (signature, next item) without losing a pair.
    Pairs that need no further item keep the plain signature: they are results.
    Whether the split pays is decided per signature by the number of pairs on
    either side.
    """
    t = scheme.threshold
    cold = signed.join(hot, "sig", "left_anti")
    warm = signed.join(hot, "sig").join(sets.select("set_id", "items"), "set_id")
    reach = F.least(F.col("n"), S.prefix_length(F.col("n"), t, shared) + F.col("level")).cast("int")
    classes = ["classes"] if scheme.length_classes else []
    ahead = F.slice("items", F.col("last") + 1, F.greatest(reach - F.col("last"), F.lit(0)))
    longer = warm.select(
        F.col("sig").alias("first_sig"),
        "set_id",
        "n",
        "copies",
        "own",
        *classes,
        "last",
        "level",
        "above",
        "within",
        F.posexplode(ahead).alias("step", "next"),
    ).select(
        "first_sig",
        F.xxhash64("first_sig", "next").alias("sig"),
        "set_id",
        "n",
        "copies",
        "own",
        *classes,
        (F.col("last") + F.col("step") + 1).alias("last"),
        (F.col("level") + 1).alias("level"),
        "above",
        "within",
    )
    pairs_after = (
        longer.groupBy("first_sig", "sig")
        .agg(F.count("*").cast("double").alias("rows"))
        .groupBy(F.col("first_sig").alias("sig"))
        .agg(F.sum(F.col("rows") * F.col("rows")).alias("after"))
    )
    before = F.col("rows").cast("double") * F.col("rows")
    worth = (
        hot.join(pairs_after, "sig", "left")
        .where(F.coalesce(F.col("after"), F.lit(0.0)) * 2 < before)
        .select("sig")
    )
    columns = signed.columns
    stay = warm.join(worth, "sig", "left_anti").select(columns)
    results = (
        warm.join(worth, "sig", "left_semi")
        .where(S.min_partner_size(F.col("n"), t) <= F.col("level"))
        .withColumn("within", F.col("level").cast("bigint"))
        .select(columns)
    )
    refined = longer.join(
        worth.withColumnRenamed("sig", "first_sig"), "first_sig", "left_semi"
    ).select(columns)
    return cold.unionByName(stay).unionByName(results).unionByName(refined)


def join_keys(
    sets: DataFrame, scheme: Scheme, hot_rows: int = BLOCK_ROWS, block_rows: int = BLOCK_ROWS, shared: int = 1
) -> tuple[DataFrame, int | None, DataFrame | None]:
    """(signed, block_rows, sought) of the prepared sets, as ``pair_up`` takes them.

    Signatures are made inside the rows of the sets, so they are not written unless they are
    split: each step makes them with the columns it needs.
    """
    return _join_keys(sets, scheme, hot_rows, block_rows, shared)[:3]


def _join_keys(
    sets: DataFrame, scheme: Scheme, hot_rows: int, block_rows: int, shared: int = 1
) -> tuple[DataFrame, int | None, DataFrame | None, int, int]:
    """``join_keys`` with the number of rows and of pairs of rows of one signature."""

    def counts(signed: DataFrame) -> tuple[int, int, int]:
        rows = F.col("rows")
        sizes = signed.groupBy("sig").agg(F.count("*").alias("rows"))
        pairs = F.sum(rows.cast("double") * (rows - 1) / 2)
        most, total, met = only_row(sizes.agg(F.max(rows), F.sum(rows), pairs))
        return most or 0, total or 0, int(met or 0)

    if scheme.adaptive:
        signed = adaptive_signatures(with_own_items(sets), scheme)
    else:
        signed = signed_sets(sets, scheme, shared)
    most, total, met = counts(signed)
    if most <= hot_rows:
        return signed, None, None, total, met
    signed = write_once(signed, "signed-sets")
    if scheme.adaptive:
        return signed, block_rows, None, total, met
    hot = signed.groupBy("sig").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows)
    hot = write_once(hot, "hot-signatures")
    split = write_once(split_hot(signed, sets, hot, scheme, shared), "split-signatures")
    drop(signed, hot)
    return split, block_rows, None, *counts(split)[1:]


def candidates(
    sets: DataFrame, scheme: Scheme, hot_rows: int = BLOCK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b) of the prepared sets."""
    signed, blocks, sought = join_keys(sets, scheme, hot_rows, block_rows)
    return pair_up(signed, scheme, blocks, sought)


def wide_candidates(
    signed: DataFrame, scheme: Scheme, block_rows: int | None = None, sought: DataFrame | None = None
) -> DataFrame:
    """Candidate pairs whose larger set has more than INLINE_ITEMS."""
    sought = (signed if sought is None else sought).where(F.col("n") > INLINE_ITEMS)
    return pair_up(signed.where(F.col("n") >= _least_wide(scheme)), scheme, block_rows, sought)


def _least_wide(scheme: Scheme) -> int:
    """Items that a set has at least, if its partner has more than INLINE_ITEMS."""
    return math.floor(scheme.threshold * INLINE_ITEMS)


def may_count(scheme: Scheme) -> bool:
    """Whether ``counted_candidates`` holds for the scheme, whose wide pairs need more than SHARED_ITEMS."""
    fewest = (_least_wide(scheme) + INLINE_ITEMS + 1) * scheme.threshold / (1.0 + scheme.threshold)
    return scheme.size == 1 and scheme.prefix_items is None and not scheme.adaptive and fewest > SHARED_ITEMS + 1


def counted_candidates(
    sets: DataFrame, scheme: Scheme, hot_rows: int = BLOCK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Candidate pairs whose larger set has more than INLINE_ITEMS, by several shared items.

    A pair that needs o items shares k of them in its first n - o + k items, for any k up to
    o.  Most candidates of one shared item share no other one there and end when their rows
    are added up.  Under a split signature a pair has met in two items: the first stands
    for itself if it is the last of the k, as the next one is needed, too.
    """
    signed, blocks, _, rows, meetings = _join_keys(
        sets.where(F.col("n") >= _least_wide(scheme)), scheme, hot_rows, block_rows, SHARED_ITEMS
    )
    sought = signed.where(F.col("n") > INLINE_ITEMS)

    def counted(part: DataFrame) -> DataFrame:
        met = _met(part, scheme, blocks, sought, {"level": "level"}, SHARED_ITEMS)
        items = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum("level_a").alias("items"))
        return items.where(F.col("items") >= SHARED_ITEMS).drop("items")

    if meetings > PASS_ROWS:
        # sizes and positions end most of them; a part of the signatures tells how many, for the number of passes only
        some = [x.where(F.pmod(F.xxhash64(F.lit("some"), "sig"), F.lit(PART)) == 0) for x in (signed, sought)]
        met = _met(some[0], scheme, blocks, some[1], {"level": "level"}, SHARED_ITEMS)
        meetings = PART * only_row(met.agg(F.count("*")))[0]
    # rows that meet grow with the square of the sets
    return in_passes(signed, "set_id", passes(meetings, 2 * rows, PASS_ROWS), counted, "counted")


def verify(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Keep pairs that reach the threshold.

    Bitmaps of the sets sort out most pairs first; item lists are fetched for the rest.
    Out: (a, b, n_a, n_b, copies_a, copies_b, shared, overlap, jaccard), where
    ``shared`` is the number of prefix items in common.
    """

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("set_id").alias(name),
            F.col("copies").alias(f"copies_{name}"),
            F.col("items").alias(f"items_{name}"),
        )

    possible = possible_pairs(pairs, sets, scheme.threshold)
    count, items = only_row(possible.agg(F.count("*"), F.sum("n_a")))
    if not count:
        return _confirmed(possible.join(side("a"), "a").join(side("b"), "b"), scheme)
    held = only_row(sets.agg(F.sum("n")))[0]

    def confirmed(part: DataFrame) -> DataFrame:
        return _confirmed(part.join(side("a"), "a").join(side("b"), "b"), scheme)

    # the items of one set travel with each of its pairs, which grow with the square of the sets
    return in_passes(possible, "a", passes(8 * items, 8 * held, PASS_BYTES), confirmed, "confirmed")


def _confirmed(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """The similar ones of pairs that have ``items_a`` and ``items_b`` (schema of ``verify``)."""

    def prefix(name: str) -> Column:
        return F.slice(f"items_{name}", F.lit(1), scheme.prefix(F.col(f"n_{name}")).cast("int"))

    overlap = S.overlap(F.col("items_a"), F.col("items_b"))
    checked = (
        # one comparison of the items ends most pairs
        pairs.where(overlap >= S.required_overlap(F.col("n_a"), F.col("n_b"), scheme.threshold))
        .withColumn("overlap", overlap)
        .withColumn("jaccard", S.jaccard(F.col("overlap"), F.col("n_a"), F.col("n_b")))
        .where(F.col("jaccard") >= F.lit(float(scheme.threshold)))
        .withColumn("shared", S.overlap(prefix("a"), prefix("b")))
    )
    if scheme.size > 1:
        checked = checked.where(F.col("shared") >= scheme.size)
    return checked.select(
        "a", "b", "n_a", "n_b", "copies_a", "copies_b", "shared", "overlap", "jaccard"
    )


def similar_sets(
    prepared: Prepared,
    scheme: Scheme,
    split_rows: int = SPLIT_ROWS,
    hot_rows: int = BLOCK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Similar pairs of distinct contents (schema of ``verify``)."""
    sets = prepared.sets
    counted = may_count(scheme)
    few = sets.where(F.col("n") <= INLINE_ITEMS) if counted else sets
    signed, blocks, sought = join_keys(few, scheme, hot_rows, block_rows)
    if few_meet(scheme):
        # item lists in every row of a signature would be far more than those of the few pairs
        found = verify(pair_up(signed, scheme, blocks, sought), sets, scheme)
    else:
        if counted:
            wide = counted_candidates(sets, scheme, hot_rows, block_rows)
        else:
            wide = wide_candidates(signed, scheme, blocks, sought)
        found = verified_inline(signed, scheme, blocks, sought).unionByName(verify(wide, sets, scheme))
    if prepared.large is not None:
        found = found.unionByName(
            large_sets.similar_large_sets(prepared.large, scheme, split_rows, block_rows)
        )
    return found


def times_found(found: DataFrame, scheme: Scheme) -> DataFrame:
    """Add ``times``: how many signatures the two sets of a pair share."""
    times = S.combinations_count(F.col("shared").cast("bigint"), scheme.size)
    if scheme.length_classes:
        both = F.array_intersect(scheme.classes(F.col("n_a")), scheme.classes(F.col("n_b")))
        times = times * F.size(both)
    return found.withColumn("times", times.cast("bigint"))


def times_copied(scheme: Scheme) -> Column:
    """Signatures two equal sets of ``n`` items share, as a column of ``n``."""
    n = F.col("n")
    prefix = scheme.prefix(n)
    times = F.when(prefix < scheme.size, F.lit(1).cast("bigint")).otherwise(
        S.combinations_count(prefix, scheme.size)
    )
    if scheme.length_classes:
        times = times * F.size(scheme.classes(n))
    return times.cast("bigint")


def expand(found: DataFrame, members: DataFrame, scheme: Scheme, block_rows: int) -> DataFrame:
    """From pairs of representatives to pairs of all their copies.

    Groups of copies are cut into blocks, and a task joins one block of one
    group with one block of the other, however large the groups are.
    """
    found = times_found(found, scheme)
    alone = (F.col("copies_a") == 1) & (F.col("copies_b") == 1)
    plain = found.where(alone).select(
        F.col("a").alias("id_a"), F.col("b").alias("id_b"), "overlap", "jaccard", "times"
    )

    blocks_a = block_count(F.col("copies_a"), block_rows)
    blocks_b = block_count(F.col("copies_b"), block_rows)
    cells = (
        found.where(~alone)
        .withColumn("block_a", every_block(blocks_a))
        .withColumn("block_b", every_block(blocks_b))
    )
    own_block = block_of(F.col("set_id"), block_count(F.col("copies"), block_rows))

    def filled(name: str) -> DataFrame:
        own = members.select(
            F.col("rep").alias(name),
            own_block.alias(f"block_{name}"),
            F.col("set_id").alias("member"),
        )
        # a representative without copies has no member rows and stands for itself
        return cells.join(own, [name, f"block_{name}"], "left").withColumn(
            f"id_{name}", F.coalesce("member", name)
        )

    cell = ["a", "b", "block_a", "block_b"]
    crossed = (
        filled("a")
        .select(*cell, "id_a", "overlap", "jaccard", "times")
        .join(filled("b").select(*cell, "id_b"), cell)
        .select("id_a", "id_b", "overlap", "jaccard", "times")
    )

    left, right = blocked_sides(members, "set_id", "copies", block_rows)
    keys = ["rep", "left_block", "right_block"]
    equal = (
        left.select(*keys, "n", F.col("set_id").alias("id_a"))
        .join(right.select(*keys, F.col("set_id").alias("id_b")), keys)
        .where(F.col("id_a") < F.col("id_b"))
        .select(
            "id_a",
            "id_b",
            F.col("n").cast("int").alias("overlap"),
            F.lit(1.0).alias("jaccard"),
            times_copied(scheme).alias("times"),
        )
    )
    return plain.unionByName(crossed).unionByName(equal)


def similarity_join(
    df: DataFrame,
    set_col: str,
    item_col: str,
    threshold: float = 0.9,
    signature_size: int = 1,
    length_classes: str | None = None,
    order: str = "frequency",
    prefix_items: int | None = None,
    distinct: bool = True,
    unique: bool = False,
    adaptive: bool = False,
    split_rows: int = SPLIT_ROWS,
    hot_rows: int = BLOCK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of set ids with Jaccard similarity of at least ``threshold``.

    Out: (id_a, id_b, overlap, jaccard), id_a < id_b.  With ``distinct=False``
    a pair appears once per signature its sets share.  A group of n equal sets
    gives n * (n - 1) / 2 pairs, which is the result as defined; ``similar_groups``
    has the same links in linear size.  Rows with a null set or item are left out.
    ``unique`` promises that no (set, item) row repeats.  ``adaptive`` lets each set sign with
    one or two items, whichever makes fewer candidates; the result is the same.  ``split_rows``, ``hot_rows`` and ``block_rows``
    bound what one task handles; they do not change the result.
    """
    scheme = Scheme(threshold, signature_size, length_classes, order, prefix_items, adaptive)
    rows = item_rows(df, set_col, item_col)
    if unique:
        prepared = prepare(rows, scheme, split_rows)
    else:
        rows = unique_rows(rows)
        prepared = prepare(rows, scheme, split_rows)
        drop(rows)
    found = similar_sets(prepared, scheme, split_rows, hot_rows, block_rows)
    if prepared.members is None:
        pairs = times_found(found, scheme).select(
            F.col("a").alias("id_a"), F.col("b").alias("id_b"), "overlap", "jaccard", "times"
        )
    else:
        found = write_once(found, "similar-contents")
        pairs = expand(found, prepared.members, scheme, block_rows)
    if not distinct:
        pairs = pairs.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return pairs.select(
        F.least("id_a", "id_b").alias("id_a"),
        F.greatest("id_a", "id_b").alias("id_b"),
        "overlap",
        "jaccard",
    )


def similar_groups(
    df: DataFrame,
    set_col: str,
    item_col: str,
    threshold: float = 0.9,
    split_rows: int = SPLIT_ROWS,
    **bounds: int,
) -> tuple[DataFrame, DataFrame]:
    """The same result without repeating it for copies.

    Returns (pairs of representatives, members).  Every pair of ``id_a`` in
    the group of rep_a with ``id_b`` in the group of rep_b is similar, and so is
    every pair inside one group.  Its size stays linear in the number of sets
    where the list of all pairs grows with the square of a group.
    """
    scheme = Scheme(threshold)
    rows = unique_rows(item_rows(df, set_col, item_col))
    prepared = prepare(rows, scheme, split_rows)
    found = similar_sets(prepared, scheme, split_rows, **bounds)
    pairs = found.select(
        F.least("a", "b").alias("rep_a"),
        F.greatest("a", "b").alias("rep_b"),
        F.when(F.col("a") < F.col("b"), F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"),
        F.when(F.col("a") < F.col("b"), F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_b"),
        "overlap",
        "jaccard",
    )
    return pairs, set_groups(rows)


def set_groups(rows: DataFrame) -> DataFrame:
    """Group of equal sets each set belongs to, from unique rows: (set_id, rep, copies)."""
    profile = write_once(content_profile(rows), "profile")
    groups = write_once(content_groups(profile), "groups")
    return profile.join(groups, ["n", "h1", "h2"]).select("set_id", "rep", "copies")


def attach_records(
    pairs: DataFrame, records: DataFrame, key: str, columns: list[str]
) -> DataFrame:
    """Add ``columns`` of both sets' records, suffixed ``_a`` and ``_b``."""
    for side in ("a", "b"):
        own = records.select(
            F.col(key).alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]
        )
        pairs = pairs.join(own, f"id_{side}")
    return pairs
