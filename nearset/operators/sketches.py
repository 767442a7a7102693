"""Parity bitmaps: a bound of what two sets share, without their items.

A bitmap has a cell for each value of an item's hash and holds, for each cell, whether
an odd number of the set's items fall into it.  Where two bitmaps differ, the sets differ
in at least one item of that cell, so the number of unequal cells is at most the size of
the symmetric difference.  The cells are halved by the bits of the hash into words of 64.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators.blocks import PASS_BYTES, in_passes, passes
from nearset.runtime import drop, only_row, write_once

#: Sets of up to this many items are as small as a bitmap and go without.
INLINE_ITEMS = 32
#: Cells for each item in which two sets of mean size may differ.
_CELLS = 8
_MIN_WORDS, _MAX_WORDS = 2, 64
#: Words of the bitmap of any set.
_WIDEST = 1024


def bitmap_words(mean_items: float, threshold: float) -> int:
    """Words of 64 cells, a power of two, that tell sets of this size from similar ones.

    Similar sets of n items differ in at most 2 n (1 - t) / (1 + t) items.  More cells than
    that are needed, as unequal cells of unlike sets come near half of all cells.
    """
    differ = 2 * mean_items * (1 - threshold) / (1 + threshold)
    words = 1 << max(0, math.ceil(math.log2(max(1.0, _CELLS * differ / 64))))
    return min(max(words, _MIN_WORDS), _MAX_WORDS)


def own_words(n: Column, words: int, mean_items: float) -> Column:
    """Words for a set of ``n`` items: ``words`` up to the mean size, and twice as many for each doubling."""
    doublings = F.greatest(F.ceil(F.log2(n / F.lit(float(mean_items)))), F.lit(0)).cast("int")
    most = F.lit(max(words, _WIDEST)).cast("bigint")
    return F.least(F.call_function("shiftleft", F.lit(words).cast("bigint"), doublings), most)


def bitmaps(sets: DataFrame, words: int | Column) -> DataFrame:
    """(set_id, bitmap) of sets (set_id, items); a bitmap is an array of ``words`` words."""
    items = sets.select("set_id", F.lit(words).cast("bigint").alias("words"), F.explode("items").alias("item"))
    h = F.xxhash64(F.lit("cell"), "item")
    cells = items.select(
        "set_id",
        "words",
        F.pmod(h, F.col("words")).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58).cast("int")).alias("bit"),
    )
    halves = cells.groupBy("set_id", "words", "word").agg(F.bit_xor("bit").alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    each = F.sequence(F.lit(0).cast("bigint"), F.col("words") - 1)
    dense = F.transform(each, lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("bigint")))
    return halves.groupBy("set_id", "words").agg(held.alias("held")).select("set_id", dense.alias("bitmap"))


def parity(items: Column) -> Column:
    """A bitmap of a single word, made inside the row."""

    def flip(bits: Column, item: Column) -> Column:
        cell = F.shiftrightunsigned(F.xxhash64(F.lit("cell"), item), 58).cast("int")
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), cell))

    return F.aggregate(items, F.lit(0).cast("bigint"), flip)


def unequal_bits(bits_a: Column, bits_b: Column) -> Column:
    """Cells in which two bitmaps of a word differ."""
    return F.bit_count(bits_a.bitwiseXOR(bits_b))


def folded(bitmap: Column, words: Column) -> Column:
    """A bitmap as it would be of fewer ``words``, both powers of two: cells that fall together are added up."""
    none = F.lit(0).cast("bigint")

    def word(i: Column) -> Column:
        parts = F.sequence(F.lit(0), F.call_function("div", F.size(bitmap), words).cast("int") - 1)
        return F.aggregate(parts, none, lambda bits, j: bits.bitwiseXOR(F.get(bitmap, i + j * words)))

    return F.when(F.size(bitmap) == words, bitmap).otherwise(F.transform(F.sequence(F.lit(0), words - 1), word))


def unequal_cells(bitmap_a: Column, bitmap_b: Column) -> Column:
    """Cells in which two bitmaps differ, the wider one folded; null if either is."""
    words = F.least(F.size(bitmap_a), F.size(bitmap_b))
    unequal = F.zip_with(folded(bitmap_a, words), folded(bitmap_b, words), unequal_bits)
    return F.aggregate(unequal, F.lit(0), lambda total, x: total + x)


def possible_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose bitmaps leave room for the overlap they need, written.

    ``sets`` has (set_id, n, items).  Sets of up to INLINE_ITEMS items have no bitmap, and
    their pairs stay.  Bitmaps have one width up to the mean size, and larger sets wider ones,
    as their unlike pairs differ in more items.  Fewer pairs than sets come back as they are:
    their items are less than all bitmaps.
    """
    pairs = write_once(pairs, "pairs")
    wide = F.col("n") > INLINE_ITEMS
    count, mean = sets.where(wide).agg(F.count("*"), F.avg("n")).first()
    if not count or pairs.count() < count:
        return pairs
    words = bitmap_words(mean, threshold)
    width = own_words(F.col("n"), words, mean)
    maps = write_once(bitmaps(sets.where(wide), width), "bitmaps")
    n_a, n_b = F.col("n_a"), F.col("n_b")

    def left_by_bitmaps(part: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            own = maps.select(F.col("set_id").alias(side), F.col("bitmap").alias(f"bitmap_{side}"))
            part = part.join(own, side, "left")
        unequal = F.coalesce(unequal_cells(F.col("bitmap_a"), F.col("bitmap_b")), F.lit(0))
        room = n_a + n_b - unequal >= 2 * S.required_overlap(n_a, n_b, threshold)
        return part.where(room).select("a", "b", "n_a", "n_b")

    travel = only_row(pairs.agg(F.sum(own_words(n_a, words, mean))))[0]
    held = only_row(sets.where(wide).agg(F.sum("n")))[0]
    possible = in_passes(pairs, "a", passes(8 * travel, 8 * held, PASS_BYTES), left_by_bitmaps, "possible")
    possible = write_once(possible, "possible")
    drop(pairs, maps)
    return possible
