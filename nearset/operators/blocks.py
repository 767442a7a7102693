"""Pairing the rows of one key without one task holding all of them."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.runtime import write_once

# Rows per block.  A task pairs one block with one other block.
BLOCK_ROWS = 4096

# Pairs grow with the square of the sets.  What is shuffled for them at once, if the sets
# themselves are not more: rows, and bytes before they are compressed.
PASS_ROWS, PASS_BYTES = 1 << 26, 1 << 30


def block_count(rows: Column, block_rows: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(block_rows)), F.lit(1)).cast("int")


def block_of(row_id: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(row_id), blocks).cast("int")


def every_block(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def blocked_sides(df: DataFrame, row_id: str, rows: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a self-join whose keys hold up to ``rows`` rows each.

    Adds ``left_block`` and ``right_block``.  A row has one block of its own
    and is repeated for each block of the other side, so every ordered pair of
    rows of a key meets exactly once, in the task of its block pair.  Keys of
    at most ``block_rows`` rows have a single block and are not repeated.
    """
    blocks = block_count(F.col(rows), block_rows)
    own = block_of(F.col(row_id), blocks)
    left = df.withColumn("left_block", own).withColumn("right_block", every_block(blocks))
    right = df.withColumn("right_block", own).withColumn("left_block", every_block(blocks))
    return left, right


def passes(amount: float, sets: float, most: int) -> int:
    """Passes in which ``amount`` of pairs is shuffled, each of ``most``, or of ``sets`` if that is more."""
    return max(1, math.ceil(amount / max(most, sets)))


def in_passes(df: DataFrame, key: str, count: int, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``step`` of all rows of ``df``, of one part of the values of ``key`` after the other.

    Each part is written before the next begins, so that disk holds what is shuffled for one.
    """
    if count == 1:
        return step(df)
    part = F.pmod(F.xxhash64(F.lit("pass"), key), F.lit(count))
    done = [write_once(step(df.where(part == i)), name) for i in range(count)]
    return functools.reduce(DataFrame.unionByName, done)
