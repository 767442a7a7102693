"""Signatures of one or two items, chosen for each set by what they would cost.

Two similar sets share at least k of their first n - ceil(t * n) + k items, for k = 1 and,
if the larger one needs two shared items at all, for k = 2 as well.  So the larger set of
a pair may choose k as it likes, as long as the smaller one can be found either way: every
set is entered under its single items and its pairs of items, and each set looks for
smaller ones under what it has chosen.  No pair is lost, unlike with a fixed k of two.

The choice compares two estimates from the frequencies of the items: the sets that hold one
of the first items, against the sets expected to hold two of them if items were independent,
and the rows that pairs of items take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators.signatures import Scheme, combine_prefix

#: Pairs of items that a set may sign with; sets with longer prefixes use single items.
MAX_PAIRS = 1000
#: No set is larger; beyond it doubles would not hold its size.
_LARGEST = 1 << 50
_ANY = 2**62  # "no limit" for a BIGINT column


def longest_paired(scheme: Scheme) -> int:
    """Largest set size whose prefix for two items has at most MAX_PAIRS pairs.

    Prefixes never get shorter as sets grow, so all smaller sets have no more pairs.
    """

    def fits(n: int) -> bool:
        return math.comb(min(n, n - math.ceil(scheme.threshold * n) + 2), 2) <= MAX_PAIRS

    low, high = 0, 1
    while high < _LARGEST and fits(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def _prefix(scheme: Scheme, level: int) -> Column:
    return F.least(F.col("n"), S.prefix_length(F.col("n"), scheme.threshold, level))


def _pairs_of(m: Column) -> Column:
    return m * (m - 1) / 2


def chosen_sizes(sets: DataFrame, scheme: Scheme, n_sets: int) -> DataFrame:
    """Add ``level``, 1 or 2: the items of the signatures that a set looks for partners with.

    ``sets`` has (n, skip, dfs), dfs being the frequencies of the items in order, at least
    of the longer prefix.
    """
    short, long = (_prefix(scheme, k).cast("int") for k in (1, 2))

    def shared(prefix: Column) -> Column:
        """Frequencies of the items of a prefix that other sets hold too."""
        return F.slice("dfs", F.col("skip") + 1, F.greatest(prefix - F.col("skip"), F.lit(0)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    one, two = shared(short), shared(long)
    squares = total(F.transform(two, lambda x: x.cast("double") * x))
    together = (F.pow(total(two), F.lit(2.0)) - squares) / (2.0 * max(1, n_sets))
    cost_two = together + _pairs_of(F.size(two))
    may_pair = (S.min_partner_size(F.col("n"), scheme.threshold) >= 2) & (F.col("n") <= longest_paired(scheme))
    return sets.withColumn("level", F.when(may_pair & (cost_two < total(one)), 2).otherwise(1))


def _signed(sets: DataFrame, scheme: Scheme, level: int) -> DataFrame:
    signed = combine_prefix(sets.withColumn("p", _prefix(scheme, level)), level, ["set_id", "n", "copies", "own", "chosen"])
    return signed.select(
        F.xxhash64("sig").alias("sig"),
        "set_id",
        "n",
        "copies",
        "own",
        "last",
        F.lit(level).alias("level"),
        F.lit(0).cast("bigint").alias("above"),
        F.lit(_ANY).cast("bigint").alias("within"),
        (F.col("chosen") == level).alias("seeks"),
    )


def adaptive_signatures(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Join keys under which smaller sets are found, and larger ones look where ``seeks`` is true.

    As ``simjoin.signed_sets`` gives them.  Every key that a set seeks under is one that it is
    entered under.
    """
    sized = chosen_sizes(sets, scheme, sets.count()).withColumnRenamed("level", "chosen")
    # only sets that may be the smaller one of a pair that looks under two items
    found_by_two = sized.where(F.col("chosen") == 2).agg(F.max("n")).first()[0]
    entered = _signed(sized, scheme, 1)
    if found_by_two:
        entered = entered.unionByName(_signed(sized.where(F.col("n") <= found_by_two), scheme, 2))
    return entered
