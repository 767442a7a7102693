"""Statistics of a join: bucket sizes, comparisons, duplicates.

Nothing here lists pairs that are only counted: comparisons are sums over the
sorted sizes of a signature, and copies enter as weights.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.functions import sets as S
from nearset.operators.itemsets import SPLIT_ROWS, item_rows, set_sizes, unique_rows
from nearset.operators.signatures import Scheme, rank_items, signature_rows, with_classes
from nearset.operators.simjoin import prepare, similar_sets, times_copied, times_found
from nearset.runtime import drop, write_once


def bucket_sizes(signatures: DataFrame) -> DataFrame:
    """Sets per signature, shared signatures only: (signature, size)."""
    return (
        signatures.groupBy("signature")
        .agg(F.count("*").alias("size"))
        .where(F.col("size") > 1)
    )


def shared_signatures(signatures: DataFrame) -> DataFrame:
    """Signature rows that have a partner: (set_id, signature)."""
    signatures = write_once(signatures, "signatures")
    # written before it is joined, so that a hot signature is split over tasks
    shared = write_once(bucket_sizes(signatures).select("signature"), "buckets")
    return signatures.join(shared, "signature", "left_semi")


def count_comparisons(signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs per signature that pass the length filter, summed: (comparisons).

    Sizes of a signature are sorted once.  A set of n items meets the sets of size
    ``ceil(t * n)`` up to n, and how many these are is the difference of two sums of what
    comes before: before n, and before the smallest size it may meet.
    """
    return _comparisons(signed.groupBy("sig", "class", "n").agg(F.count("*").alias("sets")), ["sig", "class"], threshold)


def _comparisons(sizes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The same of the number of sets for each size ``n`` under ``keys``."""
    # rows are doubled where they have arrived
    sizes = sizes.repartition(*keys)
    fewest = S.min_partner_size(F.col("n"), threshold).cast("bigint")
    # a mark at its smallest partner stands before the sets of that size
    marks = [(fewest, 0), (F.col("n"), 1)]
    ends = F.explode(F.array(*[F.struct(at.alias("at"), F.lit(kind).alias("kind")) for at, kind in marks]))
    rows = sizes.select(*keys, "sets", ends.alias("end")).select(*keys, "sets", "end.*")
    earlier = W.partitionBy(*keys).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    own = F.col("kind") == 1
    before = F.coalesce(F.sum(F.when(own, F.col("sets"))).over(earlier), F.lit(0))
    sets = F.col("sets")
    same_size = F.call_function("div", sets * (sets - 1), F.lit(2).cast("bigint"))
    met = F.when(own, sets * F.col("before") + same_size).otherwise(-sets * F.col("before"))
    return rows.withColumn("before", before).agg(F.coalesce(F.sum(met), F.lit(0)).alias("comparisons"))


def count_signatures(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Signatures of all sets of unique rows, by the number of combinations of each size: (signatures)."""
    sizes = set_sizes(rows).groupBy("n").agg(F.count("*").alias("sets"))
    each = F.col("sets") * times_copied(scheme)
    return sizes.agg(F.coalesce(F.sum(each), F.lit(0)).cast("bigint").alias("signatures"))


def join_stats(
    df: DataFrame,
    set_col: str,
    item_col: str,
    threshold: float = 0.9,
    signature_size: int = 1,
    length_classes: str | None = None,
    order: str = "frequency",
    prefix_items: int | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row: (signatures, comparisons, emitted, distinct_pairs, duplicate_rate).

    ``emitted`` counts a pair once per shared signature; ``duplicate_rate`` is
    1 - distinct_pairs / emitted, NULL when there are no pairs.
    """
    scheme = Scheme(threshold, signature_size, length_classes, order, prefix_items)
    rows = unique_rows(item_rows(df, set_col, item_col))
    ranked = rank_items(rows, order, split_rows, unique=True)
    # sets are counted by size before their size is taken to its classes
    signed = signature_rows(ranked, replace(scheme, length_classes=None), split_rows)
    # the items of a signature are columns, which are shorter than an array of them
    keys = [f"item_{i}" for i in range(scheme.size)]
    signed = signed.select("n", *[F.get("sig", i).alias(k) for i, k in enumerate(keys)])
    sizes = signed.groupBy(*keys, "n").agg(F.count("*").alias("sets"))
    if length_classes is not None:
        sizes = with_classes(write_once(sizes, "sizes"), scheme).withColumn("class", F.explode("classes"))
        keys = [*keys, "class"]
    # each part is written, so that what is shuffled for it is gone before the next
    comparisons = write_once(_comparisons(sizes, keys, threshold), "comparisons")

    prepared = prepare(rows, scheme, split_rows)
    found = times_found(similar_sets(prepared, scheme, split_rows), scheme)
    weights = found.select((F.col("copies_a") * F.col("copies_b")).alias("pairs"), "times")
    if prepared.members is not None:
        copies = F.col("copies")
        equal = F.call_function("div", copies * (copies - 1), F.lit(2).cast("bigint"))
        groups = prepared.members.where(F.col("set_id") == F.col("rep"))
        weights = weights.unionByName(
            groups.select(equal.alias("pairs"), times_copied(scheme).alias("times"))
        )
    pairs = weights.agg(
        F.coalesce(F.sum(F.col("pairs") * F.col("times")), F.lit(0)).alias("emitted"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("distinct_pairs"),
    )
    pairs = write_once(pairs, "pair-sums")
    signatures = write_once(count_signatures(rows, scheme), "signatures")
    drop(rows, prepared.sets)
    # three one-row frames side by side
    return (
        signatures
        .withColumn("comparisons", comparisons.scalar())
        .withColumn("emitted", pairs.select("emitted").scalar())
        .withColumn("distinct_pairs", pairs.select("distinct_pairs").scalar())
        .withColumn("duplicate_rate", duplicate_rate(F.col("distinct_pairs"), F.col("emitted")))
    )


def duplicate_rate(distinct_pairs, emitted):
    """1 - distinct / emitted in DOUBLE; NULL without pairs."""
    return F.when(emitted > 0, F.lit(1.0) - distinct_pairs / emitted)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Count, distinct count and duplicate rate of a bag of (id_a, id_b)."""
    per_pair = pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("times"))
    return per_pair.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("emitted"),
        F.count("*").alias("distinct_pairs"),
    ).withColumn("duplicate_rate", duplicate_rate(F.col("distinct_pairs"), F.col("emitted")))


def as_counters(stats: DataFrame, names: list[str]) -> DataFrame:
    """BIGINT columns as rows: (name, value)."""
    return stats.unpivot([], names, "name", "value")


def sum_counters(counters: DataFrame) -> DataFrame:
    """Sum of each named counter: (name, value)."""
    return counters.groupBy("name").agg(F.sum("value").alias("value"))
