import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute_force import class_list, signature_join, signatures, similar_pairs
from nearset.functions.sets import length_classes
from nearset.operators import simjoin
from nearset.operators.itemsets import item_rows, unique_rows
from nearset.operators.signatures import Scheme, make_signatures, rank_items
from nearset.operators.simjoin import similar_groups, similarity_join
from nearset.operators.stats import count_comparisons, join_stats, pair_counts

SMALL_BOUNDS = dict(split_rows=6, hot_rows=3, block_rows=3)


def frame(spark, rows):
    return spark.createDataFrame(rows, "user bigint, movie bigint")


def family(seed, users=60, movies=25, largest=12, copies=0):
    rng = random.Random(seed)
    rows = []
    for user in range(users):
        size = rng.randint(1, largest)
        # square the draw, so that a few movies are very frequent
        chosen = {int(movies * rng.random() ** 2) for _ in range(size)}
        rows += [(user, movie) for movie in chosen]
    for copy in range(copies):
        rows += [(1000 + copy, movie) for movie in (1, 2, 3, 4)]
    rng.shuffle(rows)
    return rows


def found(df):
    return {(r.id_a, r.id_b): (r.overlap, r.jaccard) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
def test_exact_for_one_item_signatures(spark, threshold):
    rows = family(int(threshold * 10), copies=5)
    got = similarity_join(frame(spark, rows), "user", "movie", threshold)
    assert got.count() == len(found(got))
    assert found(got) == similar_pairs(rows, threshold)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
@pytest.mark.parametrize("size", [1, 2])
def test_task_bounds_do_not_change_the_result(spark, threshold, size):
    rows = family(17, copies=9)
    bag, _ = signature_join(rows, threshold, size)
    got = similarity_join(
        frame(spark, rows), "user", "movie", threshold, size, distinct=False, **SMALL_BOUNDS
    )
    assert Counter((r.id_a, r.id_b) for r in got.collect()) == bag
    if size == 1:
        assert set(bag) == set(similar_pairs(rows, threshold))


MODES = [(1, None), (1, "reference"), (2, None), (2, "complete"), (3, "reference")]


@pytest.mark.parametrize("size, mode", MODES)
def test_bag_and_statistics(spark, size, mode):
    rows = family(5, copies=4)
    threshold = 0.5
    bag, comparisons = signature_join(rows, threshold, size, mode)
    df = frame(spark, rows)
    got = similarity_join(df, "user", "movie", threshold, size, mode, distinct=False)
    assert Counter((r.id_a, r.id_b) for r in got.collect()) == bag

    stats = join_stats(df, "user", "movie", threshold, size, mode).first()
    assert stats.signatures == len(signatures(rows, threshold, size, mode))
    assert stats.comparisons == comparisons
    assert stats.emitted == sum(bag.values())
    assert stats.distinct_pairs == len(bag)
    assert stats.duplicate_rate == pytest.approx(1 - len(bag) / sum(bag.values()))


def test_complete_classes_change_nothing_and_long_signatures_only_lose(spark):
    rows = family(23, largest=20)
    df = frame(spark, rows)
    for threshold in (0.3, 0.7):
        exact = similar_pairs(rows, threshold)
        complete = similarity_join(df, "user", "movie", threshold, length_classes="complete")
        assert found(complete) == exact
        pairs = found(similarity_join(df, "user", "movie", threshold, 2))
        assert set(pairs) <= set(exact)


def test_long_prefixes_are_checked_instead_of_combined(spark, monkeypatch):
    rows = family(31, largest=20, copies=3)
    monkeypatch.setattr(simjoin, "_MAX_COMBINATIONS", 10)
    for mode in (None, "reference"):
        bag, _ = signature_join(rows, 0.4, 3, mode)
        got = similarity_join(frame(spark, rows), "user", "movie", 0.4, 3, mode, distinct=False)
        assert Counter((r.id_a, r.id_b) for r in got.collect()) == bag


def test_two_item_signatures_of_equal_sets_only(spark):
    rows = family(3, copies=3)
    got = similarity_join(frame(spark, rows), "user", "movie", 1.0, 2)
    assert set(found(got)) == set(similar_pairs(rows, 1.0))


def test_order_by_item(spark):
    rows = family(41)
    bag, _ = signature_join(rows, 0.5, 1, None, "item")
    got = similarity_join(
        frame(spark, rows), "user", "movie", 0.5, order="item", distinct=False
    )
    assert Counter((r.id_a, r.id_b) for r in got.collect()) == bag


def test_hot_item_of_a_third_of_all_sets(spark):
    # every third set is {hot item, own items}: one bucket with many members
    rows = [(u, 0) for u in range(0, 150, 3)]
    rows += [(u, 1000 + u) for u in range(150)] + [(u, 5 + u % 40) for u in range(150)]
    expected = similar_pairs(rows, 0.3)
    df = frame(spark, rows)
    got = similarity_join(df, "user", "movie", 0.3, hot_rows=10, block_rows=7)
    assert found(got) == expected

    # with one shared item not enough, splitting leaves no candidate in the hot bucket
    scheme = Scheme(0.5)
    prepared = simjoin.prepare(unique_rows(item_rows(df, "user", "movie")), scheme)
    plain = simjoin.candidates(prepared.sets, scheme, hot_rows=10**6)
    split = simjoin.candidates(prepared.sets, scheme, hot_rows=10, block_rows=7)
    assert split.count() <= plain.count()
    assert found(similarity_join(df, "user", "movie", 0.5, hot_rows=10)) == similar_pairs(rows, 0.5)


def test_group_of_copies(spark):
    rows = [(u, m) for u in range(40) for m in (1, 2, 3)]
    rows += [(100 + u, m) for u in range(30) for m in (1, 2, 3, 4)] + [(500, 9)]
    df = frame(spark, rows)
    expected = similar_pairs(rows, 0.7)
    assert len(expected) == 40 * 39 // 2 + 30 * 29 // 2 + 40 * 30
    assert found(similarity_join(df, "user", "movie", 0.7, block_rows=8)) == expected

    pairs, members = similar_groups(df, "user", "movie", 0.7)
    assert [(r.rep_a, r.rep_b, r.copies_a, r.copies_b) for r in pairs.collect()] == [(0, 100, 40, 30)]
    assert members.count() == 71
    group = {r.set_id: r.rep for r in members.collect()}
    assert group[39] == 0 and group[129] == 100 and group[500] == 500


def test_one_huge_set(spark):
    rng = random.Random(3)
    rows = [(1, m) for m in range(400)] + [(2, m) for m in range(20, 410)]
    rows += [(3, m) for m in range(0, 400)] + [(4, m) for m in range(0, 390)]
    rows += [(10 + u, rng.randrange(400)) for u in range(50) for _ in range(10)]
    rows += rows[:200]  # repeated rows count once
    df = frame(spark, rows)
    for threshold in (0.9, 0.95):
        got = similarity_join(df, "user", "movie", threshold, split_rows=395)
        assert found(got) == similar_pairs(rows, threshold)
    ranked = rank_items(item_rows(df, "user", "movie"), split_rows=100)
    whole = rank_items(item_rows(df, "user", "movie"))
    assert sorted(ranked.collect()) == sorted(whole.collect())


@pytest.mark.parametrize("size, mode", MODES)
def test_signature_text(spark, size, mode):
    rows = family(2, users=25)
    expected = Counter()
    for set_id, c, combo in signatures(rows, 0.5, size, mode):
        text = ";".join(map(str, combo))
        expected[set_id, text if mode is None else f"{c}_{text}"] += 1
    scheme = Scheme(0.5, size, mode)
    for split_rows in (200_000, 4):
        ranked = rank_items(item_rows(frame(spark, rows), "user", "movie"), split_rows=split_rows)
        got = make_signatures(ranked, scheme, split_rows)
        assert Counter((r.set_id, r.signature) for r in got.collect()) == expected


def test_hand_made_cases(spark):
    def pairs(rows, *args, **kwargs):
        return set(found(similarity_join(frame(spark, rows), "user", "movie", *args, **kwargs)))

    # a list shorter than the signature is its own signature
    assert pairs([(1, 1), (2, 1)], 0.9, 2) == {(1, 2)}
    # two-item signatures miss a pair that shares one item
    rows = [(1, 1), (2, 1), (2, 2)]
    assert pairs(rows, 0.5, 1) == {(1, 2)} and pairs(rows, 0.5, 2) == set()
    # two length classes are too few for sizes 6 and 11
    rows = [(1, m) for m in range(1, 7)] + [(2, m) for m in range(1, 12)]
    assert pairs(rows, 0.5, length_classes="reference") == set()
    assert pairs(rows, 0.5, length_classes="complete") == {(1, 2)}
    # 0.55 * 100 is slightly more than 55 in double arithmetic
    rows = [(1, m) for m in range(55)] + [(2, m) for m in range(100)]
    assert pairs(rows, 0.55) == set()
    # repeated rows count once
    assert found(similarity_join(frame(spark, [(1, 1), (1, 1), (2, 1)]), "user", "movie"))[
        1, 2
    ] == (1, 1.0)


def test_bag_counts(spark):
    rows = [(u, m) for u in (1, 2) for m in (1, 2)] + [(3, 2)]
    bag = similarity_join(frame(spark, rows), "user", "movie", 0.5, distinct=False)
    counts = pair_counts(bag).first()
    expected, _ = signature_join(rows, 0.5)
    assert (counts.emitted, counts.distinct_pairs) == (sum(expected.values()), len(expected))


def test_no_pairs_give_no_duplicate_rate(spark):
    stats = join_stats(frame(spark, [(1, 1), (2, 2)]), "user", "movie").first()
    assert (stats.emitted, stats.distinct_pairs, stats.duplicate_rate) == (0, 0, None)
    assert stats.comparisons == 0 and stats.signatures == 2


def test_text_items_and_ids(spark):
    rows = [("a", "x;y"), ("a", "z"), ("b", "x;y"), ("b", "z"), ("c", "z")]
    df = spark.createDataFrame(rows, "user string, movie string")
    assert set(found(similarity_join(df, "user", "movie", 0.9))) == {("a", "b")}


def test_parameters_are_checked():
    for bad in (
        dict(threshold=0.0),
        dict(threshold=1.1),
        dict(size=0),
        dict(length_classes="all"),
        dict(order="random"),
        dict(prefix_items=0),
    ):
        with pytest.raises(ValueError):
            Scheme(**bad)


def test_fixed_prefix_is_a_subset(spark):
    rows = family(8, copies=3)
    df = frame(spark, rows)
    pairs = found(similarity_join(df, "user", "movie", 0.3, prefix_items=2))
    exact = similar_pairs(rows, 0.3)
    ranked = rank_items(item_rows(df, "user", "movie")).where(F.col("rk") <= 2)
    prefix = {}
    for r in ranked.collect():
        prefix.setdefault(r.set_id, set()).add(r.item)
    assert set(pairs) == {(a, b) for a, b in exact if prefix[a] & prefix[b]}


def test_prefix_items_below_the_signature_size_are_rejected():
    with pytest.raises(ValueError, match="at least the signature size"):
        Scheme(0.5, 2, prefix_items=1)


@pytest.fixture()
def hot_item(spark):
    """Rows of which a third holds one item, joined without broadcasts and in small partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.shuffle.partitions": "30",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    # several partitions, as only blocks of a partition can be split apart
    ids = spark.range(0, 30_000, 1, 16)
    item = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    yield ids.select(F.floor(F.col("id") / 3).alias("set_id"), item.alias("item"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_item_is_split_over_tasks(hot_item):
    ranked = rank_items(hot_item)
    assert len(ranked.collect()) == 30_000
    assert "skew=true" in ranked._jdf.queryExecution().toString()


def test_comparisons_of_one_signature_with_very_many_sizes(spark):
    """Sizes meet sizes by sums over their order: work grows with them, not with their square."""
    sizes = spark.range(1, 50_001).select(F.array(F.lit(1)).alias("sig"), F.lit(0).alias("class"), F.col("id").alias("n"))
    rows = sizes.unionAll(sizes.where("n % 7 = 0"))
    got = count_comparisons(rows, 0.55).first()["comparisons"]
    count = [0] + [2 if n % 7 == 0 else 1 for n in range(1, 50_001)]
    sums = list(itertools.accumulate(count))
    expected = sum(
        count[n] * (sums[n - 1] - sums[max(1, math.ceil(n * 0.55)) - 1]) + count[n] * (count[n] - 1) // 2
        for n in range(1, 50_001)
    )
    assert got == expected


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9, 0.99, 0.9999])
def test_length_classes_are_stepped_to(spark, threshold):
    """Few marks in the plan and few steps in the row give what a list of all class starts gives."""
    rng = random.Random(int(threshold * 1e4))
    sizes = sorted({*range(1, 60), *(rng.randrange(1, 30_000) for _ in range(40)), 10_000, 10_001})
    began = time.monotonic()
    n = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    modes = ("reference", "complete")
    df = n.select("n", *[length_classes(F.col("n"), threshold, mode).alias(mode) for mode in modes])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - began < 20 and len(plan) < 200_000
    for r in df.collect():
        for mode in modes:
            assert list(r[mode]) == class_list(r.n, threshold, mode), (r.n, mode)
