"""Bitmaps and adaptive signatures: nothing is lost, and fewer pairs are left to verify."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute_force import similar_pairs
from nearset.operators import simjoin, sketches
from nearset.operators.adaptive import chosen_sizes
from nearset.operators.itemsets import item_rows, unique_rows
from nearset.operators.signatures import Scheme
from nearset.operators.simjoin import similarity_join
from test_simjoin import family, found, frame


def texts(seed, families=12, copies=5, words=120, vocabulary=400):
    """Sets of common words, with edited copies: many candidates, few similar pairs."""
    rng = random.Random(seed)
    draw = lambda: int(vocabulary * rng.random() ** 1.3)
    rows, set_id = [], 0
    for _ in range(families):
        base = {draw() for _ in range(words)}
        for _ in range(copies):
            own = {x if rng.random() < 0.93 else draw() for x in base}
            rows += [(set_id, x) for x in own]
            set_id += 1
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
@pytest.mark.parametrize("words", [2, 8, 32])
def test_bitmaps_lose_no_pair(spark, monkeypatch, threshold, words):
    monkeypatch.setattr(sketches, "bitmap_words", lambda mean, t: words)
    rows = texts(words) + [(1000 + u, m) for u, m in family(7)]
    got = similarity_join(frame(spark, rows), "user", "movie", threshold)
    assert found(got) == similar_pairs(rows, threshold)


def test_bitmaps_leave_a_tenth_of_the_pairs(spark):
    """Rows that reach the exact overlap fall by ten or more."""
    rows = texts(3, families=40)
    scheme = Scheme(0.6)
    prepared = simjoin.prepare(unique_rows(item_rows(frame(spark, rows), "user", "movie")), scheme)
    pairs = simjoin.candidates(prepared.sets, scheme)
    left = sketches.possible_pairs(pairs, prepared.sets, 0.6)
    similar = len(similar_pairs(rows, 0.6))
    assert similar <= left.count() <= pairs.count() / 10


def test_pairs_of_small_sets_and_few_pairs_need_no_bitmap(spark):
    sets = spark.createDataFrame([(i, 40, list(range(i, i + 40))) for i in range(5)], "set_id bigint, n bigint, items array<bigint>")
    pairs = spark.createDataFrame([(0, 4, 40, 40)], "a bigint, b bigint, n_a bigint, n_b bigint")
    assert sketches.possible_pairs(pairs, sets, 0.99).count() == 1
    small = spark.createDataFrame([(1, 1, [5]), (2, 1, [6])], "set_id bigint, n bigint, items array<bigint>")
    assert sketches.possible_pairs(pairs, small, 0.99).count() == 1


@settings(max_examples=15, deadline=None)
@given(a=st.sets(st.integers(0, 300), min_size=1), b=st.sets(st.integers(0, 300), min_size=1), words=st.sampled_from([2, 4, 16]))
def test_unequal_cells_are_no_more_than_unequal_items(spark, a, b, words):
    sets = spark.createDataFrame([(1, sorted(a)), (2, sorted(b))], "set_id bigint, items array<bigint>")
    maps = {r.set_id: r.bitmap for r in sketches.bitmaps(sets, words).collect()}
    assert len(maps[1]) == len(maps[2]) == words
    unequal = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(maps[1], maps[2]))
    assert unequal <= len(a ^ b) and (unequal - len(a ^ b)) % 2 == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("bounds", [{}, dict(split_rows=6, hot_rows=3, block_rows=3)])
def test_adaptive_signatures_are_exact(spark, threshold, bounds):
    rows = family(int(threshold * 100), users=90, movies=30, copies=6)
    got = similarity_join(frame(spark, rows), "user", "movie", threshold, adaptive=True, **bounds)
    assert got.count() == len(found(got))
    assert found(got) == similar_pairs(rows, threshold)


def test_adaptive_signatures_with_long_prefixes_and_mixed_choices(spark):
    # large sets cannot sign with pairs, small ones do
    rows = texts(5, families=6) + [(1000 + u, m) for u, m in family(11, users=80)]
    for threshold in (0.4, 0.8):
        got = similarity_join(frame(spark, rows), "user", "movie", threshold, adaptive=True)
        assert found(got) == similar_pairs(rows, threshold)


def test_adaptive_signatures_make_fewer_candidates(spark):
    rng = random.Random(2)
    rows = [(u, rng.randrange(60)) for u in range(600) for _ in range(6)]
    # sets of rare items gain nothing by looking for two of them
    rows += [(1000 + u, 1000 + 6 * (u // 2) + j) for u in range(100) for j in range(6)]
    rows = unique_rows(item_rows(frame(spark, rows), "user", "movie"))
    counts = {}
    for adaptive in (False, True):
        scheme = Scheme(0.5, adaptive=adaptive)
        prepared = simjoin.prepare(rows, scheme)
        counts[adaptive] = simjoin.candidates(prepared.sets, scheme).count()
    levels = {r.level for r in chosen_sizes(prepared.sets, scheme, prepared.sets.count()).collect()}
    assert levels == {1, 2}
    assert counts[True] < counts[False] / 3


def test_adaptive_signatures_of_odd_tables(spark):
    for rows in ([], [(1, 1)], [(1, 1), (2, 1)], [(1, None), (None, 1), (3, 3), (3, 3), (4, 3)]):
        got = similarity_join(frame(spark, rows), "user", "movie", 0.5, adaptive=True)
        assert found(got) == similar_pairs([r for r in rows if None not in r], 0.5)
    with pytest.raises(ValueError):
        Scheme(0.5, 2, adaptive=True)
