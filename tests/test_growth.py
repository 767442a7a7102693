"""What travels between tasks, on rows made here."""

import random

import pytest
from pyspark.sql import functions as F

from brute_force import similar_pairs
from nearset.operators import itemsets, signatures, simjoin, sketches
from nearset.operators import text as X
from nearset.operators.signatures import Scheme


def _words(count: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return sorted({"".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(count)})


def test_pieces_that_are_no_terms_end_at_the_filter(spark):
    words = _words(300, 1)
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    tokens = terms.select(F.col("term").alias("token"), F.col("term").alias("whole"))
    expected = {(w, t) for w in words for t in words if t in w}
    passed = X._pieces(tokens, 64, "whole", known=X.maybe_term(terms)).collect()
    assert expected <= {tuple(r) for r in passed}
    assert len(passed) < 1.3 * len(expected)
    # a filter that is full lets more pass, and loses nothing
    small = X._pieces(tokens, 64, "whole", known=X.maybe_term(terms, 64)).collect()
    assert expected <= {tuple(r) for r in small}


def test_terms_inside_travel_in_one_row_for_each_token(spark):
    words = [*_words(60, 2), "a:b", ":", "1:a"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    inside = X._terms_inside(terms.withColumnRenamed("term", "token"), terms)
    assert inside.count() == len(words)
    got = {(r.token, r.term): r.matches for r in X._each_inside(inside, "token").collect()}
    assert got == {(w, t): w.count(t) for w in words for t in words if t in w}


def test_substring_counts_of_repeated_ids(spark):
    rows = [(1, "ab abc b"), (1, "b b"), (2, "b bb"), (None, "ab b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in X.substring_counts(docs, X.count_terms(docs)).collect())
    # sums over both rows of id 1, once for each row that holds the term
    assert got == [(1, 2, "b", 5), (1, 3, "ab", 2), (1, 3, "abc", 1), (1, 3, "b", 5), (2, 2, "b", 3), (2, 2, "bb", 1)]


def test_ranges_of_large_sets_do_not_grow_with_their_rows(spark, monkeypatch):
    written = []

    def noted(df, name, write=signatures.write_once):
        written.append((name, write(df, name)))
        return written[-1][1]

    monkeypatch.setattr(signatures, "write_once", noted)
    rows = spark.range(4000).select((F.col("id") % 2).alias("set_id"), F.col("id").alias("item"))
    ranked = signatures.rank_large_sets(rows, "item", 10)
    assert sorted((r.set_id, r.rk, r.item) for r in ranked.collect())[:3] == [(0, 1, 0), (0, 2, 2), (0, 3, 4)]
    [parts] = [t.select("part").distinct().count() for name, t in written if name == "sorted-rows"]
    assert parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sets_are_nested_without_frequencies(spark, monkeypatch):
    def refused(rows):
        raise AssertionError("frequencies are of no use here")

    monkeypatch.setattr(signatures, "item_frequency", refused)
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, "b"), (2, "a")], "set_id long, item string")
    got = sorted((r.set_id, r.chunk, r["items"], r.n_items) for r in itemsets.to_sets(rows, 2).collect())
    assert got == [(1, 0, ["a", "b"], 2), (2, 0, ["a", "b"], 3), (2, 1, ["c"], 3)]


def test_prepared_items_are_places_in_the_order(spark):
    rows = [(s, w) for s, words in enumerate(["the fox", "the dog ran", "the fox ran", "é z"]) for w in words.split()]
    frame = spark.createDataFrame(rows, "set_id long, item string")
    places = {r.item: r.place for r in simjoin.numbered_items(frame).collect()}
    df = {w: sum(x == w for _, x in rows) for w in places}
    order = sorted(places, key=lambda w: (df[w], w.encode()))
    assert [places[w] for w in order] == list(range(1, len(order) + 1))
    sets = {r.set_id: r for r in simjoin.prepare(frame, Scheme(0.5)).sets.collect()}
    for set_id, words in {1: ["dog", "ran", "the"], 3: ["z", "é"]}.items():
        assert sets[set_id]["items"] == [places[w] for w in words]
        assert sets[set_id].skip == sum(df[w] == 1 for w in words)


def test_counts_are_not_sorted_for_their_weights(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    weights = X.tf_idf(docs)
    assert weights.count() == 4
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def _documents(seed: int, count: int = 80) -> list[tuple[int, str]]:
    """Sets of 40 to 90 words, few of them in common; every tenth is an edited copy."""
    draw, rows, last = random.Random(seed), [], []
    for doc in range(count):
        words = {int(3000 * draw.random() ** 2) for _ in range(draw.randint(40, 90))}
        if doc % 10 == 9:
            words = {w if draw.random() < 0.9 else -w for w in last}
        last = words
        rows += [(doc, w) for w in words]
    return rows


@pytest.mark.parametrize(
    "threshold, options, bounds",
    [
        (0.2, {}, {"hot_rows": 3, "block_rows": 2}),
        (0.5, {}, {}),
        (0.5, {"length_classes": "complete"}, {"hot_rows": 3, "block_rows": 2}),
        (0.5, {"order": "item"}, {"hot_rows": 3, "block_rows": 2}),
    ],
)
def test_wide_pairs_need_several_shared_items(spark, monkeypatch, threshold, options, bounds):
    counts = []

    def noted(df, name, write=sketches.write_once):
        out = write(df, name)
        counts.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(sketches, "write_once", noted)
    rows = _documents(int(10 * threshold))
    df = spark.createDataFrame(rows, "set_id long, item long")
    got = simjoin.similarity_join(df, "set_id", "item", threshold, **options, **bounds)
    assert {(r.id_a, r.id_b): r.overlap for r in got.collect()} == {p: v[0] for p, v in similar_pairs(rows, threshold).items()}
    if not bounds:
        sets = simjoin.prepare(itemsets.unique_rows(df), Scheme(threshold)).sets
        one_item = simjoin.candidates(sets, Scheme(threshold)).count()
        assert one_item > 100 and counts[0] < one_item / 3


def test_a_set_is_signed_once_for_all_its_classes(spark):
    rows = [(u, m) for u in range(30) for m in range(u, u + 2 + u % 7)]
    df = itemsets.unique_rows(spark.createDataFrame(rows, "set_id long, item long"))
    sets = simjoin.prepare(df, Scheme(0.3)).sets
    plain = simjoin.signed_sets(sets, Scheme(0.3)).count()
    for mode in ("reference", "complete"):
        assert simjoin.signed_sets(sets, Scheme(0.3, length_classes=mode)).count() == plain


def test_a_word_of_bits_bounds_what_sets_differ_in(spark):
    draw = random.Random(5)
    pairs = [[sorted(draw.sample(range(50), draw.randint(1, 32))) for _ in "ab"] for _ in range(200)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    unequal = sketches.unequal_bits(sketches.parity(F.col("a")), sketches.parity(F.col("b")))
    differ = [(r.u, len(set(r.a) ^ set(r.b))) for r in df.withColumn("u", unequal).collect()]
    assert all(u <= n and u % 2 == n % 2 for u, n in differ) and max(u for u, _ in differ) > 20
