"""What is left on disk: shuffle files and tables that nothing reads again, and what one pass over pairs shuffles."""

import glob
import os
import time

import pytest

from brute_force import similar_pairs
from nearset import runtime
from nearset.operators import blocks, simjoin, sketches, stats, text
from nearset.operators.itemsets import item_rows, unique_rows
from nearset.operators.signatures import Scheme
from nearset.plans import programs
from test_simjoin import family, found, frame
from test_sketches import texts


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def _names(folder):
    return sorted(name.rsplit("-", 1)[0] for name in os.listdir(folder))


def test_a_written_table_leaves_no_shuffle(spark, folder):
    """F1 F2 F4 to F10: shuffle files were left until the driver collected the plan."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f for top in tops for f in glob.glob(f"{top}/**/shuffle_*.data", recursive=True)}

    before, setting = shuffled(), spark.conf.get(runtime._FREE_SHUFFLES, None)
    runtime.write_once(spark.range(1000).repartition(3, "id"), "table")
    assert runtime.only_row(spark.range(1000).repartition(3, "id").groupBy("id").count())["count"] == 1
    assert spark.conf.get(runtime._FREE_SHUFFLES, None) == setting
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert not shuffled() - before


def test_tables_that_are_read_no_more_are_dropped(spark, folder):
    """F5 F7: rows, profiles and places of a join were kept beside its sets."""
    df = frame(spark, family(3, users=40))
    rows = similar_pairs([(r.user, r.movie) for r in df.collect()], 0.5)
    got = simjoin.similarity_join(df, "user", "movie", 0.5, signature_size=1, adaptive=True)
    assert found(got) == rows
    assert not {"rows", "profile", "groups", "frequency", "places", "signed-sets", "levels"} & set(_names(folder))


def test_join_statistics_leave_their_sums_only(spark, folder):
    """pairs were found once for each number, and nothing was dropped."""
    got = stats.join_stats(frame(spark, family(4, users=40)), "user", "movie", 0.5, 2)
    assert not {"rows", "sets"} & set(_names(folder))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and got.count() == 1


def test_signatures_of_several_items_travel_once_and_without_items(spark):
    """F5 F7 F9: both sides of the join were shuffled, with all items of their sets."""
    df = frame(spark, family(5, users=40))
    for scheme in (Scheme(0.3, 3), Scheme(0.3, adaptive=True)):
        prepared = simjoin.prepare(unique_rows(item_rows(df, "user", "movie")), scheme)
        signed, blocks_, sought = simjoin.join_keys(prepared.sets, scheme)
        met = simjoin._met(signed, scheme, blocks_, sought, {})
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            met.collect()
            plan = met._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "ReusedExchange" in plan
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "own" in line]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_passes_lose_no_pair(spark, monkeypatch, threshold):
    """candidates, bitmaps and item lists grow with the square of the sets; they are shuffled part by part."""
    for module in (simjoin, sketches):
        monkeypatch.setattr(module, "PASS_BYTES", 1)
        monkeypatch.setattr(module, "passes", lambda amount, sets, most: min(3, blocks.passes(amount, 0, most)))
    monkeypatch.setattr(simjoin, "PASS_ROWS", 1)
    monkeypatch.setattr(simjoin, "PART", 1)
    rows = texts(9, families=6) + [(1000 + u, m) for u, m in family(8)]
    got = simjoin.similarity_join(frame(spark, rows), "user", "movie", threshold)
    assert found(got) == similar_pairs(rows, threshold)
    # three parts of each of the steps, beside what is written anyway
    files = {f.split("/")[-2].rsplit("-", 1)[0] for f in got.inputFiles()}
    assert files <= {"confirmed", "similar-contents", "copies", "sets"}


def test_large_sets_have_wider_bitmaps(spark):
    """bitmaps of the mean width were full for large sets, so most of their pairs were compared."""
    small = {s: list(range(100 * s, 100 * s + 40)) for s in range(1, 60)}
    # two large sets that share a third of their items
    large = {100: list(range(10_000, 13_000)), 101: list(range(12_000, 15_000))}
    data = [(s, len(items), items) for s, items in (small | large).items()]
    sets = spark.createDataFrame(data, "set_id bigint, n bigint, items array<bigint>")
    pairs = [(100, 101, 3000, 3000)] + [(s, s, 40, 40) for s in small] + [(100, 100, 3000, 3000), (101, 101, 3000, 3000)]
    pairs = spark.createDataFrame(pairs, "a bigint, b bigint, n_a bigint, n_b bigint")
    left = {(r.a, r.b) for r in sketches.possible_pairs(pairs, sets, 0.5).collect()}
    assert (100, 101) not in left and {(s, s) for s in small} | {(100, 100), (101, 101)} == left


def test_bitmaps_of_unequal_width_are_folded(spark):
    a, b = list(range(0, 100)), list(range(50, 400))
    sets = spark.createDataFrame([(1, a), (2, b)], "set_id bigint, items array<bigint>")
    narrow = {r.set_id: r.bitmap for r in sketches.bitmaps(sets, 4).collect()}
    wide = {r.set_id: r.bitmap for r in sketches.bitmaps(sets, 16).collect()}
    rows = spark.createDataFrame([(narrow[1], wide[2], narrow[2]), (None, wide[2], None)], "a array<bigint>, w array<bigint>, b array<bigint>")
    got = rows.select(sketches.unequal_cells(rows.a, rows.w).alias("x"), sketches.unequal_cells(rows.w, rows.a).alias("y"), sketches.unequal_cells(rows.a, rows.b).alias("z")).collect()
    assert got[0].x == got[0].y == got[0].z > 0 and got[1].x is None


def test_subjects_travel_with_their_weights(spark, folder):
    """F8: weights were shuffled once more to meet their subjects, beside a table of all texts."""
    path = str(folder / "lines.nt")
    spark.createDataFrame([(f'<s{i % 2}> <p> "a b{i} b{i}"@en .',) for i in range(4)], "value string").write.text(path)
    got = programs.abstract_weights(spark, path)
    assert "lines" not in _names(folder)
    assert "doc_id" not in "".join(x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x)
    assert sorted((r.subject, r.term, r.cnt) for r in got.collect()) == sorted(
        (f"s{i % 2}", t, c) for i in range(4) for t, c in (("a", 1), (f"b{i}", 2))
    )


def test_documents_are_rendered_from_numbers(spark):
    """each weight was shuffled as text that held its term a second time."""
    weights = spark.createDataFrame([(1, "b", 0.5), (1, "a", 1.25), (2, "c", None)], "doc_id bigint, term string, weight double")
    lines = text.render_documents(weights)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert "format_string" not in [x for x in plan.splitlines() if "Aggregate" in x and "partial" in x][0]
    assert {r.doc_id: r.line for r in lines.collect()} == {1: "1: {a=1.250000000, b=0.500000000}", 2: "2: {c=null}"}


def test_counts_inside_words_are_written_before_they_meet_frequencies(spark, folder):
    """the words inside words were on disk until the weights were done."""
    docs = spark.createDataFrame([(1, "with it it"), (2, "it and with")], "doc_id bigint, text string")
    got = text.tf_idf(docs, weighting="reference", count_mode="substring")
    assert "inside-counts" in _names(folder) and "counts" not in _names(folder)
    assert {(r.doc_id, r.term): r.cnt for r in got.collect()} == {(1, "with"): 1, (1, "it"): 3, (2, "it"): 2, (2, "and"): 1, (2, "with"): 1}
