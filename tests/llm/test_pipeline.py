"""The pipeline's stages against brute force, on rows that share an id or have none."""

import collections

import numpy as np
import pytest

import corpus_pipeline as cp
from nearset.llm.common import ROW_KEY, row_keys

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

# columns whose names the stages use themselves
SCHEMA = "doc_id bigint, text string, lang string, again_id int, several_id int, gone_id int, node int, part int"
ITEM = "which of the seven rivers flows past the old mill and into the northern sea. It is the long grey river."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def said(rng, n):
    return " ".join(rng.choice([f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)], n)) + "."


def folder(spark, path, rows, labels=(), items=()):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    assert df.columns[:2] == ["doc_id", "text"] and ROW_KEY not in df.columns
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def shares(a, b, n=5):
    """100 * shared >= 80 * union of the sets of five-word shingles."""
    one, two = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return 100 * len(one & two) >= 80 * len(one | two)


def groups_of(rows):
    """Groups of rows that are linked, or of repeated rows; rows without words link with nothing."""
    rows, groups = list(rows), []
    for r in rows:
        linked = [g for g in groups if any(r == q or (r[1] or "").split() and (q[1] or "").split() and shares(r[1], q[1]) for q in g)]
        groups = [g for g in groups if g not in linked] + [[r] + [q for g in linked for q in g]]
    return groups


def test_row_keys(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "b"), (3, None), (3, ""), (None, "a"), (None, "a"), (None, None)]
    keyed = row_keys(frame(spark, rows)).select("doc_id", "text", ROW_KEY).collect()
    assert len(keyed) == len(rows)
    keys = collections.defaultdict(set)
    for i, t, k in keyed:
        keys[(i, t or "")].add(k)
    assert all(len(k) == 1 for k in keys.values())
    assert len({k for ks in keys.values() for k in ks}) == len(keys)
    assert keys[(1, "a")] == {1} and keys[(2, "a")] == {2} and all(k < 0 for k in keys[(3, "a")] | keys[(None, "a")])
    assert row_keys(frame(spark, [])).count() == 0


def test_rules_stage_judges_rows_and_not_ids(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = [said(rng, 40) for _ in range(4)]
    rows = [(1, long[0]), (1, "too short"), (None, long[1]), (None, "short too"), (2, None), (3, ""), (4, long[2]), (4, long[2])]
    rows += [(5, " ".join(["eight words that come again and again here"] * 5)), (6, long[3])]
    path = folder(spark, tmp_path, rows)

    def fails(text):
        w = (text or "").split()
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) < 20 or 100 * len(covered) > 30 * len(w)

    got = rows_of(cp.rules(spark, frame(spark, rows), path))
    assert got == collections.Counter(r for r in rows if not fails(r[1]))
    assert rows_of(cp.rules(spark, frame(spark, []), path)) == {}


def test_near_copies_stage_keeps_one_row_of_each_group(spark, tmp_path):
    rng = np.random.default_rng(2)
    one, two, three, four = (said(rng, 80) for _ in range(4))
    near = " ".join([*one.split()[:-2], "other", "end"])
    rows = [(1, one), (2, near), (3, two), (3, three), (3, three), (None, four), (None, four + " more"), (8, four)]
    rows += [(9, None), (9, None), (10, ""), (11, "few words"), (12, "few words"), (13, three)]
    got = rows_of(cp.near_copies(spark, frame(spark, rows), folder(spark, tmp_path, rows)))
    for group in groups_of(rows):
        assert sum(got[r] for r in set(group)) == 1, group
    assert got[(1, one)] == 1 and got[(3, two)] == 1
    assert rows_of(cp.near_copies(spark, frame(spark, []), str(tmp_path))) == {}


def test_decontamination_stage(spark, tmp_path):
    rng = np.random.default_rng(3)
    clean, leak = said(rng, 60), said(rng, 30) + " " + ITEM + " " + said(rng, 30)
    short = said(rng, 30) + " Grey  heron, twice! " + said(rng, 30)
    rows = [(1, clean), (1, leak), (None, leak), (None, clean), (2, short), (3, "heron grey twice " + clean), (4, None)]
    path = folder(spark, tmp_path, rows, items=[(1, ITEM), (2, "grey heron twice"), (3, "?!"), (4, None)])
    got = rows_of(cp.decontamination(spark, frame(spark, rows), path))
    assert got == collections.Counter(r for r in rows if r[1] not in (leak, short))
    assert rows_of(cp.decontamination(spark, frame(spark, []), path)) == {}


def test_run(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, said(rng, 60 + i)) for i in range(40)]
    bad = [(100 + i, " ".join(["#$%", "&&*"] * (20 + i)) + said(rng, 12)) for i in range(40)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, None, None), (None, 1, 0), (777, 0, 0)]
    # of one id a good and a bad text, a near copy, a test item, a text without an id, one that is too short
    more = [(200, said(rng, 70)), (200, bad[3][1]), (201, good[30][1] + " end"), (202, said(rng, 40) + " " + ITEM)]
    more += [(None, said(rng, 90)), (203, "word"), (204, None), (205, said(rng, 5000))]
    path = folder(spark, tmp_path, good + bad + more, labels, [(1, ITEM)])
    docs = frame(spark, good + bad + more)
    first = rows_of(cp.quality_classifier(spark, docs, path))
    assert set(good) | {more[0], more[2], more[3], more[4]} <= set(first) and not set(first) & {*bad, more[1]}
    assert set(first) <= {*good, *more}

    kept = [r for r in [*good, *more] if r in first and r not in (more[1], more[2], more[3]) and len((r[1] or "").split()) >= 20]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, t in kept:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        expected.update((i, at // 2048, min(2048, n - at)) for at in range(0, n, 2048))
    got = cp.run(spark, path).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == expected
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]]
        assert sum(n for _, n in places) <= 2048
