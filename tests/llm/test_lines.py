"""Line de-duplication against brute force, and that deletions undo insertions."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearset.llm import line_dedup
from nearset.llm.cuckoo import CuckooFilter

SCHEMA = "doc_id bigint, text string, row string, pos string, k1 int, holder int, lines int, known int"
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "r", "p", 1, 2, 3, 4) for i, t in docs], SCHEMA)


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def expected(docs, min_docs=3, min_chars=20):
    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        me = -(1 << 63) if i is None else i
        stays = [x for x in lines if len(holders[key(x)]) < min_docs or me == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=str)


def kept(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=str)


def corpus(seed, n=60, first=0):
    rng = np.random.default_rng(seed)
    pool = [f"Common line number {i} of the corpus" for i in range(30)] + ["short line"] * 5 + [""]
    docs = []
    for i in range(first, first + n):
        lines = [f"own line {seed} {i} {j} with enough characters" for j in range(rng.integers(0, 4))]
        lines += [f"{' ' * rng.integers(0, 3)}{x.upper() if rng.random() < 0.3 else x}\r"[: None if rng.random() < 0.5 else -1]
                  for x in rng.choice(pool, rng.integers(0, 6))]
        docs.append((i, "\n".join(rng.permutation(lines)) if lines else None))
    return docs


ODD = [
    (None, "A line that rows without an id hold"),
    (None, "A line that rows without an id hold\nA line that rows without an id hold"),
    (1, "A line that rows without an id hold"),
    (2, "a line that rows without an id HOLD "),
    (3, "\t a line that rows without an id HOLD \v"),
    (3, "another text of this id\na line that rows without an id hold\n"),
    (3, "another text of this id\na line that rows without an id hold\n"),
    (4, "\n\n\n"),
    (5, ""),
    (6, None),
    (7, "ä" * 19 + "\n" + "ä" * 20),
    (8, "Ä" * 20 + "\n" + "ä" * 20),
    (-9, "ä" * 20 + "\n" + "ä" * 19),
    (10, "ä" * 20),
    (11, "x y " * 50000 + "\n" + "many lines of a very long text\n" * 3000),
    (12, "many lines of a very long text\n\nmany lines of a very long text"),
    (13, "Many lines of a very long text"),
]


@pytest.mark.parametrize("hot", [1 << 20, 1024, 2])
def test_kept_lines_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    docs = corpus(1) + ODD
    df = frame(spark, docs)
    index = line_dedup.insert(line_dedup.empty_index(spark), df)
    assert kept(line_dedup.kept_lines(df, index)) == expected(docs)


def test_other_bounds(spark):
    docs = corpus(2)
    df = frame(spark, docs)
    index = line_dedup.insert(line_dedup.empty_index(spark, shards=5, min_chars=8), df)
    assert kept(line_dedup.kept_lines(df, index, min_docs=2)) == expected(docs, 2, 8)


def test_insertions_and_deletions_in_batches(spark):
    """Whatever the batches, the index says what one insertion of the documents that are left would say."""
    first, second, third = corpus(3), corpus(4, first=40), corpus(5, 30, first=200)
    index = line_dedup.insert(line_dedup.empty_index(spark, shards=3), frame(spark, first))
    index = line_dedup.insert(index, frame(spark, second + ODD))
    docs = first + second + ODD
    assert kept(line_dedup.kept_lines(frame(spark, docs), index)) == expected(docs)
    # repeated insertions count once
    index = line_dedup.insert(index, frame(spark, second[:20]))
    assert kept(line_dedup.kept_lines(frame(spark, docs), index)) == expected(docs)
    # the largest holders of many lines go, among others, and rows without an id
    gone = {*range(50, 100), 3, 999, None}
    ids = spark.createDataFrame([(i,) for i in [*gone, 60]], "doc_id bigint")
    index = line_dedup.insert(line_dedup.delete(index, ids), frame(spark, third))
    docs = [d for d in docs if d[0] not in gone] + third
    assert kept(line_dedup.kept_lines(frame(spark, docs), index)) == expected(docs)
    # filters: every referenced key is found, and one entry for each is left
    keys = {(r["k1"], r["k2"]) for r in index.lines.select("k1", "k2").distinct().collect()}
    filters = {r["shard"]: CuckooFilter.from_bytes(bytes(r["prints"]), r["buckets"]) for r in index.filters.collect()}
    assert all(filters[k1 % 3].contains(np.array([k2]).view(np.uint64))[0] for k1, k2 in keys)
    entries = sum(int((f.table > 0).sum()) for f in filters.values())
    assert 0.99 * len(keys) <= entries <= len(keys)


def test_a_deletion_undoes_an_insertion(spark):
    first, second = corpus(6), corpus(7, first=30)
    before = line_dedup.insert(line_dedup.empty_index(spark), frame(spark, first))
    after = line_dedup.insert(before, frame(spark, [(i + 1000, t) for i, t in second]))
    back = line_dedup.delete(after, spark.createDataFrame([(i + 1000,) for i, _ in second], "doc_id bigint"))
    assert kept(line_dedup.kept_lines(frame(spark, first), back)) == expected(first)
    state = lambda index: {
        tuple(r) for r in line_dedup._counts(index).where("docs > 0").select("k1", "k2", "docs", "lines", "last").collect()
    }
    assert state(back) == state(before)


def test_odd_tables(spark):
    none = frame(spark, [])
    index = line_dedup.insert(line_dedup.empty_index(spark), none)
    assert line_dedup.kept_lines(none, index).count() == 0
    assert line_dedup.delete(line_dedup.empty_index(spark), none).version == 0
    blank = [(1, None), (2, ""), (None, None)]
    index = line_dedup.insert(index, frame(spark, blank))
    assert kept(line_dedup.kept_lines(frame(spark, blank), index)) == expected(blank)
    index = line_dedup.delete(index, spark.createDataFrame([(1,)], "doc_id bigint"))
    docs = corpus(8, 10)
    index = line_dedup.insert(index, frame(spark, docs))
    assert kept(line_dedup.kept_lines(frame(spark, docs), index)) == expected(docs)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=400), st.data())
def test_cuckoo_filters_never_lose_a_key(keys, data):
    keys = np.array(keys, np.uint64)
    shard = CuckooFilter.sized(data.draw(st.integers(0, 100)))  # too small for all keys: buckets get more slots
    shard.add(keys)
    assert shard.contains(keys).all()
    gone = np.array(data.draw(st.lists(st.booleans(), min_size=len(keys), max_size=len(keys))), bool)
    shard.remove(keys[gone])
    assert shard.contains(keys[~gone]).all()
    assert (shard.table > 0).sum() == (~gone).sum()
    again = CuckooFilter.from_bytes(shard.to_bytes(), len(shard.table))
    assert (again.table == shard.table).all()


def test_a_cuckoo_filter_takes_equal_keys_and_refuses_strangers():
    keys = np.array([5] * 20, np.uint64)
    shard = CuckooFilter.sized(1)
    shard.add(keys)
    shard.remove(keys)
    assert not shard.contains(keys[:1])[0]
    with pytest.raises(KeyError):
        shard.remove(keys[:1])
