"""Spelling variants against brute force: the index, the groups and blocks, the words and the chains."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearset.llm import spelling
from nearset.runtime import write_once

SCHEMA = "doc_id bigint, text string, word string, n int, near string, form int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abÿ", min_size=1, max_size=5), min_size=1, max_size=150), st.lists(st.text("abcÿ", min_size=1, max_size=6)))
def test_the_index_finds_words_with_one_difference(words, queries):
    words = sorted(words)
    i, j = spelling.PositionIndex(words).near(queries)
    wanted = [(a, b) for a, q in enumerate(queries) for b, w in enumerate(words) if near(q, w)]
    assert sorted(zip(i.tolist(), j.tolist())) == wanted


def expected(docs, min_chars=5, min_count=3):
    counts = collections.Counter()
    for doc_id, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def forms(counts):
    out = {}
    for word, n in counts.items():
        close = sorted((-counts[w], w) for w in counts if near(word, w))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[word] = (form, n, len(close), counts[form] if form else None)
    rows = set()
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n, n_near, form_n))
    return rows


def collected(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("aeiourstÀé"), rng.integers(4, 11))) for _ in range(40)]
    docs = []
    for i in range(n):
        words = []
        for w in rng.choice(base, 60):
            if rng.random() < 0.3:
                at = int(rng.integers(len(w)))
                w = [w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]][rng.integers(3)]
            words.append(w.title() if rng.random() < 0.2 else w)
        docs.append((i - 5, " ".join(words)))
    return docs


@pytest.mark.parametrize(("group", "block"), [(1024, 8192), (64, 8), (1 << 20, 50)])
def test_forms_are_those_of_brute_force(spark, group, block):
    docs = corpus(group)
    docs += [(7, None), (8, ""), (None, "null null null nulll nulll"), (9, "--- 日本語 ퟿ ÷÷÷÷÷ ×××××"), (9, "twice Twice TWICE twine")]
    docs += [(10, "a" * 300 + " " + "a" * 299 + "b"), (11, ("a" * 300 + " ") * 7 + ("a" * 299 + "b ") * 2 + "a" * 128 + " " + "a" * 129)] * 3
    df = spark.createDataFrame([(i, t, "w", 1, "x", 2) for i, t in docs], SCHEMA)
    words = spelling.vocabulary(df)
    assert {r["word"]: r["n"] for r in words.collect()} == expected(docs)
    assert collected(spelling.spelling_forms(words, group=group, block=block)) == forms(expected(docs))


def test_counts_that_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 5)
    docs = corpus(3, 20)
    df = spark.createDataFrame([(i, t, "w", 1, "x", 2) for i, t in docs], SCHEMA)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == expected(docs)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling.spelling_forms(words)
    assert collected(got) == forms(counts)
    rows = {r["word"]: r for r in got.collect()}
    assert rows["aaaaa"]["root"] == "bbbbb" and rows["zzzzz"]["form"] == "zzzzx"


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_forms(spelling.vocabulary(none)).count() == 0
    blank = spark.createDataFrame([(1, None, "w", 1, "x", 2), (2, "", "w", 1, "x", 2)], SCHEMA)
    assert spelling.vocabulary(blank).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_forms(none.select("word", "n"), times=1)


def test_a_large_group_is_cut_into_blocks(spark):
    """Words with one common first half: each block pair is a row of its own and no link is lost."""
    rng = np.random.default_rng(5)
    words = sorted({"hotfirsthalf" + "".join(rng.choice(list("abc"), 9)) for _ in range(600)})
    table = write_once(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"), "words")
    got = {(r["word"], r["near"]) for r in spelling.near_words(table, block=100).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
