"""The prefix trie of conversations against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from nearset.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, words int, path string, i int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA)


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(paths):
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    rows = {}
    for node, convs in sorted(members.items(), key=lambda x: -len(x[0])):
        below = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        leaves = sum(rows[n][0] for n in below) or 1
        saved = sum(rows[n][1] for n in below) + (len(convs) - 1) * words(node)
        rows[node] = leaves, saved, len(below)
    return {
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), rows[node][2], *rows[node][:2],
            hashlib.sha256(",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node)))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    }


def got(spark, rows):
    turns = prefix_trie.numbered_turns(frame(spark, rows))
    return {tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns)).select(*COLUMNS).collect()}


def corpus(seed, n=70):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(n):
        for turn in range(rng.integers(1, 10)):
            text = str(rng.choice(["hello there", "go  on\tplease", "", "yes"], p=[0.5, 0.2, 0.1, 0.2]))
            rows.append((int(c), turn, "user" if turn % 2 == 0 else "assistant", text))
    return rows


def test_nodes_are_those_of_brute_force(spark):
    rows = [r for r in corpus(1) if r[0] != 40]
    # absent first conversation of a block, short ones, ties, repeated rows, nulls, one very deep conversation
    rows += [(45, None, None, None), (45, None, "user", None), (46, 3, "user", "x y"), (46, 3, "user", "x y"), (46, 3, "user", "a")]
    rows += [(None, 1, "user", "lost"), (-7, 0, "user", "hello there"), (-13, 0, "user", "word " * 50000)]
    rows += [(61, t, "user", f"turn {t % 3}") for t in range(100, 230)]
    assert got(spark, rows) == trie(sequences(rows))


def test_copies_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 400, 20) for t in range(5)]
    rows += [(c, 0, "user", "alone") for c in range(1001, 1012)]  # no conversation 1000: many are left without a turn
    assert got(spark, rows) == trie(sequences(rows))


def test_long_lists_of_ends_and_long_paths_are_cut(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = corpus(2, 40) + [(61, t, "user", "same") for t in range(40)] + [(80, t, "user", "same") for t in range(37)]
    assert got(spark, rows) == trie(sequences(rows))


def test_no_conversation_is_no_node(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, 0, "user", "x")]) == set()


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 7, 8, 9])
def test_any_depth(spark, length):
    """Paths and ends may be given as they are; the span is no power of two."""
    paths = [(c, d, 7 * d + (c if d > 2 else 0), d, 1) for c in (1, 2) for d in range(1, length + 1)]
    paths = spark.createDataFrame(paths, "conv_id bigint, depth bigint, t1 bigint, t2 bigint, words bigint")
    ends = spark.createDataFrame([(1, length), (2, length), (3, 0)], "conv_id bigint, length bigint")
    nodes = prefix_trie.prefix_trie(paths, ends).collect()
    top = next(r for r in nodes if r["depth"] == 0)
    assert len(nodes) == 1 + min(length, 2) + 2 * max(0, length - 2)
    assert (top["conv_id"], top["n_convs"], top["n_leaves"]) == (1, 3, 2 if length > 2 else 1)
    assert top["saved_tokens"] == min(length, 2)
