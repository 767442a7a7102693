"""Operators on documents against brute force, with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from nearset.llm import chat, decontaminate, gbdt, maxent, minhash, packing, rules, token_counts, token_files, toxicity
from nearset.llm.common import remainder
from nearset.llm.encode import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# columns whose names the operators use themselves
SCHEMA = "doc_id bigint, text string, node bigint, n int, bands string, part int, rank int, x string, train int"
PLAIN = [
    "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine ten",
    "One Two three four five six seven eight nine TEN",
    "alpha beta gamma delta",
    "ÄB äb x",
    "two words",
    "word",
    "",
    " \n\t ",
    None,
    "it's 'tis  a\n\ntest, 日本語 <|endoftext|> ### </turn> \\",
    "a.\nb, c.\n" + "long tail of words " * 4000,
]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, 1, 2, "b", 3, 4, "x", 5) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, PLAIN)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def with_odd_ids(spark):
    return frame(spark, [PLAIN[0], PLAIN[0], PLAIN[3], PLAIN[3], None], [7, 7, None, 9, None])


# --- near duplicates ---------------------------------------------------------


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label))]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates_are_those_of_brute_force(spark, k, percent, block):
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):  # chains and stars of edited copies around a few bases
        base = list(rng.choice(words, 60))
        for _ in range(14):
            copy = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
            if rng.random() < 0.5:
                base = copy
    texts += PLAIN
    got = minhash.near_duplicates(frame(spark, texts), words=k, percent=percent, block=block).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(texts, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(with_odd_ids(spark)).collect()
    key = lambda r: (r[0] is not None, r)
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=lambda r: (r[0] or -1, r[1] or -1))
    assert rows == [(None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 9, True)], key


def test_an_id_with_two_texts_links_both(spark):
    texts = [PLAIN[0], PLAIN[3], PLAIN[0], PLAIN[3]]
    got = minhash.near_duplicates(frame(spark, texts, [1, 1, 2, 3])).collect()
    assert {r["component_id"] for r in got} == {1}


# --- quality rules ------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


def test_text_statistics(spark, empty):
    texts = [*PLAIN, "a b c d e f g h " * 3, "x\nx\n\n y\nx", "a a a a a a a a a a", "#*$ |x| <b> 𝄞𝄞 é"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rules.text_statistics(frame(spark, texts)).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}
    assert rules.text_statistics(empty).count() == 0
    assert rules.text_statistics(with_odd_ids(spark)).count() == 5


def test_rules_are_learned_and_need_labels(spark, empty):
    rng = np.random.default_rng(1)
    words = lambda: [f"w{i}" for i in rng.integers(0, 5000, 40)]
    good = [" ".join(words()) for _ in range(90)]
    bad = [" ".join(f"{w}***" for w in words()) for _ in range(45)] + [" ".join(words()).upper() for _ in range(45)]
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(180)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    judged, learned = rules.quality_rules(frame(spark, good + bad), labels)
    got = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert learned and sum(got[i] for i in range(90)) >= 88 and sum(got[i] for i in range(90, 180)) <= 4
    judged, learned = rules.quality_rules(frame(spark, good), labels.limit(0))
    assert not learned and judged.where("kept").count() == 90
    assert rules.quality_rules(empty, labels)[0].count() == 0


def test_rules_use_no_python(spark, docs):
    plan = rules.text_statistics(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- language model -----------------------------------------------------------


def test_language_scores(spark, empty):
    texts = [*PLAIN, *[f"the cat number {i} sat on the mat" for i in range(60)]]
    train = remainder(F.col("doc_id"), 7) != 2
    got = {r["doc_id"]: r for r in maxent.language_scores(frame(spark, texts), train).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    learned = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in learned for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 1e-6
    assert maxent.language_scores(empty, train).count() == 0
    nothing = maxent.language_scores(frame(spark, texts[:3]), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)
    assert maxent.language_scores(with_odd_ids(spark), train).count() == 5


def test_probabilities_of_a_context_sum_to_one():
    counts = {"a": 40.0, "b": 25.0}
    totals = np.zeros(maxent.TAIL_CLASSES)
    tail = {"c": 3, "d": 2, "e": 1, "f": 1}
    for k in tail.values():
        totals[maxent.tail_class(np.array([k]))[0]] += k
    corpus = maxent.Corpus(90, 7, 10, {"a": 1, "b": 2}, np.array([10.0, *counts.values()]), totals)
    weights = maxent.Weights(corpus)
    rng = np.random.default_rng(0)
    weights.classes += rng.normal(0, 1, weights.classes.shape).astype(np.float32)
    weights.members += rng.normal(0, 1, weights.members.shape).astype(np.float32)
    vocabulary = ["a", "b", *tail, "unseen"]
    total = 0.0
    for w in [*vocabulary, None]:
        said = ["a", "c"] + ([w] if w else [])
        words = list(dict.fromkeys(said))
        ids = np.array([words.index(x) for x in said])
        found = np.array([int(counts.get(x, 0)) or tail.get(x, 0) for x in words])
        heads = np.array([corpus.head.get(x, -1) for x in words])
        t = maxent.Tokens(corpus, np.array([len(said)]), ids, found, heads)
        total += 10 ** maxent.run_tokens(corpus, weights.classes, weights.members, t, None)[2]
    # classes that hold no word keep what the softmax gives them
    empty_classes = np.flatnonzero(totals == 0)
    rest = maxent._log_softmax(
        (weights.classes[0] + sum(weights.classes[maxent._rows(f[2:3], maxent.CLASS_ROWS)[0]] for f in t.features))[None]
    )[0]
    lost = np.exp(rest[len(corpus.bounds) - 1 :][empty_classes[empty_classes > 0]]).sum()
    assert total + lost == pytest.approx(1, abs=1e-4)


def test_every_word_is_modelled_in_context(spark):
    rng = np.random.default_rng(2)
    pairs = [(f"left{i}", f"right{i}") for i in range(300)]
    texts = [" ".join(x for i in rng.permutation(300)[:200] for x in pairs[i]) for _ in range(40)]
    # each word as often as before, but after another one
    told = [" ".join(f"left{i} right{i}" for i in range(100, 200)), " ".join(f"left{i} right{299 - i}" for i in range(100, 200))]
    filler = " ".join(["the of and to in"] * 20_000)  # so that no pair is of frequent words
    got = {r["doc_id"]: r for r in maxent.language_scores(frame(spark, [*texts, filler, *told]), F.col("doc_id") <= 40).collect()}
    one, other = got[41], got[42]
    assert one["base_score"] == pytest.approx(other["base_score"])
    assert one["score"] > other["score"] + 20


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 1000)  # some shards, and contexts in several
    monkeypatch.setattr(maxent, "SPREAD_TOKENS", 100)
    monkeypatch.setattr(maxent, "GROUP_TOKENS", 2000)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[i] for i in rng.zipf(1.3, n) % 300) for n in rng.integers(0, 90, 150)]
    docs = frame(spark, [*texts, None, "", texts[0]])
    docs = docs.unionByName(docs.where("doc_id < 5"))
    train = F.col("doc_id") % 4 != 1
    parted = [docs.coalesce(1), docs.repartition(6, "text"), docs.orderBy(F.desc("doc_id"))]
    scores = [sorted((r["doc_id"], r["score"]) for r in maxent.language_scores(d, train).collect()) for d in parted]
    for other in scores[1:]:
        assert [i for i, _ in other] == [i for i, _ in scores[0]]
        assert [x for _, x in other] == pytest.approx([x for _, x in scores[0]], abs=1e-6)


def test_tokens_reach_their_shards_whole():
    counts = {"a": 40, "b": 25}
    tail = {"c": 3, "d": 2, "e": 1, "f": 4}
    tails, n = np.unique(list(tail.values()), return_counts=True)
    totals = np.bincount(maxent.tail_class(tails), tails * n).astype(float)
    corpus = maxent.Corpus(5 << 20, 7, 10, {"a": 1, "b": 2}, np.array([10.0, 40, 25]), totals, tails, n)
    words = ["a", "b", *tail, "unseen"]
    said = [["a", "c", "d", "b", "e"], [], ["unseen", "f", "a", "a", "f", "c"], ["d"]]
    row = {
        "chunk": 3, "train": [True, False, True, False], "marks": np.array([9, -4, 2, 2], np.int32),
        "n_words": np.array([len(x) for x in said]), "ids": np.array([words.index(w) for x in said for w in x]),
        "counts": np.array([counts.get(w, tail.get(w, 0)) for w in words]), "places": np.array([0, 0, 2, 1, 0, 3, 0]),
        "keys": np.arange(101, 108, dtype=np.int32), "heads": np.array([corpus.head.get(w, -1) for w in words]),
    }
    batch = pa.Table.from_batches(list(maxent._blocks(corpus, row)))
    got = collections.Counter()
    for shard in set(batch.column("shard").to_pylist()):
        docs, t = maxent.shard_tokens(corpus, batch.filter(pc.equal(batch.column("shard"), shard)))
        names = ("target", "place", "one", "two", "one_key", "two_key", "flags")
        got.update(zip(docs.tolist(), *(t[x].tolist() for x in names)))
    want, classes = collections.Counter(), {w: int(maxent.tail_class(np.array([c]))[0]) for w, c in (tail | {"unseen": 0}).items()}
    lower = lambda w: w in ("d", "e", "f")
    place = dict(zip(words, row["places"].tolist()))
    own = lambda w: (classes[w] + 3, 101 + words.index(w) if w in tail else 0) if w in classes else (corpus.head.get(w, 0),) * 2
    for d, text in enumerate(said):
        past = [None, None]
        for w in [*text, None]:
            target = 1 + classes[w] if w in classes else 0
            (one, one_key), (two, two_key) = own(past[-1]), own(past[-2])
            flags = lower(w) + 2 * lower(past[-1]) + 4 * lower(past[-2]) + 8 * row["train"][d]
            want[(3 << 24) + d, target, corpus.head.get(w, place.get(w, 0)), one, two, one_key, two_key, flags] += 1
            past.append(w)
    assert got == want


def test_shards_and_their_rows_grow_with_the_corpus():
    sized = [maxent.Corpus(n, 7, 10, {}, np.array([10.0]), np.array([0.0])).shards for n in (10, 10**7, 10**9)]
    assert sized[0] == 1 and sized[2] > 90 * sized[1] > 500


def test_probabilities_of_all_words_in_a_shard_sum_to_one():
    counts = np.repeat([1, 2, 3, 5, 6], [300, 40, 17, 16, 1])
    tails, words = np.unique(counts, return_counts=True)
    totals = np.bincount(maxent.tail_class(counts), counts).astype(float)
    corpus = maxent.Corpus(900, 400, 10, {"a": 1, "b": 2}, np.array([10.0, 40, 25]), totals, tails, words)
    rng = np.random.default_rng(0)
    common = maxent.Weights(corpus)
    common.members += rng.normal(0, 1, common.members.shape).astype(np.float32)
    tables = [rng.normal(0, 1, n).astype(np.float32) for n in ((maxent.SHARD_CLASS_ROWS, 1 + len(totals)), (maxent.SHARD_NODE_ROWS, maxent.FAN))]
    # every word in one context: frequent ones, all others, and unseen ones as one
    place = np.concatenate([np.arange(3), np.arange(len(counts)), [0]])
    target = np.concatenate([[0] * 3, 1 + maxent.tail_class(counts), [1]])
    same = {name: np.full(len(place), 5) for name in ("one", "two", "one_key", "two_key")}
    t = same | {"place": place, "target": target, "flags": np.zeros(len(place), np.uint8)}
    p = 10 ** maxent.run_shard(corpus, common, tables, t, None)
    assert p.sum() == pytest.approx(1, abs=1e-4)
    # without weights of their own, words of a class share it by their counts
    p = 10 ** maxent.run_shard(corpus, common, [0 * x for x in tables], t, None)[3:-1]
    for k in np.unique(maxent.tail_class(counts)):
        own = maxent.tail_class(counts) == k
        assert p[own] / p[own].sum() == pytest.approx(counts[own] / totals[k], rel=1e-3)


# --- decontamination ----------------------------------------------------------


def test_contaminated_documents(spark, empty):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(900)]
    said = lambda n: " ".join(rng.choice(words, n))
    items = [said(30) + ". " + said(8) + "." for _ in range(40)] + [said(200) + ". " + said(5)]
    clean = [said(300) for _ in range(30)]
    leaks = [said(150) + " " + t.upper().replace(".", " !") + " " + said(90) for t in items]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short")], "item_id bigint, text string")
    for shard in (4096, 7):
        got = decontaminate.contaminated(frame(spark, clean + leaks + [None, ""]), bench, shard_items=shard)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(30 + i, i) for i in range(len(items))]
    assert decontaminate.clean_documents(frame(spark, clean + leaks), bench).count() == 30
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, leaks), bench.limit(0)).count() == 0


def test_edited_and_cut_items_are_found(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(900)]
    said = lambda n: list(rng.choice(words, n))
    # with last sentences of one word, of a few, of many, and none
    items = [" ".join(said(24)) + end for end in (". X.", ". It is.", ". " + " ".join(said(12)) + ".", "")]

    def edits(item):
        given = item.split()
        changed = [*given[:-1], "other."]
        middle = [*given[:9], "other", *given[10:]]
        return [given, changed, middle, given[:-1], given[: -(len(given) // 10 or 1)], given[:24]]

    leaks = [(i, " ".join([*said(60), *e, *said(40)])) for i, item in enumerate(items) for e in edits(item)]
    # the words of an item in another order are not the item
    clean = [" ".join(said(60) + list(rng.permutation(item.split())) + said(60)) for item in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.contaminated(frame(spark, clean + [t for _, t in leaks]), bench)
    found = sorted((r["doc_id"], r["item_id"]) for r in got.collect())
    assert found == [(len(clean) + d, i) for d, (i, _) in enumerate(leaks)]


def test_search_finds_all_above_the_threshold():
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(120)]
    index = decontaminate.Index([(i, " ".join(rng.choice(words, 20))) for i in range(60)])
    documents = [list(rng.choice(words, n)) for n in (0, 5, 47, 48, 49, 200, 96)]
    expected = set()
    for d, said in enumerate(documents):
        for at in range(0, max(len(said), 1), decontaminate.PIECE):
            terms = {index.terms[w] for w in said[at : at + 2 * decontaminate.PIECE] if w in index.terms}
            score = np.zeros(index.n_pieces)
            for t in terms:
                span = slice(index.start[t], index.start[t + 1])
                score[index.piece[span]] += index.score[span]
            expected |= {(d, int(p)) for p in np.flatnonzero(score >= 0.4)}
    found = index.search(documents, 0.4)
    assert expected and {(d, p) for d, p, _ in found} == expected


# --- tokens -------------------------------------------------------------------

TEXTS = [*[t or "" for t in PLAIN], " lead", "trail ", "a b", "İstanbul É", "x\x1cy", "I'LL we're", "tab\there"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_gives_the_ids_of_the_library(path):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    ids, counts = Encoder(path).encode(TEXTS, 0)
    expected = [library.encode(t, add_special_tokens=False).ids + [0] for t in TEXTS]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_queries_have_the_ids_of_the_plain_library_call(spark, tmp_path):
    from nearset.llm import queries

    texts = ["a <|endoftext|> b", "c<|startoftext|>D", "x <|ENDOFTEXT|>  y <|StartOfText|>", "none"]
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    plain = [[x.ids for x in Tokenizer.from_file(p).encode_batch(texts, add_special_tokens=False)] for p in (BYTES, WORDS)]
    files = {r["doc_id"]: r for r in queries.op5_token_files(spark, str(tmp_path)).collect()}
    assert [files[i]["n_tokens"] for i in range(4)] == [len(x) + 1 for x in plain[0]]
    lengths = collections.Counter(len(x) for x in plain[0])
    got = {r["length"]: r["n_docs"] for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    assert got == lengths or got == {k + 1: v for k, v in lengths.items()}
    pieces = {r["doc_id"]: r for r in queries.op9_packing(spark, str(tmp_path)).collect()}
    assert [pieces[i]["ids_crc32"] for i in range(4)] == [
        zlib.crc32(np.array([*x, 0], "<u4")) for x in plain[1]
    ]


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, tmp_path, encoding):
    path = f"{tmp_path}/{encoding}"
    token_files.write_tokens(docs, path, BYTES, encoding=encoding)
    got = {r["doc_id"]: r for r in token_files.token_starts(token_files.read_tokens(spark, path)).collect()}
    ids, counts = Encoder(BYTES).encode([t or "" for t in PLAIN], 0)
    start = 0
    for i, n in enumerate(counts.tolist()):
        own = ids[start : start + n].astype("<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, n, zlib.crc32(own.tobytes()))
        start += n
    import pyarrow.parquet as pq

    parts = [f for f in (tmp_path / encoding).iterdir() if f.suffix == ".parquet"]
    columns = [pq.ParquetFile(f).metadata.row_group(0) for f in parts]
    tokens = [c.column(j) for c in columns for j in range(c.num_columns) if "tokens.list" in c.column(j).path_in_schema]
    wanted = "DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY"
    assert tokens and all(wanted in t.encodings and t.has_offset_index for t in tokens)
    plan = token_files.read_tokens(spark, path, "doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]


def test_token_files_of_odd_rows(spark, empty, tmp_path):
    token_files.write_tokens(empty, f"{tmp_path}/empty", BYTES)
    assert token_files.token_starts(token_files.read_tokens(spark, f"{tmp_path}/empty")).count() == 0
    token_files.write_tokens(with_odd_ids(spark), f"{tmp_path}/odd", BYTES)
    rows = token_files.token_starts(token_files.read_tokens(spark, f"{tmp_path}/odd")).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 7, 7, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_token_counts(spark, docs, empty):
    totals = token_counts.length_totals(token_counts.length_histogram(token_counts.encoded_lengths(docs, BYTES)))
    _, n = Encoder(BYTES).encode([t or "" for t in PLAIN], 0)
    got = {r["length"]: r for r in totals.collect()}
    assert sorted(got) == sorted(set(n.tolist()))
    for k, r in got.items():
        assert (r["n_docs"], r["docs_longer"], r["docs_up_to"]) == ((n == k).sum(), (n > k).sum(), (n <= k).sum())
        assert (r["tokens_up_to"], r["tokens_truncated"]) == (n[n <= k].sum(), np.minimum(n, k).sum())
    for limit in (0, 1, 7, 50, 10**6):
        r = token_counts.truncated_total(totals, limit).first()
        assert (r["tokens"], r["docs_cut"]) == (np.minimum(n, limit).sum(), (n > limit).sum())
    assert token_counts.quantile(totals, 0.5).first()["length"] == np.sort(n)[(len(n) + 1) // 2 - 1]
    none = token_counts.length_totals(token_counts.length_histogram(token_counts.encoded_lengths(empty, BYTES)))
    assert none.count() == 0


# --- packing ------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 100, 2048]))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 3000)))
    if seed % 2:
        lengths = np.minimum(1 + rng.geometric(8 / capacity, len(lengths)), capacity)
    counts = collections.Counter(lengths.tolist())
    runs, n = packing.plan(counts, capacity)
    fill, placed = collections.Counter(), collections.defaultdict(list)
    for length, first, pieces, sequence, each in runs:
        for r in range(pieces):
            fill[sequence + r // each] += length
            placed[length].append(first + r)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert max(fill.values()) <= capacity and sorted(fill) == list(range(n))
    first_fit = []
    for x in sorted(lengths.tolist(), reverse=True):
        for i, room in enumerate(first_fit):
            if room >= x:
                first_fit[i] -= x
                break
        else:
            first_fit.append(capacity - x)
    assert n <= len(first_fit) * 1.03 + 2


def test_packing(spark, docs, empty):
    pieces = packing.token_pieces(docs, WORDS, 64)
    rows = packing.pack(pieces, 64, ["doc_id", "piece"]).collect()
    ids, counts = Encoder(WORDS).encode([t or "" for t in PLAIN], 0)
    starts, sequences, seen = np.cumsum(counts) - counts, collections.defaultdict(list), collections.Counter()
    for r in rows:
        own = ids[starts[r["doc_id"]] + r["start"] :][: r["length"]].astype("<u4")
        assert r["start"] == 64 * r["piece"] and r["ids_crc32"] == zlib.crc32(own.tobytes())
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == dict(enumerate(counts.tolist()))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.token_pieces(empty, WORDS, 64), 64, ["doc_id", "piece"]).count() == 0
    odd = packing.pack(packing.token_pieces(with_odd_ids(spark), WORDS, 64), 64, ["doc_id", "piece"])
    assert odd.count() == 5 and odd.select("sequence_id", "offset").distinct().count() == 5


# --- classifiers --------------------------------------------------------------


def labelled(spark, seed, spoil, name):
    rng = np.random.default_rng(seed)
    texts, marks = [], []
    for i in range(240):
        words = ["".join(rng.choice(list("aeiounrst"), 5)) for _ in range(30)]
        marks.append(int(i % 3 == 0))
        texts.append(spoil(words, rng) if marks[-1] else " ".join(words))
    labels = spark.createDataFrame([*enumerate(marks), (None, 1), (3, None)], f"doc_id bigint, {name} int")
    return frame(spark, [*texts, None, ""]), labels, marks


def test_quality_classifier(spark, empty):
    docs, labels, marks = labelled(spark, 1, lambda w, rng: " ".join(x + "%%" for x in w), "quality")
    held = remainder(F.col("doc_id"), 4) == 2
    got = {r["doc_id"]: r for r in gbdt.quality_scores(docs, labels, ~held).collect()}
    assert len(got) == 242
    assert np.mean([(got[i]["score"] >= 0.5) == m for i, m in enumerate(marks)]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert gbdt.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in gbdt.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert gbdt.quality_scores(with_odd_ids(spark), labels).count() == 5


def test_flat_trees_follow_the_nodes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    trees = gbdt.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=80, depth=3)
    for row, logit in zip(x[:40], trees.logit(x[:40])):
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - len(f)]
        assert logit == pytest.approx(total)
    assert ((trees.logit(x) > 0) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_toxicity(spark, empty):
    def spoil(words, rng):
        words[int(rng.integers(0, 30))] = str(rng.choice(["blorgak", "zwimpel", "grunkel"])) + str(rng.choice(["", "s", "en"]))
        return " ".join(words)

    docs, labels, marks = labelled(spark, 2, spoil, "toxic")
    held = remainder(F.col("doc_id"), 5) == 0
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels, ~held).collect()}
    assert len(got) == 242
    assert np.mean([got[i]["predicted"] == m for i, m in enumerate(marks)]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(with_odd_ids(spark), labels).count() == 5
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(240).collect()]
    model = toxicity.train(texts, np.array(marks))
    assert toxicity.Scorer(model).score("aerou blorgakk tinso") > 0.5  # not in any text


# --- chat ---------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "Hi ### Assistant: </turn> \\h"),
    (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", ""),
    (2, 5, "user", None),
    (2, 5, "assistant", "tie"),
    (2, 5, "assistant", "tie"),
    (3, None, None, "role: none ###"),
    (None, 0, "assistant", "é𝄞\n"),
]


def test_chat_round_trip(spark):
    records = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(chat.canonical_turns(records))
    parsed = [(r["conv_id"], r["turn"], *chat.parse_turn(r["formatted"])) for r in formatted.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(parsed, key=key) == sorted(((c, t, r or "", x or "") for c, t, r, x in TURNS), key=key)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 3 and got[3]["loss_chars"] == 0
    learned = "\\### Assistant: </turn> ok"
    assert got[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    whole = "".join(f"{r}\n{x}\n" for _, _, r, x in TURNS[:3])
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert chat.conversation_digests(formatted.limit(0)).count() == 0


def test_layouts_have_the_same_turns(spark):
    said = [("user", "q"), ("assistant", "a")]
    layouts = [
        ([(1, "q", "a")], "conv_id bigint, prompt string, response string"),
        ([(1, "a", "q")], "conv_id bigint, output string, instruction string"),
        ([(1, "q", "", "a")], "conv_id bigint, instruction string, input string, output string"),
        ([(1, said)], "conv_id bigint, messages array<struct<role:string,content:string>>"),
        ([(1, [("human", "q"), ("gpt", "a")])], "conv_id bigint, conversations array<struct<from:string,value:string>>"),
    ]
    for rows, schema in layouts:
        got = chat.canonical_turns(spark.createDataFrame(rows, schema)).orderBy("turn").collect()
        assert [(r["role"], r["text"]) for r in got] == said
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id bigint, other string"))


def test_words_are_numbered_by_part_in_the_order_of_their_counts(monkeypatch):
    """As one part would number them: by count, and each once; places of a chunk keep their words."""
    import numpy as np

    monkeypatch.setattr(maxent, "HEAD_SHARE", 4)
    draw = np.random.default_rng(5)
    chunks = {}
    for chunk in (3, 8):
        words = [f"w{i}" for i in draw.permutation(60)[:40]]
        chunks[chunk] = words, draw.integers(0, 4, 40) + 900 * np.array([w == "w7" for w in words])
    chunks[8] = ["w7", *(w for w in chunks[8][0] if w != "w7")], chunks[8][1] + 1
    total = collections.Counter()
    for words, seen in chunks.values():
        total.update(dict(zip(words, seen.tolist())))
    tokens = sum(total.values())
    lists = [[c for c in chunks], [w for w, _ in chunks.values()], [s.tolist() for _, s in chunks.values()]]
    kinds = pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(lists, kinds)], ["chunk", "words", "seen"])
    dealt = pa.Table.from_batches(list(maxent._words_by_part(3, [batch])))
    parts = [maxent._counted(dealt.filter(pc.equal(dealt.column("part"), p))) for p in range(3)]
    head = {w: i for i, (c, w) in enumerate(sorted((-c, w) for w, c in total.items() if c * 4 >= tokens), 1)}
    assert head and len(parts) == 3
    runs = sorted((c, p, n) for p, t in enumerate(parts) for c, n in zip(t["counts"][0].as_py(), t["n"][0].as_py()) if c * 4 < tokens)
    got, first = {}, maxent.FIRST_TAIL
    before = {}
    for c, p, n in runs:
        before.setdefault(p, []).append(first)
        first += n
    for p, t in enumerate(parts):
        row = t.append_column("before", pa.array([before.get(p)], pa.list_(pa.int64()))).to_batches()
        for out in maxent._numbers(head, tokens, row):
            for chunk, places, numbers in zip(*(out.column(i).to_pylist() for i in range(3))):
                for place, number in zip(maxent._unpacked(places, np.int32), maxent._unpacked(numbers, np.int64)):
                    word = chunks[chunk][0][place]
                    assert got.setdefault(word, number) == number
    assert set(got) == set(total)
    assert all(got[w] == (head[w] if w in head else 0 if not c else got[w]) for w, c in total.items())
    tail = sorted((got[w], c) for w, c in total.items() if c and w not in head)
    assert [i for i, _ in tail] == list(range(maxent.FIRST_TAIL, maxent.FIRST_TAIL + len(tail)))
    assert [c for _, c in tail] == sorted(c for _, c in tail)


def test_a_batch_of_a_shard_takes_few_numbers_a_word():
    """A word of the tail meets at most one number a weight for each doubling of its class, where a node had FAN of 16."""
    import numpy as np

    counts = np.arange(1, 6000)
    corpus = maxent.Corpus(10**6, 7, 10, {}, np.array([10.0]), np.bincount(maxent.tail_class(counts), counts), counts, np.ones(5999, int))
    paths = maxent._Paths(corpus, np.arange(5999))
    n, node, way, prior = paths.of(0, 5999)
    assert n.max() <= 12 and len(node) == n.sum() and np.isfinite(prior).all()
    # without weights a word has its share of its class
    share = np.exp(-np.bincount(np.repeat(np.arange(5999), n), np.log1p(np.exp(-prior)), 5999))
    k = maxent.tail_class(counts)
    assert share == pytest.approx(counts / corpus.tail_totals[k], rel=1e-3)


def test_tokens_travel_packed():
    import numpy as np

    draw = np.random.default_rng(3)
    for kind in (np.uint8, np.int16, np.int32, np.int64):
        for n in (0, 1, 7, 5000):
            x = draw.integers(0, 120, n).astype(kind)
            packed = maxent._packed(x)
            assert (maxent._unpacked(packed, kind) == x).all() and maxent._unpacked(packed, kind).dtype == kind
    assert len(packed) < x.nbytes / 6
