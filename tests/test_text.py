import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearset.operators import text as X

TEXTS = [
    (1, "The the it with it it"),
    (2, "with it"),
    (3, "1st a within\nit  the The"),
    (4, "zebra"),
]
STOP = ["the", "it"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def words(text, lower=True):
    return [w for w in (text.lower() if lower else text).split(" ") if w]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tokens_and_counts(docs):
    tokens = X.tokenize(docs)
    expected = sorted((d, w) for d, t in TEXTS for w in words(t))
    assert rows(tokens, "doc_id", "term") == expected
    counts = Counter(expected)
    got = X.term_counts(tokens)
    assert {(r.doc_id, r.term): r.cnt for r in got.collect()} == counts
    assert {r.doc_id: r.n_words for r in got.collect()} == {d: len(words(t)) for d, t in TEXTS}
    df = Counter(w for _, w in counts)
    assert {r.term: r.df for r in X.doc_frequency(got).collect()} == df
    assert [r.term for r in X.word_counts(tokens).collect()][:1] == ["it"]
    assert {r.term for r in X.vocabulary(tokens).collect()} == set(df)
    assert X.document_count(docs).first().n_docs == 4


def test_stop_words_before_and_after_lower_casing(docs, spark):
    lower = X.tokenize(docs, STOP, drop_noise=True)
    assert {r.term for r in lower.collect()} == {"with", "within\nit", "zebra"}
    # looked up as written, "The" is not a stop word and becomes the term "the"
    written = X.tokenize(docs, STOP, drop_noise=True, lower_first=False)
    assert {r.term for r in written.collect()} == {"the", "with", "within\nit", "zebra"}
    table = spark.createDataFrame([("the",), ("it",)], "word string")
    left = X.remove_stopwords(X.tokenize(docs), table)
    assert {r.term for r in left.collect()} == {"with", "1st", "a", "within\nit", "zebra"}


def test_words_by_whitespace(docs):
    got = X.tokenize(docs, on_whitespace=True).where("doc_id = 3")
    assert rows(got, "term") == sorted((w,) for w in TEXTS[2][1].lower().split())


def test_standard_weights(docs):
    got = {(r.doc_id, r.term): r.weight for r in X.tf_idf(docs).collect()}
    df = Counter(w for _, t in TEXTS for w in set(words(t)))
    for doc_id, t in TEXTS:
        for w in set(words(t)):
            expected = words(t).count(w) / len(words(t)) * math.log(4 / df[w])
            assert got[doc_id, w] == pytest.approx(expected)
    assert len(got) == sum(len(set(words(t))) for _, t in TEXTS)


@pytest.mark.parametrize("mode", ["token", "substring"])
def test_floor_weights(docs, mode):
    got = X.tf_idf(docs, "reference", mode, STOP, drop_noise=True, lower_first=False)
    got = {(r.doc_id, r.term): (r.cnt, r.weight) for r in got.collect()}
    kept = {
        d: {w.lower() for w in words(t, False) if len(w) > 1 and not w[0].isdigit() and w not in STOP}
        for d, t in TEXTS
    }
    df = Counter(w for terms in kept.values() for w in terms)
    expected = {}
    for d, t in TEXTS:
        kept_words = [w for w in words(t, False) if w not in STOP]
        counts = {
            w: t.lower().count(w) if mode == "substring" else [x.lower() for x in kept_words].count(w)
            for w in kept[d]
        }
        for w, n in counts.items():
            expected[d, w] = (n, (n // max(counts.values())) / (4 // df[w]))
    assert got == expected


def test_floor_weights_by_hand(spark):
    # ten documents, a term in three of them: weight 0 when it is not the most frequent
    texts = [(1, "aa bb bb"), (2, "aa aa"), (3, "aa")] + [(i, "zz") for i in range(4, 11)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r.doc_id, r.term): r.weight for r in X.tf_idf(docs, "reference").collect()}
    assert got[1, "aa"] == 0.0
    assert got[2, "aa"] == pytest.approx(1 / 3)


def test_substring_counts(spark):
    docs = spark.createDataFrame([(1, "with it it"), (2, "aaaa aa")], "doc_id bigint, text string")
    got = {(r.doc_id, r.term): r.cnt for r in X.substring_counts(docs, X.count_terms(docs)).collect()}
    assert got == {(1, "with"): 1, (1, "it"): 3, (2, "aaaa"): 1, (2, "aa"): 3}


def test_contained_terms_of_long_tokens(spark, monkeypatch):
    monkeypatch.setattr(X, "_WHOLE", 3)
    words_ = ["ab", "abc", "abcd", "xabcdabcdx", "bcda", "dabcdx", "aaaaaa", "aaaa", "a", "éaéa", "éa"]
    frame = spark.createDataFrame([(w,) for w in words_], "token string")
    got = X.contained_terms(frame, frame.withColumnRenamed("token", "term"))
    expected = {(t, w): t.count(w) for t in words_ for w in words_ if w in t}
    assert {(r.token, r.term): r.matches for r in got.collect()} == expected
    assert got.count() == len(expected)


@pytest.mark.parametrize("mode", ["token", "substring"])
def test_incidence(docs, mode):
    vocabulary = {w for _, t in TEXTS for w in t.lower().split()}
    expected = sorted(
        (d, w)
        for d, t in TEXTS
        for w in vocabulary
        if (w in t.lower() if mode == "substring" else w in t.lower().split())
    )
    assert rows(X.incidence(docs, mode), "doc_id", "term") == expected


def test_vectors_maps_and_lines(docs, spark):
    vectors = X.incidence_vectors(docs, X.incidence(docs), ["it", "with", "zebra"])
    assert {r.doc_id: r.vector for r in vectors.collect()} == {
        1: [1, 1, 0], 2: [1, 1, 0], 3: [1, 0, 0], 4: [0, 0, 1],
    }
    weights = spark.createDataFrame([(7, "b", 0.5), (7, "a", 0.25)], "doc_id int, term string, weight double")
    assert X.weight_maps(weights).first().weights == {"a": 0.25, "b": 0.5}
    assert X.render_documents(weights).first().line == "7: {a=0.250000000, b=0.500000000}"


def test_unknown_options(docs):
    with pytest.raises(ValueError):
        X.tf_idf(docs, "log")
    with pytest.raises(ValueError):
        X.incidence(docs, "stem")


def test_terms_inside_very_long_tokens(spark, monkeypatch):
    """Tokens that are not cut into all their pieces are looked up by their runs."""
    rng = random.Random(4)
    letters = "abäc"
    tokens = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(80)}
    tokens |= {"x" * 70, "y" * 65 + "é𝄞z", "é𝄞z", "𝄞", "z", "ab"}
    terms = {t[i : i + n] for t in tokens for i in (0, len(t) // 2) for n in (1, 2, 3, 4, 9, 80)} | tokens | {"qqqq", "q", "xyz"}
    expected = {(a, b, a.count(b)) for a in tokens for b in terms if b and b in a}
    frames = [spark.createDataFrame([(x,) for x in xs if x], f"{name} string") for xs, name in ((tokens, "token"), (terms, "term"))]
    for whole in (64, 5, 3):
        monkeypatch.setattr(X, "_WHOLE", whole)
        assert {tuple(r) for r in X.contained_terms(*frames).select("token", "term", "matches").collect()} == expected


def test_a_token_of_100000_characters(spark):
    rng = random.Random(5)
    token = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    terms = {token[i : i + n] for i in range(0, 100_000, 500) for n in (1, 2, 3, 7, 70)} | {token, "zzz", "abcdefghabcdefgh"}
    frames = [spark.createDataFrame([(x,) for x in xs], f"{name} string") for xs, name in (([token, "abc"], "token"), (terms, "term"))]
    got = {r.term: r.matches for r in X.contained_terms(*frames).where(F.length("token") > 10).collect()}
    assert got == {t: token.count(t) for t in terms if t in token}
