"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed to buckets; its vector is the mean of
theirs, and two softmax outputs stand on that.  A document pools the outputs of its
words by log-sum-exp, so one toxic word in a long text counts and several count more.
Embeddings and softmax are trained together in numpy on a bounded sample of labelled
texts.

With two classes the softmax depends on the difference ``u`` of its two rows alone, so a
word comes down to one number, the mean of ``embedding . u`` over its n-grams.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import ready, texts

#: Labelled rows, and characters in them, that the model is trained on at most.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 24_000_000
BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6, 7)
#: A word is clean until its n-grams say otherwise.
START_BIAS = -8.0
#: The larger, the more do several toxic words count above one.
TEMPER = 2.0
_WORDS_KEPT = 1 << 19
_WORDS_AT_ONCE = 1 << 16
_WORD = re.compile(r"\w+(?:[*@$!]+\w+)*")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$!])")
#: Signs that stand for letters.
_LOOKS_LIKE = str.maketrans("013457@$!", "oieastasi")


def words_of(text: str) -> dict[str, int]:
    """Lower-cased words and how often they come, a run of one word once; masked letters stay."""
    words = _WORD.findall(text.lower())
    counts: dict[str, int] = {}
    before = None
    for w in words:
        if w != before:
            counts[w] = counts.get(w, 0) + 1
        before = w
    return counts


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the character n-grams of a word, or of the word itself if it is short.

    Digits and signs among letters are read as the letters they look like.
    """
    if not word.isalpha() and _MIXED.match(word):
        word = word.translate(_LOOKS_LIKE)
    edged = f"<{word}>"
    parts = {edged[i : i + n] for n in GRAMS for i in range(len(edged) - n + 1)} or {edged}
    return [xxhash.xxh32_intdigest(p) % buckets for p in parts]


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each bucket: embedding . u
    bias: float

    def word(self, word: str) -> float:
        return float(self.weight[subwords(word, len(self.weight))].mean())


class Scorer(dict):
    """Scores texts; as a dictionary it keeps what words add."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = v = self.model.word(word)
        return v

    def score(self, text: str) -> float:
        words = words_of(text) if len(self.model.weight) else {}
        logit = self.model.bias
        if words:
            values = np.fromiter(map(self.__getitem__, words), float, len(words)) / TEMPER
            values += np.log(np.fromiter(words.values(), float, len(words)))
            logit += TEMPER * float(np.logaddexp.reduce(values))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(
    sample: list[str], toxic: np.ndarray, dims: int = 8, epochs: int = 120, rate: float = 1.0, buckets: int = BUCKETS
) -> Model:
    """Fit embeddings and softmax together by full-batch AdaGrad steps over all words.

    Clean texts weigh three times as much as toxic ones in sum.  Without both classes, or
    without words, the model says 0.5 everywhere.
    """
    y = np.asarray(toxic, float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0), 0.0)
    # flat arrays of four bytes a number: the driver holds words and n-grams of the whole sample
    index: dict[str, int] = {}
    ids, times, sizes = array("i"), array("i"), []
    for text in sample:
        words = words_of(text)
        ids.extend(index.setdefault(w, len(index)) for w in words)
        times.extend(words.values())
        sizes.append(len(words))
    if not index:
        return Model(np.zeros(0), 0.0)
    ids, log_times = np.frombuffer(ids, np.int32), np.log(np.frombuffer(times, np.int32))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part, part_size = array("i"), array("i")
    for w in index:
        grams = subwords(w, buckets)
        part.extend(grams)
        part_size.append(len(grams))
    n_words = len(index)
    del index
    part, part_size = np.frombuffer(part, np.int32), np.frombuffer(part_size, np.int32)
    begins = np.concatenate([[0], np.cumsum(part_size, dtype=np.int64)])
    # words in runs, so that what is computed for their n-grams at once is bounded
    runs = [(i, min(i + _WORDS_AT_ONCE, n_words)) for i in range(0, n_words, _WORDS_AT_ONCE)]
    # texts with words, and where the words of each begin
    with_words, first = np.unique(owner, return_index=True)
    place = np.zeros(len(y), np.int64)
    place[with_words] = np.arange(len(with_words))
    place = place[owner]
    y = y[with_words]
    share = np.where(y > 0, 0.25 / max(1, y.sum()), 0.75 / max(1, len(y) - y.sum()))

    rng = np.random.default_rng(7)
    e, u, bias = rng.normal(0, 0.1, (buckets, dims)), rng.normal(0, 1, dims), START_BIAS
    e2, u2, b2 = np.full((buckets, 1), 1e-4), np.full(dims, 1e-2), 1e-2
    for _ in range(epochs):
        bucket = e @ u
        word = np.concatenate(
            [np.add.reduceat(bucket[part[begins[i] : begins[j]]], begins[i:j] - begins[i]) for i, j in runs]
        )
        word /= part_size
        value = word[ids] / TEMPER + log_times
        top = np.maximum.reduceat(value, first)
        weight = np.exp(value - top[place])
        total = np.add.reduceat(weight, first)
        p = 1 / (1 + np.exp(-np.clip(bias + TEMPER * (top + np.log(total)), -30, 30)))
        g = (p - y) * share
        # back to words, then to buckets
        g_word = np.bincount(ids, (g / total)[place] * weight, n_words) / part_size
        g_bucket = np.zeros(buckets)
        for i, j in runs:
            g_bucket += np.bincount(part[begins[i] : begins[j]], np.repeat(g_word[i:j], part_size[i:j]), buckets)
        g_u, touched = g_bucket @ e, np.flatnonzero(g_bucket)
        step = g_bucket[touched, None] * u[None, :]
        e2[touched] += (step**2).mean(1, keepdims=True)
        e[touched] -= rate * step / np.sqrt(e2[touched])
        u2 += g_u**2
        u -= rate * g_u / np.sqrt(u2)
        b2 += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(b2)
    return Model(e @ u, float(bias))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, score, predicted) for every document: how likely label 1 is.

    ``labels`` has doc_id and toxic.  ``learn_from``, a condition on doc_id, says which
    ids may teach.  The model is trained on the labelled texts of the smallest hashes,
    half of them of each class where there are as many, up to ``sample_rows`` rows and
    ``sample_chars`` characters, half of them for each class in the order of the hashes; a
    text beyond what is left of that is passed over.  Of rows of one id the first text
    teaches, and of an id with both labels the 0.  Null labels teach nothing; without both
    classes the score is 0.5.  Null texts are empty and score the bias; null ids are scored too;
    repeated rows stay.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = texts(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)")
    if learn_from is not None:
        known = known.where(learn_from)
    # ids first, so that only texts of the sample travel
    drawn = [
        known.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        for y in (0, 1)
    ]
    drawn = [[r["doc_id"] for r in part.select("doc_id").collect()] for part in drawn]
    chosen = spark.createDataFrame([(i,) for i in {*drawn[0], *drawn[1]}], "doc_id bigint")
    # one text of each id, whatever the order of files
    held = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    size = {r["doc_id"]: r["size"] for r in held.select("doc_id", F.length("text").alias("size")).collect()}
    taken = {}
    for y, ids in enumerate(drawn):
        room = sample_chars // 2
        for i in ids:
            if i in size and i not in taken and size[i] <= room:
                room -= size[i]
                taken[i] = y
    wanted = spark.createDataFrame([(i,) for i in taken], "doc_id bigint")
    found = {r["doc_id"]: r["text"] for r in held.join(F.broadcast(wanted), "doc_id", "left_semi").toLocalIterator()}
    sample, toxic = [found[i] for i in taken], list(taken.values())
    del found
    model = spark.sparkContext.broadcast(train(sample, np.array(toxic, float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        for batch in batches:
            scores = [scorer.score(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    scored = rows.mapInPandas(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
