"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made in one pass over the whole texts and written once.  Trees are fitted
to a bounded sample of labelled rows and flattened into arrays, so that a batch goes
down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import ready, texts
from nearset.runtime import write_once

#: Labelled rows that the trees are fitted to, at most.
SAMPLE_ROWS = 20_000

STATISTICS = (
    "log_words",
    "chars_per_word",
    "longest_word",
    "distinct_words",
    "most_common_word",
    "same_as_before",
    "distinct_pairs",
    "distinct_lines",
    "words_per_line",
    "upper",
    "digits",
    "symbols",
    "bars",
    "exclamations",
    "stops",
    "commas",
    "other_marks",
    "not_ascii",
    "space",
    "upper_words",
    "title_words",
    "word_ends_in_mark",
)
_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "symbols": b"#*$%&<>@^~=+\\_{}[]",
    "bars": b"|",
    "exclamations": b"!?",
    "stops": b".",
    "commas": b",",
    "other_marks": b";:\"'()-/`",
    "not_ascii": bytes(range(128, 256)),
    "space": b" \t\n\r\x0b\f",
}
_CLASSES = np.zeros((256, len(_BYTES)))
for _i, _chars in enumerate(_BYTES.values()):
    _CLASSES[list(_chars), _i] = 1


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; a text without words has only zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES) / len(raw)
    # over distinct words, weighted by how often they come
    upper = title = ends = 0
    for w, k in counts.items():
        upper += k * (len(w) > 1 and w.isupper())
        title += k * w.istitle()
        ends += k * (not w[-1:].isalnum() and w[-1] < 128)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.max()),
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        (pairs + 1) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        *shares.tolist(),
        upper / n,
        title / n,
        ends / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with STATISTICS of every whole text; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [statistics(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "x": x})

    ready(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Trees:
    """Perfect binary trees: node i has children 2i+1 and 2i+2; a row goes right above the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # the same
    leaf: np.ndarray  # trees x leaves
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while inner and at[0, 0] < inner:
            right = x[rows, self.feature[trees, at]] > self.cut[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[trees, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x))) if len(x) else np.zeros(0)


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0
) -> Trees:
    """Boost ``trees`` trees on the logistic loss, splits found in histograms of ``bins`` bins.

    Without rows, or with one class, the trees are constant.
    """
    n, k = x.shape
    cuts = np.zeros((k, bins - 1))
    if n:
        for j in range(k):
            # halfway between neighbours, so that a cut does not lie on a value
            values = np.unique(x[:, j])
            middle = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values[:1]
            cuts[j] = middle[np.linspace(0, len(middle) - 1, bins - 1).round().astype(int)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1) if n else np.zeros((0, k), int)
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    logit = np.full(n, base)
    flat = codes + np.arange(k) * bins
    for t in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (k * bins) + flat).ravel()
            size = width * k * bins
            sums = [
                np.bincount(place, np.repeat(v, k), size).reshape(width, k, bins).cumsum(2) for v in (g, h)
            ]
            (gl, hl), (ga, ha) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
            gain[(hl < 1e-3) | (ha - hl < 1e-3)] = 0
            gain = gain[:, :, :-1].reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            j, b = best // (bins - 1), best % (bins - 1)
            feature[t, first : first + width] = j
            cut[t, first : first + width] = np.where(split, cuts[j, b], np.inf)
            own = at - first
            at = 2 * at + 1 + (split[own] & (codes[np.arange(n), j[own]] > b[own]))
        own = at - inner
        leaf[t] = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + smooth)
        logit += leaf[t][own]
    return Trees(feature, cut, leaf, base)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, score, predicted) for every document: how likely label 1 is.

    ``labels`` has doc_id and quality.  ``learn_from``, a condition on doc_id, says which
    ids may teach; the trees are fitted to at most ``sample_rows`` of them, those of the
    smallest hashes of their ids.  Labels that are null, or of no document, teach
    nothing; without any the score is 0.5.  Empty and null texts are scored by their
    zero statistics, null ids too; repeated rows stay.
    """
    made = write_once(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)")
    if learn_from is not None:
        known = known.where(learn_from)
    drawn = made.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    sample = drawn.select("x", "y").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(STATISTICS))
    model = fit_trees(x, sample["y"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.probability(x)})

    scored = made.mapInPandas(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
