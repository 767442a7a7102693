"""The toxicity model does not depend on the order of files, and its sample keeps its bounds."""

import numpy as np
from pyspark.sql import functions as F

from nearset.llm import toxicity

SCHEMA = "doc_id bigint, text string, toxic int, y int, size int"


def tables(spark, n=60):
    rng = np.random.default_rng(1)
    words = ["table", "window", "garden", "letter", "river", "music"]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 12))
        if i % 3 == 0:
            text[5] = str(rng.choice(["vileword", "v1leword", "nastyterm"]))
        rows.append((i, " ".join(text), i % 3 == 0))
    rows += [(5, "vileword again under an id of its own", False), (None, None, False), (900, "", False)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, _ in rows], SCHEMA)
    labels = [(i, int(y), "x") for i, _, y in rows[:n]] + [(3, 1, "x"), (None, 1, "x"), (4, None, "x"), (7777, 1, "x")]
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")


def scores(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in df.collect())


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = tables(spark)
    first = scores(toxicity.toxicity_scores(docs.coalesce(1), labels, sample_chars=2500))
    turned = docs.orderBy(F.desc("text")).repartition(7), labels.orderBy(F.desc("doc_id")).repartition(3)
    assert scores(toxicity.toxicity_scores(*turned, sample_chars=2500)) == first


def test_the_sample_keeps_its_bounds(spark, monkeypatch):
    docs, labels = tables(spark)
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda sample, y: seen.append((sample, y)) or plain(sample, y))
    toxicity.toxicity_scores(docs, labels, sample_rows=20, sample_chars=900).count()
    sample, y = seen[0]
    assert 0 < y.sum() <= 10 and 0 < (y == 0).sum() <= 10
    for label in (0, 1):
        assert sum(len(t) for t, x in zip(sample, y) if x == label) <= 450


def test_runs_of_words_do_not_change_the_model(monkeypatch):
    texts = [f"some plain words here {i}" for i in range(20)] + [f"vileword {i} among words" for i in range(10)]
    y = np.array([0] * 20 + [1] * 10)
    whole = toxicity.train(texts, y, epochs=5)
    monkeypatch.setattr(toxicity, "_WORDS_AT_ONCE", 3)
    parts = toxicity.train(texts, y, epochs=5)
    assert np.allclose(whole.weight, parts.weight, atol=1e-9) and abs(whole.bias - parts.bias) < 1e-9
