"""Benchmark decontamination: passages of documents against a BM25 index of test items.

Items, and their questions, are cut into pieces that lie whole in one of the overlapping
passages.  A piece's BM25 score is divided by what the piece itself would get, so scores
run up to 1 and one threshold holds for all.  Block-max WAND: blocks of pieces carry the largest score that
each term can add there; a passage scores only blocks whose bound reaches the threshold,
and those exactly, so all pieces above the threshold are found.  Found items are verified
against the whole document: on five-word shingles of question and answer, or, as a word
that is changed or missing breaks five of those, on how many words of the whole item or of
its question lie in runs of three that the document has.

A batch of documents is scored at once: passages and their terms are rows, bounds and
scores are sums over postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import kept_rows, ready, texts

#: Words of a piece, at most; a passage is two steps of as many words.
PIECE = 48
#: Pieces whose largest scores are kept together.
BLOCK = 16
#: Items of one index, at most; more items are searched in several passes.
SHARD_ITEMS = 4096
#: Items of fewer words are found only as they are, as a whole run of words.
LEAST_WORDS = 5
#: A last sentence of fewer words is no answer of its own, a question of fewer words does not count alone.
PART_WORDS = 10
#: Words of a run that counts as common to an item and a document.
RUN = 3
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.?!\n]+\s*(?=\S)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item up to its last sentence, and of that; an item of one sentence is both.

    Sentences before a last one of fewer than PART_WORDS words are part of the answer,
    until it has as many.
    """
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    while len(parts) > 1 and len(parts[-1]) < PART_WORDS:
        parts[-2:] = [parts[-2] + parts[-1]]
    if len(parts) < 2:
        whole = parts[0] if parts else []
        return whole, whole
    return [w for part in parts[:-1] for w in part], parts[-1]


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _overlap(part: list[str], found: dict[int, set]) -> float:
    """Share of a part's shingles that a document has; ``found`` holds its shingles by length."""
    mine = shingles(part)
    n = min(5, len(part))
    return len(mine & found[n]) / len(mine) if mine else 1.0


def coverage(part: list[str], runs: set[tuple[str, ...]]) -> float:
    """Share of a part's words that lie in one of the ``runs`` of RUN words."""
    covered = bytearray(len(part))
    for i in range(len(part) - RUN + 1):
        if tuple(part[i : i + RUN]) in runs:
            covered[i : i + RUN] = b"\1" * RUN
    return sum(covered) / len(part) if part else 0.0


class Index:
    """BM25 postings of pieces, ordered by term and piece, with block maxima."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        self.items: list[tuple[int, list[str], list[str]]] = []
        self.words: list[list[str]] = []
        self.short: dict[tuple[str, ...], list[int]] = {}
        self.terms: dict[str, int] = {}
        owners, term, piece, times, length = [], [], [], [], []
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) < LEAST_WORDS:
                if words:
                    self.short.setdefault(tuple(words), []).append(item_id)
                continue
            asked, answer = question_and_answer(text)
            # a question that counts alone must be found alone
            for part in [words, asked] if PART_WORDS <= len(asked) < len(words) else [words]:
                cuts = np.linspace(0, len(part), -(-len(part) // PIECE) + 1).astype(int)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    counts: dict[int, int] = {}
                    for w in part[i:j]:
                        t = self.terms.setdefault(w, len(self.terms))
                        counts[t] = counts.get(t, 0) + 1
                    term += counts
                    times += counts.values()
                    piece += [len(owners)] * len(counts)
                    length.append(j - i)
                    owners.append(len(self.items))
            self.items.append((item_id, asked, answer))
            self.words.append(words)
        self.short_lengths = sorted({len(words) for words in self.short})
        self.owner = np.array(owners, np.int64)
        self.n_pieces, self.n_blocks = len(owners), -(-len(owners) // BLOCK)
        if not owners:
            return
        term, piece, tf = np.array(term), np.array(piece), np.array(times, float)
        length = np.array(length, float)
        df = np.bincount(term)
        idf = np.log1p((self.n_pieces - df + 0.5) / (df + 0.5))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[piece] / length.mean()))
        score /= np.bincount(piece, score)[piece]
        order = np.lexsort((piece, term))
        self.piece, self.score = piece[order], score[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.most = np.maximum.reduceat(self.score, self.start[:-1])
        # block maxima: one posting for each term and block
        place = term[order] * self.n_blocks + self.piece // BLOCK
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.block_score = np.maximum.reduceat(self.score, first)
        self.block = place[first] % self.n_blocks
        self.block_start = np.searchsorted(place[first] // self.n_blocks, np.arange(len(df) + 1))

    @staticmethod
    def _postings(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which row of ``terms`` each posting belongs to, and the postings."""
        n = start[terms + 1] - start[terms]
        row = np.repeat(np.arange(len(terms)), n)
        return row, start[terms][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]

    def search(self, documents: list[list[str]], threshold: float) -> list[tuple[int, int, float]]:
        """(document, piece, best score) of all pieces that a passage scores ``threshold`` or more for."""
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        if not self.n_pieces or not sizes.sum():
            return []
        ids = np.fromiter(map(self.terms.get, chain.from_iterable(documents), repeat(-1)), np.int64, int(sizes.sum()))
        steps = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step = (np.cumsum(steps) - steps)[doc] + at // PIECE
        known = ids >= 0
        n_terms = len(self.terms)
        # a passage is a step and the next one of its document; it is named by its first
        keys = step[known] * n_terms + ids[known]
        owner = np.repeat(np.arange(len(sizes)), steps)
        has_before = np.diff(owner, prepend=-1) == 0
        second = has_before[step[known]]
        pairs = np.unique(np.concatenate([keys, keys[second] - n_terms]))
        passage, terms = pairs // n_terms, pairs % n_terms
        # the largest scores of a passage's terms must reach the threshold at all
        able = np.bincount(passage, self.most[terms])[passage] >= threshold - 1e-9
        passage, terms = passage[able], terms[able]
        row, posting = self._postings(self.block_start, terms)
        bound = np.bincount(passage[row] * self.n_blocks + self.block[posting], self.block_score[posting])
        open_blocks = np.flatnonzero(bound >= threshold - 1e-9)
        if not len(open_blocks):
            return []
        inside = np.isin(passage, open_blocks // self.n_blocks)
        passage, terms = passage[inside], terms[inside]
        row, posting = self._postings(self.start, terms)
        piece = self.piece[posting]
        kept = np.isin(passage[row] * self.n_blocks + piece // BLOCK, open_blocks)
        places, inverse = np.unique(passage[row[kept]] * self.n_pieces + piece[kept], return_inverse=True)
        score = np.bincount(inverse, self.score[posting[kept]])
        hits = score >= threshold - 1e-9
        best: dict[tuple[int, int], float] = {}
        for place, s in zip(places[hits].tolist(), score[hits].tolist()):
            key = (int(owner[place // self.n_pieces]), place % self.n_pieces)
            best[key] = max(s, best.get(key, 0.0))
        return [(d, p, s) for (d, p), s in best.items()]


def short_items(index: Index, document: list[str]) -> Iterator[tuple[int, float, float, float]]:
    """Hits of the short items whose words are a run of the document's: every share is 1."""
    for n in index.short_lengths:
        runs = set(zip(*[document[i:] for i in range(n)]))
        for words in sorted(index.short.keys() & runs):
            for item_id in index.short[words]:
                yield item_id, 1.0, 1.0, 1.0


def verified(
    index: Index, document: list[str], scores: dict[int, float], question: float, answer: float, whole: float
) -> Iterator[tuple[int, float, float, float]]:
    """(item_id, score, question share, answer share) of the items in ``scores`` that a document holds."""
    lengths = {min(5, len(p)) for i in scores for p in index.items[i][1:]}
    own = {n: shingles(document, n) for n in {*lengths, RUN}}
    for i, score in scores.items():
        item_id, q, a = index.items[i]
        q_share, a_share = _overlap(q, own), _overlap(a, own)
        held = q_share >= question and a_share >= answer
        held = held or coverage(index.words[i], own[RUN]) >= whole
        if held or (len(q) >= PART_WORDS and coverage(q, own[RUN]) >= whole):
            yield item_id, score, q_share, a_share


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    question: float = 0.6,
    answer: float = 0.5,
    whole: float = 0.7,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Test items found in documents: (doc_id, item_id, score, question_overlap, answer_overlap).

    All passages of all whole texts are searched.  An item counts if a passage scores
    ``threshold`` of a piece's own score or more and the document has the shares
    ``question`` and ``answer`` of the shingles of the item's parts, or the share
    ``whole`` of the words of the item, or of its question alone, in runs of RUN words.
    Items of fewer than LEAST_WORDS words count where all their words are a run of the
    document's.  Case and punctuation do not matter.  Null and empty texts hold nothing,
    items without words are in no document, repeated rows give repeated hits, rows without an id give hits without one.  No items give no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = texts(docs, id_col, text_col)
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"

    def scan(shard: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(shard))  # at most shard_items items

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = index.value
            for batch in batches:
                documents = [words_of(t) for t in batch["text"]]
                ids = batch["doc_id"].astype("Int64").tolist()
                found: dict[int, dict[int, float]] = {}
                for d, piece, score in held.search(documents, threshold):
                    item = int(held.owner[piece])
                    scores = found.setdefault(d, {})
                    scores[item] = max(score, scores.get(item, 0.0))
                out = []
                for d, words in enumerate(documents):
                    hits = [*verified(held, words, found[d], question, answer, whole)] if d in found else []
                    out += [(ids[d], *hit) for hit in [*hits, *short_items(held, words)]]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

        return rows.mapInPandas(run, schema)

    found, shard = [], []
    listed = items.select(F.col(item_id_col).cast("bigint"), F.col(item_text_col))
    for item in listed.toLocalIterator():
        shard.append(tuple(item))
        if len(shard) == shard_items:
            found.append(scan(shard))
            shard = []
    if shard or not found:
        found.append(scan(shard))
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    return result


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Rows without an id stay.
    """
    hits = contaminated(docs, items, id_col, **options).select("doc_id")
    return kept_rows(docs, hits, id_col)
