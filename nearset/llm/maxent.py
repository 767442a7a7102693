"""Scores of texts by a hashed maximum-entropy language model.

1. Documents are gathered to chunks of some megabytes with a vocabulary of their own, so
   that words are counted and looked up once a chunk and not once a document.
2. Counts of all words in the training documents are made by Spark and brought back to
   the chunks.
3. The model says P(word | context) = P(class | context) * P(word | class, context).  The
   few hundred words that make up a set share of the corpus are in classes of CLASS_SIZE;
   the others are classed by how often they come (powers of two, and one class for words
   never seen), and the words of such a class, ordered by their counts, are the leaves of
   a tree whose nodes have FAN children.  Every choice is a softmax, log-linear in hashed
   features of the context: the word before, the one before that (a skip), and both.
4. Common weights take other than frequent words by their class alone.  Training documents
   are dealt to groups of about GROUP_TOKENS by a hash; gradient steps are taken in each
   group from the common weights, and the weighted mean of all groups is the next weights.
   A training word counts as one less frequent than it is, as it is not in its own past,
   which teaches the model what unseen words are worth.
5. Weights of the words themselves, frequent or not, are in shards, one for SHARD_TOKENS
   training tokens.  Tokens are dealt to shards by their context, those of a frequent
   context to several; a shard learns its weights on top of the common ones and scores
   its tokens.

Groups and shards take documents in the order of a hash of id and text, so the scores are
those of the rows, however these lie in files and partitions.
"""

from __future__ import annotations

import copy
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearset.llm.common import ready, texts
from nearset.llm.encode import gathered
from nearset.runtime import write_once

#: Bytes of text in a chunk, and documents' tokens that are worked on together.
CHUNK = 3 << 22
TOGETHER = 1 << 19
#: Words that come more often than once in so many are modelled one by one.
HEAD_SHARE = 2000
#: Members of a class of such words.
CLASS_SIZE = 16
#: Classes by count: unseen, 1, 2-3, 4-7, ...
TAIL_CLASSES = 48
#: Rows of hashed common weights, for classes and for members of classes.
CLASS_ROWS, MEMBER_ROWS = 1 << 14, 1 << 11
#: Children of a node in the tree of a class, whose members are its leaves.
FAN = 2
#: Training tokens for which there is one shard, and its rows of hashed weights.
SHARD_TOKENS = 1 << 20
SHARD_CLASS_ROWS, SHARD_NODE_ROWS = 1 << 14, 1 << 19
#: Shards that share a context: one for so many tokens that the context may have.
SPREAD_TOKENS = SHARD_TOKENS >> 3
#: Training tokens from which one set of common weights is learned, before all are averaged.
GROUP_TOKENS = 1 << 21
#: Words of chunks that are counted together.
PART_WORDS = 250_000
#: Numbers of words: 0 if unseen, frequent ones from 1, the others from here in the order of
#: their counts.
FIRST_TAIL = 1 << 12
#: Tokens of a step, at least and at most; between, so many that there are 32 steps.
BATCH, LARGE_BATCH = 1 << 13, 1 << 15
#: Weights that are moved together.
BLOCK = 1 << 14


#: Arrays travel compressed, byte by byte of the numbers: the high bytes are mostly alike.
_CODEC = "zstd"


def _packed(x: np.ndarray) -> bytes:
    """An array as its length and its compressed bytes, the first byte of all numbers first."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(4, "little") + (pa.compress(planes, _CODEC, asbytes=True) if planes else b"")


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(packed[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(packed[4:], n * width, _CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for number, table in enumerate(gathered(batches, CHUNK)):
        text = pc.ascii_lower(table.column("text").combine_chunks().cast(pa.large_string()))
        lists = pc.ascii_split_whitespace(text)
        del text
        coded = lists.flatten().dictionary_encode()
        words, ids, ends = coded.dictionary.cast(pa.string()), np.asarray(coded.indices), np.asarray(lists.offsets)
        nothing = pc.index(words, "").as_py()  # between separators that follow each other
        real = ids != nothing
        n = np.diff(np.concatenate([[0], np.cumsum(real)])[ends])
        ids = ids[real]
        del lists, coded, real
        train = np.asarray(table.column("train").to_pylist(), bool)
        seen = np.bincount(ids[np.repeat(train, n)], minlength=len(words))
        own = [table.column(name).combine_chunks() for name in ("doc_id", "mark")]
        packed = _packed(ids.astype(np.int32, copy=False))
        row = [_as_list(v) for v in (*own, pa.array(train), pa.array(n), words, pa.array(seen))]
        row = [pa.array([(part << 20) + number], pa.int64()), *row, pa.array([packed], pa.binary())]
        del ids, seen, words, packed
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays(row, _CHUNK_NAMES)


def _as_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_CHUNK_COLUMNS = (
    "chunk bigint, doc_ids array<bigint>, marks array<int>, train array<boolean>, n_words array<bigint>, "
    "words array<string>, seen array<bigint>, ids binary"
)
_CHUNK_NAMES = [column.split()[0] for column in _CHUNK_COLUMNS.split(", ")]


_WORDS_COLUMNS = "part bigint, chunk bigint, places binary, words array<string>, seen binary"
_WORDS_NAMES = [column.split()[0] for column in _WORDS_COLUMNS.split(", ")]


def _words_by_part(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a chunk, dealt to parts by a hash of the word."""
    for batch in batches:
        for chunk, words, seen in zip(*(batch.column(name) for name in ("chunk", "words", "seen"))):
            words, seen = words.values, seen.values.to_numpy()
            part = np.fromiter((zlib.crc32(w) % parts for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            owners, begin = np.unique(part[order], return_index=True)
            rows = [order[i:j] for i, j in zip(begin, [*begin[1:], len(order)])]
            columns = [
                pa.array(owners, pa.int64()),
                pa.array([chunk.as_py()] * len(rows), pa.int64()),
                pa.array([_packed(r.astype(np.int32)) for r in rows], pa.binary()),
                pa.ListArray.from_arrays(pa.array([*begin, len(order)], pa.int32()), words.take(pa.array(order))),
                pa.array([_packed(seen[r]) for r in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, _WORDS_NAMES)


_COUNTS_COLUMNS = (
    "part bigint, unseen bigint, counts array<bigint>, n array<bigint>, often array<string>, often_counts array<bigint>, "
    "chunks array<bigint>, places array<binary>, ranks array<binary>"
)
_COUNTS_NAMES = [column.split()[0] for column in _COUNTS_COLUMNS.split(", ")]


def _counted(table: pa.Table) -> pa.Table:
    """The words of a part in the order of their counts, then their own, in one row.

    It has the different counts and how many words have each, the words that may be
    frequent in the corpus, and by chunk the places of words and their ranks here.
    """
    coded = pa.concat_arrays([x.values for x in table.column("words").combine_chunks()]).dictionary_encode()
    ids = coded.indices.to_numpy()
    seen = np.concatenate([_unpacked(x, np.int64) for x in table.column("seen").to_pylist()])
    # sums of bincount are exact up to 2^53
    count = np.bincount(ids, seen, len(coded.dictionary)).astype(np.int64)
    order = pc.sort_indices(pa.table({"c": count, "w": coded.dictionary}), [("c", "ascending"), ("w", "ascending")]).to_numpy()
    rank, count = np.empty(len(order), np.int32), count[order]
    rank[order] = np.arange(len(order))
    ranks = np.split(rank[ids], np.cumsum(pc.list_value_length(table.column("words")).to_numpy())[:-1])
    counts, n = np.unique(count[count > 0], return_counts=True)
    often = np.flatnonzero((count > 0) & (count * HEAD_SHARE >= count.sum()))
    lists = [
        pa.array(counts, pa.int64()),
        pa.array(n, pa.int64()),
        coded.dictionary.take(pa.array(order[often])),
        pa.array(count[often], pa.int64()),
        table.column("chunk").combine_chunks(),
        table.column("places").combine_chunks(),
        pa.array([_packed(r) for r in ranks], pa.binary()),
    ]
    one = [table.column("part")[:1].combine_chunks(), pa.array([int((count == 0).sum())])]
    return pa.Table.from_arrays([*one, *map(_as_list, lists)], _COUNTS_NAMES)


_NUMBERS_COLUMNS = "chunk bigint, places binary, numbers binary"


def _numbers(head: dict[str, int], tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By chunk the numbers of its words; ``before`` is the number of the first word of each count in the part."""
    for batch in batches:
        for row in batch.select(["unseen", "counts", "n", "often", "before", "chunks", "places", "ranks"]).to_pylist():
            counts, n = np.array(row["counts"], np.int64), np.array(row["n"], np.int64)
            rare = np.searchsorted(counts * HEAD_SHARE, tokens)
            first = np.cumsum(n[:rare]) - n[:rare]
            before = np.array(row["before"] or [], np.int64) - first
            numbers = np.concatenate([np.zeros(row["unseen"], np.int64), np.repeat(before, n[:rare]) + np.arange(n[:rare].sum())])
            often = row["often"][len(row["often"]) - int(n[rare:].sum()) :]
            numbers = np.append(numbers, np.array([head[w] for w in often], np.int64))
            found = [_packed(numbers[_unpacked(ranks, np.int32)]) for ranks in row["ranks"]]
            columns = [pa.array(row["chunks"], pa.int64()), *(pa.array(x, pa.binary()) for x in (row["places"], found))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "places", "numbers"])


_WHOLE_COLUMNS = "chunk bigint, doc_ids array<bigint>, marks array<int>, train array<boolean>, n_words array<bigint>, ids binary, numbers binary"
_WHOLE_NAMES = [column.split()[0] for column in _WHOLE_COLUMNS.split(", ")]


def _with_numbers(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk with the numbers of its words in the order of their places."""
    places, numbers = (
        np.concatenate([np.zeros(0, kind), *(_unpacked(x, kind) for x in found.column(name).to_pylist())])
        for name, kind in (("places", np.int32), ("numbers", np.int64))
    )
    out = np.empty_like(numbers)
    out[places] = numbers
    return chunk.append_column("numbers", pa.array([_packed(out)], pa.binary())).select(_WHOLE_NAMES)


def tail_class(counts: np.ndarray) -> np.ndarray:
    """0 for words never seen, then one more with each doubling."""
    return np.where(counts > 0, np.frexp(counts.astype(float))[1], 0)


@dataclass(frozen=True)
class Corpus:
    """What the counts say: tokens, distinct tokens, documents, frequent words, counts in the tail."""

    tokens: int
    distinct: int
    documents: int
    head: dict[str, int]  # word: number from 1; 0 is the end of a document
    head_counts: np.ndarray
    tail_totals: np.ndarray
    # of other words, by count: the different counts, and how many words have each
    tail_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tail_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def shards(self) -> int:
        return max(1, -(-self.tokens // SHARD_TOKENS))

    @functools.cached_property
    def tree(self) -> tuple[np.ndarray, ...]:
        """By class its first word and number of words; words and tokens up to each count."""
        size = np.bincount(tail_class(self.tail_counts), self.tail_words, len(self.tail_totals)).astype(np.int64)
        words = np.append(0, np.cumsum(self.tail_words))
        return np.cumsum(size) - size, size, words, np.append(0, np.cumsum(self.tail_counts * self.tail_words))

    def words(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """Counts of words by their numbers, frequent words (else -1), and places among the others."""
        often, rare = (numbers > 0) & (numbers < FIRST_TAIL), numbers >= FIRST_TAIL
        out = {"heads": np.where(often, numbers, -1), "places": np.where(rare, numbers - FIRST_TAIL, 0)}
        counts = np.zeros(len(numbers), np.int64)
        counts[often] = self.head_counts[numbers[often]]
        # words of the tail stand in the order of their counts
        counts[rare] = self.tail_counts[np.searchsorted(self.tree[2], out["places"][rare], side="right") - 1]
        return out | {"counts": counts}

    @property
    def bounds(self) -> np.ndarray:
        """Where classes of frequent words begin, then their number."""
        n = len(self.head_counts)
        return np.append(np.arange(0, n, CLASS_SIZE), n)


def document_tokens(corpus: Corpus, row: dict, only_train: bool) -> Iterator[Tokens]:
    """The tokens of a chunk, some documents at a time."""
    n, ids, counts = row["n_words"], row["ids"], row["counts"]
    if only_train:
        train = np.asarray(row["train"], bool)
        ids, n, counts = ids[np.repeat(train, n)], n[train], np.maximum(counts - 1, 0)
    ends = np.cumsum(n)
    step = (ends + np.arange(1, len(n) + 1) - 1) // TOGETHER
    for one in np.unique(step):
        i, j = np.searchsorted(step, [one, one + 1])
        tokens = Tokens(corpus, n[i:j], ids[ends[i] - n[i] : ends[j - 1]], counts, row["heads"])
        tokens.place_of(row, ids[ends[i] - n[i] : ends[j - 1]])
        yield tokens


class Weights:
    """Rows of class weights and of member weights; the first row of each is for every context."""

    def __init__(self, corpus: Corpus):
        bounds = corpus.bounds
        by_class = np.append(np.add.reduceat(corpus.head_counts, bounds[:-1]), corpus.tail_totals)
        self.classes = np.zeros((CLASS_ROWS, len(by_class)), np.float32)
        self.classes[0] = np.log((by_class + 0.5) / (by_class + 0.5).sum())
        self.members = np.zeros((MEMBER_ROWS, len(corpus.head_counts)), np.float32)
        self.members[0] = np.log(corpus.head_counts + 0.5)


class Tokens:
    """The tokens of a chunk in order, each document with its end: counts, classes and features."""

    def __init__(self, corpus: Corpus, n: np.ndarray, ids: np.ndarray, counts: np.ndarray, heads: np.ndarray):
        """``n`` words of each document in ``ids``; ``counts`` and ``heads`` by id."""
        ends = np.cumsum(n)
        self.count = np.insert(counts[ids], ends, corpus.documents)
        self.head = np.insert(heads[ids], ends, 0)
        own = np.where(self.head >= 0, self.head, len(corpus.head_counts) + tail_class(self.count))
        self._contexts(corpus, n + 1, own)

    @classmethod
    def coded(cls, corpus: Corpus, doc_tokens: np.ndarray, own: np.ndarray) -> Tokens:
        """From tokens as they are told apart as contexts."""
        made = cls.__new__(cls)
        made.head = np.where(own < len(corpus.head_counts), own, -1)
        made._contexts(corpus, doc_tokens, own)
        return made

    def _contexts(self, corpus: Corpus, doc_tokens: np.ndarray, own: np.ndarray) -> None:
        """``own`` is a frequent word itself, of another one its class."""
        n_head, n_classes = len(corpus.head_counts), len(corpus.bounds) - 1
        self.doc_tokens, self.own = doc_tokens, own
        self.target = np.where(own < n_head, own // CLASS_SIZE, n_classes + own - n_head)
        self.at = np.arange(len(own)) - np.repeat(np.cumsum(doc_tokens) - doc_tokens, doc_tokens)
        self.one, self.two = self.before(own, 1), self.before(own, 2)
        self.features = _features(self.one, self.two)

    def before(self, x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
        """``x`` of the token ``n`` places earlier in the document, or ``start``."""
        out = np.full_like(x, start)
        out[n:] = x[:-n]
        out[self.at < n] = start
        return out

    def place_of(self, row: dict, ids: np.ndarray) -> None:
        """Add numbers of words among all others of the tail, and words by a hash; 0 for unseen words and ends."""
        ends = np.cumsum(self.doc_tokens - 1)
        self.place = np.insert(row["places"][ids], ends, 0)
        self.key = np.insert(np.where(row["counts"] > 0, row["keys"], 0)[ids], ends, 0)


def _features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.stack([_hashed(1, one), _hashed(2, two), _hashed(3, one * 65_537 + two)])


def _hashed(kind: int, x: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32)


def _rows(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Weight rows from 1; row 0 is for every context."""
    return (hashes % np.uint32(rows - 1) + np.uint32(1)).astype(np.uint16)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax_at(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of each row, for which ``z`` is used up, and its log at one column of each."""
    every = np.arange(len(z))
    z -= z.max(axis=1, keepdims=True)
    own = z[every, at]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z /= total[:, None]
    return z, own - np.log(total)


def _sum_of_rows(z: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """``z``, to which the rows of ``weights`` are added in place."""
    for r in rows:
        z += weights.take(r, axis=0)
    return z


class Learner:
    """AdaGrad steps on copies of two tables of weights; keeps how often each row was met."""

    def __init__(self, first: np.ndarray, second: np.ndarray, rate: float):
        self.weights = (first.copy(), second.copy())
        self.squares = tuple(np.full(w.shape, 1e-6, np.float32) for w in self.weights)
        self.met = tuple(np.zeros(len(w), np.int64) for w in self.weights)
        self.rate = rate

    def step(self, which: int, rows: list[np.ndarray], grad: np.ndarray, columns: np.ndarray | None = None) -> None:
        """Descend along ``grad`` of each token, summed over tokens of a row; every token meets the first row."""
        w, met = self.weights[which], self.met[which]
        rows = [r.astype(np.int64) for r in rows]
        if columns is None:
            g = np.empty(w.shape)
            # a column at a time stays in the cache
            for j, own in enumerate(np.ascontiguousarray(grad.T, float)):
                g[:, j] = sum(np.bincount(r, own, len(w)) for r in rows)
            g[0] += grad.sum(axis=0)
        else:
            flat = grad.ravel().astype(float)
            g = sum(np.bincount((r[:, None] * w.shape[1] + columns).ravel(), flat, w.size) for r in rows)
            g[: w.shape[1]] += np.bincount(columns.ravel(), flat, w.shape[1])
        for r in rows:
            met += np.bincount(r, minlength=len(met))
        met[0] += len(grad)
        self._move(which, g.ravel())

    def step_each(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """The same for single weights, of which a token meets several."""
        grad = np.broadcast_to(grad.astype(float), rows.shape)
        self._move(which, np.bincount(rows.ravel(), grad.ravel(), self.weights[which].size))

    def _move(self, which: int, g: np.ndarray) -> None:
        w, s = self.weights[which].reshape(-1), self.squares[which].reshape(-1)
        # some at a time, that stay in the cache
        for i in range(0, len(w), BLOCK):
            step, square = g[i : i + BLOCK].astype(np.float32), s[i : i + BLOCK]
            square += step * step
            step *= self.rate
            step /= np.sqrt(square)
            w[i : i + BLOCK] -= step


def _batch(tokens: int) -> int:
    return min(max(BATCH, tokens >> 5), LARGE_BATCH)


def run_tokens(corpus: Corpus, classes: np.ndarray, members: np.ndarray, t: Tokens, learner: Learner | None) -> np.ndarray:
    """log10 probability of each token; with a learner, steps are taken on the way."""
    out = np.zeros(len(t.target))
    bounds = corpus.bounds
    n_classes = len(bounds) - 1
    size = _batch(len(out))
    for i in range(0, len(out), size):
        target, head = t.target[i : i + size], t.head[i : i + size]
        f = [_rows(x[i : i + size], CLASS_ROWS) for x in t.features]
        grad, log_p = _softmax_at(_sum_of_rows(classes[0] + classes.take(f[0], axis=0), classes, f[1:]), target)
        value = log_p.astype(float)
        if learner is not None:
            grad[np.arange(len(target)), target] -= 1
            learner.step(0, f, grad)
        among = np.flatnonzero(target < n_classes)
        k, width = target[among], members.shape[1]
        which = head[among] - bounds[k]
        m = [_rows(x[i : i + size][among], MEMBER_ROWS).astype(np.int64) for x in t.features]
        columns = bounds[k][:, None] + np.arange(CLASS_SIZE)
        missing = columns >= bounds[k + 1][:, None]
        columns[missing] = 0
        flat = members.reshape(-1)
        z = flat.take(columns)
        for x in m:
            z += flat.take(x[:, None] * width + columns)
        z[missing] = -np.inf
        grad, log_q = _softmax_at(z, which)
        value[among] += log_q
        if learner is not None:
            grad[np.arange(len(among)), which] -= 1
            learner.step(1, m, grad, columns)
        rare = np.flatnonzero((target > n_classes))
        if len(rare) and learner is None:
            count = t.count[i : i + size][rare]
            value[rare] += np.log(count / corpus.tail_totals[target[rare] - n_classes])
        out[i : i + size] = value
    return out / np.log(10)


#: Tokens of a block as they travel, one array for each: classes and contexts with a last
#: bit for words that training takes to the class below, and hashes of the words of a
#: context that are not frequent.  A run is what a document has in the block: its number in
#: the chunk (with a last bit for training), its mark, its tokens.
_TOKEN = {"target": np.uint8, "place": np.int64, "one": np.int16, "two": np.int16}
_KEYS = {"one_key": np.int32, "two_key": np.int32}
_RUN = {"docs": np.int32, "marks": np.int32, "sizes": np.int32}
_BLOCK_NAMES = [*_TOKEN, *_KEYS, *_RUN]
_BLOCK_COLUMNS = "shard bigint, chunk bigint, " + ", ".join(f"{name} binary" for name in _BLOCK_NAMES)


def _place_kind(corpus: Corpus) -> type:
    return np.int32 if corpus.distinct < 1 << 31 else np.int64


def _blocks(corpus: Corpus, row: dict) -> Iterator[pa.RecordBatch]:
    """The tokens of a chunk by shard."""
    n_head, n_classes = len(corpus.head_counts), len(corpus.bounds) - 1
    train, done = np.asarray(row["train"], np.int64), 0
    for t in document_tokens(corpus, row, False):
        docs = np.arange(done, done + len(t.doc_tokens))
        done += len(docs)
        tail = t.head < 0
        # words that training takes to the class below: counts that are powers of two
        lower = tail & (t.count > 0) & (t.count & (t.count - 1) == 0)
        own = np.where(tail, n_head + 2 * (t.own - n_head) + lower, t.own)
        key = np.where(tail, t.key, t.head)
        count = np.where(tail, t.count, corpus.head_counts[t.head]).astype(np.int64)
        one, two, one_key, two_key = t.before(own, 1), t.before(own, 2), t.before(key, 1), t.before(key, 2)
        one_count, two_count = t.before(count, 1, corpus.documents), t.before(count, 2, corpus.documents)

        # a context goes to as many shards as its count may ask for, by the documents' marks
        marks = np.repeat(row["marks"][docs].astype(np.int64) & 0xFFFFFFFF, t.doc_tokens)
        part = marks % (1 + np.where(one >= n_head, one_count, np.minimum(one_count, two_count)) // SPREAD_TOKENS)
        first, second = one_key.astype(np.int64) << 12, two_key.astype(np.int64)
        often = _hashed(5, t.one * 65_537 + t.two + (part << 44))
        both = np.where(one >= n_head, first, first + second) + (part << 44)
        hashes = np.where((one < n_head) & (two < n_head), often, _hashed(4, both))
        # after an unseen word there is nothing to learn, and any shard will do
        hashes = np.where(t.one == n_head, _hashed(6, marks + t.at), hashes)
        shard = hashes.astype(np.int64) % corpus.shards

        order = np.argsort(shard, kind="stable")
        target = np.where(tail, n_classes + 2 * (t.target - n_classes) + lower, t.target)
        columns = {"target": target, "place": np.where(tail, t.place, t.head), "one": one, "two": two}
        columns = {name: columns[name].astype(kind)[order] for name, kind in (_TOKEN | {"place": _place_kind(corpus)}).items()}
        owner, doc = shard[order], np.repeat(docs, t.doc_tokens)[order]
        starts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        run = doc[starts]
        runs = {"docs": 2 * run + train[run], "marks": row["marks"][run], "sizes": np.diff(np.append(starts, len(doc)))}
        owners, begin = np.unique(owner, return_index=True)
        cuts = [*zip(begin.tolist(), [*begin[1:].tolist(), len(owner)])]
        parts = [[_packed(columns[name][i:j]) for i, j in cuts] for name in _TOKEN]
        for name, keys in (("one", one_key), ("two", two_key)):
            own_key = keys.astype(np.int32)[order]
            rare = columns[name] >= n_head
            parts.append([_packed(own_key[i:j][rare[i:j]]) for i, j in cuts])
        cuts = np.searchsorted(starts, cuts).tolist()
        parts += [[_packed(runs[name][i:j].astype(kind)) for i, j in cuts] for name, kind in _RUN.items()]
        same = [pa.array(owners, pa.int64()), pa.array([row["chunk"]] * len(owners), pa.int64())]
        names = ["shard", "chunk", *_BLOCK_NAMES]
        yield pa.RecordBatch.from_arrays([*same, *(pa.array(p, pa.binary()) for p in parts)], names)


def shard_tokens(corpus: Corpus, table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Documents and columns of the tokens of a shard, in an order of the rows alone.

    Documents stand in the order of their marks; those of equal marks by what they have
    here.
    """
    n_head, n_classes = len(corpus.head_counts), len(corpus.bounds) - 1
    kinds = _TOKEN | _KEYS | _RUN | {"place": _place_kind(corpus)}
    t = {name: np.concatenate([_unpacked(x, kind) for x in table.column(name).to_pylist()]) for name, kind in kinds.items()}
    runs = [int.from_bytes(x[:4], "little") for x in table.column("docs").to_pylist()]
    docs = (np.repeat(table.column("chunk").to_numpy(), runs) << 24) + (t["docs"] >> 1)
    size, begin = t["sizes"].astype(np.int64), np.cumsum(t["sizes"], dtype=np.int64) - t["sizes"]
    for name in ("one", "two"):
        key = t[name].astype(np.int32)
        key[t[name] >= n_head] = t[f"{name}_key"]
        t[f"{name}_key"] = key
    last = begin + size - 1
    order = np.lexsort((t["two_key"][begin], t["place"][last], t["one_key"][begin], t["place"][begin], size, t["marks"]))
    n = size[order]
    at = np.repeat(begin[order] - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = {name: t[name][at].astype(np.int32) for name in ("target", "one", "two", *_KEYS)} | {"place": t["place"][at]}
    flags = 8 * (np.repeat(t["docs"][order], n) & 1)
    for bit, (name, least) in enumerate((("target", n_classes), ("one", n_head), ("two", n_head))):
        x = out[name]
        flags += (x >= least) * ((x - least) & 1) << bit
        out[name] = np.where(x >= least, least + (x - least) // 2, x)
    return np.repeat(docs[order], n), out | {"flags": flags.astype(np.uint8)}


class _Paths:
    """The ways to words of the tail: at each node with two children, which way a word goes.

    ``node`` is a hash of it, ``way`` 1 or -1, and ``prior`` the log of the odds of this way
    by the words' counts.  Entries of the word at ``at[i]`` begin at ``first[i]``.
    """

    def __init__(self, corpus: Corpus, place: np.ndarray):
        first, size, words, tokens = corpus.tree
        own, self.at = np.unique(place, return_inverse=True)
        k = np.searchsorted(first + size, own, side="right")
        local, size, begin = own - first[k], size[k], first[k]
        bits = range(int(size.max(initial=1) - 1).bit_length() - 1, -1, -1)
        # a node has words on both sides of its middle
        middles = [(local >> b + 1 << b + 1) + (1 << b) for b in bits]
        self.n = sum((m < size).astype(np.int64) for m in middles) if len(bits) else np.zeros(len(own), np.int64)
        self.first = np.cumsum(self.n) - self.n
        entries, done = int(self.n.sum()), self.first.copy()
        self.node, self.way = np.zeros(entries, np.int32), np.zeros(entries, np.float32)
        self.prior = np.zeros(entries, np.float32)
        for b, middle in zip(bits, middles):
            here = np.flatnonzero(middle < size)
            middle, low = middle[here], begin[here]
            # words in order pass a node one after another
            new = np.diff(middle + low, prepend=-1) != 0
            edge = middle[new] + low[new] + (1 << b) * np.arange(-1, 2)[:, None]
            under = np.diff(np.interp(np.minimum(edge, (low + size[here])[new]), words, tokens), axis=0)
            odds = np.log(under[1] / under[0]).astype(np.float32)
            of, to = np.cumsum(new) - 1, done[here]
            way = np.where(local[here] >= middle, np.float32(1), np.float32(-1))
            self.node[to] = _node_rows((edge[1] << 6) + b).astype(np.int32)[of]
            self.way[to], self.prior[to] = way, way * odds[of]
            done[here] += 1

    def only(self, some: np.ndarray) -> _Paths:
        """Those of some of the words given."""
        made = copy.copy(self)
        made.at = self.at[some]
        return made

    def of(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        """Number of entries of the words given from ``i`` to ``j``; then their nodes, ways and priors."""
        own = self.at[i:j]
        n = self.n[own]
        ends = np.cumsum(n)
        at = np.repeat(self.first[own] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)
        return n, self.node[at].astype(np.int64), self.way[at], self.prior[at]


def _member_paths(q: np.ndarray, k: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for members of classes of frequent words, given what the common weights say of all members."""
    every = np.arange(len(child))
    nodes, ways, priors = [], [], []
    while q.shape[1] > 1:
        way = child & 1
        own, other = q[every, child], q[every, child ^ 1]
        with np.errstate(divide="ignore"):
            priors.append(np.log(own) - np.log(other))
        child = child >> 1
        nodes.append(_node_rows(-1 - ((k * q.shape[1] + child << 5) + q.shape[1])))
        ways.append(np.where(way == 1, np.float32(1), np.float32(-1)))
        q = q[:, 0::2] + q[:, 1::2]
    node, way, prior = (np.stack(x, axis=1) for x in (nodes, ways, priors))
    open_ = np.isfinite(prior)  # no members on the other side: there is nothing to choose
    return open_.sum(axis=1), node[open_], way[open_], prior[open_]


def run_shard(
    corpus: Corpus, common: Weights, tables: tuple, t: dict[str, np.ndarray], learner: Learner | None, paths: _Paths | None = None
) -> np.ndarray:
    """log10 probability of each token of a shard; with a learner, steps are taken on the way, as for words that come once less."""
    out = np.zeros(len(t["target"]))
    bounds = corpus.bounds
    n_classes = len(bounds) - 1
    classes, nodes = tables[0], tables[1].reshape(-1)
    # members of a class side by side
    members = np.full((MEMBER_ROWS, n_classes * CLASS_SIZE), -np.inf, np.float32)
    members[:, : bounds[-1]] = common.members
    members = members.reshape(-1, CLASS_SIZE)
    tails, done = t["target"] > n_classes, 0
    paths = paths or _Paths(corpus, t["place"][tails])
    size = _batch(len(out))
    for i in range(0, len(out), size):
        b = {name: x[i : i + size].astype(np.int64) for name, x in t.items()}
        target, one, two = b["target"], b["one"], b["two"]
        if learner is not None:
            target, one, two = target - (b["flags"] & 1), one - (b["flags"] >> 1 & 1), two - (b["flags"] >> 2 & 1)
        features = _features(one, two)
        keys = [b["one_key"], b["two_key"], b["one_key"] * 1_000_003 + b["two_key"]]
        own = [_hashed(kind, x) for kind, x in zip((7, 8, 9), keys)]
        f, g = [_rows(x, CLASS_ROWS) for x in features], [_rows(x, SHARD_CLASS_ROWS) for x in own]
        z = common.classes.take(f[0], axis=0)
        z += common.classes[0] + classes[0]
        z = _sum_of_rows(_sum_of_rows(z, common.classes, f[1:]), classes, g)
        grad, log_p = _softmax_at(z, target)
        value = log_p.astype(float)
        if learner is not None:
            grad[np.arange(len(target)), target] -= 1
            learner.step(0, g, grad)
        # nodes on the way to members of classes of frequent words, and to the others
        head = np.flatnonzero(b["target"] < n_classes)
        tail = np.flatnonzero(b["target"] > n_classes)
        k = b["target"][head]
        base = members.take(k, axis=0)
        for x in features:
            base += members.take(_rows(x[head], MEMBER_ROWS).astype(np.int64) * n_classes + k, axis=0)
        child = b["place"][head] - bounds[k]
        found = _member_paths(_softmax_at(base, child)[0], k, child)
        found = [np.concatenate(x) for x in zip(found, paths.of(done, done + len(tail)))]
        done += len(tail)
        n, node, way, z = found
        who = np.repeat(np.append(head, tail), n)
        rows = np.stack([node, *(_node_rows(x.astype(np.int64))[who] ^ node for x in own)])
        z += way * nodes.take(rows).sum(axis=0)
        wrong = np.exp(-z)
        wrong += 1
        value -= np.bincount(who, np.log(wrong), len(value))
        if learner is not None:
            np.divide(1, wrong, out=wrong)
            wrong -= 1
            wrong *= way
            learner.step_each(1, rows, wrong)
        out[i : i + size] = value
    return out / np.log(10)


def _node_rows(x: np.ndarray) -> np.ndarray:
    """Places of weights, or what other hashes change in them."""
    return (_hashed(10, x) & np.uint32(SHARD_NODE_ROWS * FAN - 1)).astype(np.int64)


_SCORES_COLUMNS = "shard bigint, chunk bigint, docs binary, scores binary"


def score_shard(corpus: Corpus, common: Weights, table: pa.Table, passes: int, rate: float) -> pa.Table:
    """By chunk the documents of one shard and the scores of their tokens in it, after learning from those for training."""
    docs, t = shard_tokens(corpus, table)
    shape = (SHARD_CLASS_ROWS, len(corpus.bounds) - 1 + len(corpus.tail_totals))
    learner = Learner(np.zeros(shape, np.float32), np.zeros((SHARD_NODE_ROWS, FAN), np.float32), rate)
    learned, tails = t["flags"] >= 8, t["target"] > len(corpus.bounds) - 1
    paths = _Paths(corpus, t["place"][tails])
    for _ in range(passes if learned.any() else 0):
        own = {name: x[learned] for name, x in t.items()}
        run_shard(corpus, common, learner.weights, own, learner, paths.only(learned[tails]))
    score = run_shard(corpus, common, learner.weights, t, None, paths)
    own, inverse = np.unique(docs, return_inverse=True)
    score = np.bincount(inverse, score).astype(np.float32)
    chunks, begin = np.unique(own >> 24, return_index=True)
    cuts = [*zip(begin, [*begin[1:], len(own)])]
    own = (own & (1 << 24) - 1).astype(np.int32)
    columns = [[_packed(x[i:j]) for i, j in cuts] for x in (own, score)]
    same = [pa.array([table.column("shard")[0].as_py()] * len(cuts), pa.int64()), pa.array(chunks, pa.int64())]
    return pa.Table.from_arrays([*same, *(pa.array(c, pa.binary()) for c in columns)], ["shard", "chunk", "docs", "scores"])


_BASE_COLUMNS = "chunk bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_known array<bigint>, base_scores array<double>"
_BASE_NAMES = [column.split()[0] for column in _BASE_COLUMNS.split(", ")]


def _base_scores(corpus: Corpus, row: dict) -> pa.RecordBatch:
    """Of the documents of a chunk, in one row."""
    n = row["n_words"]
    counts = np.insert(row["counts"][row["ids"]], np.cumsum(n), corpus.documents)
    first = np.cumsum(n + 1) - n - 1
    value = np.log10((counts + 1) / (corpus.tokens + corpus.distinct + 1))
    lists = [
        pa.array(row["doc_ids"], pa.int64()),
        pa.array((n + 1).astype(np.int64)),
        pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)),
        pa.array(np.add.reduceat(value, first)),
    ]
    return pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), *map(_as_list, lists)], _BASE_NAMES)


_RESULT_COLUMNS = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _whole_scores(tokens: int, base: pa.Table, scores: pa.Table) -> pa.Table:
    """A row for each document of a chunk: scores are summed in the order of the shards."""
    own = [base.column(name).combine_chunks().values for name in _BASE_NAMES[1:]]
    total = np.zeros(len(own[0]))
    scores = scores.sort_by("shard")
    for docs, score in zip(scores.column("docs").to_pylist(), scores.column("scores").to_pylist()):
        total[_unpacked(docs, np.int32)] += _unpacked(score, np.float32)
    columns = [*own[:3], pa.array(np.full(len(total), tokens)), own[3], pa.array(total)]
    return pa.Table.from_arrays(columns, [column.split()[0] for column in _RESULT_COLUMNS.split(", ")])


def _rows_of(batch: pa.RecordBatch, corpus: Corpus) -> Iterator[dict]:
    """Rows with numeric lists as arrays; words are told apart by their numbers."""
    for i in range(batch.num_rows):
        row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}
        out = {"chunk": row["chunk"].as_py(), "doc_ids": row["doc_ids"].as_py(), "train": row["train"].as_py()}
        out |= {name: row[name].values.to_numpy(zero_copy_only=False) for name in ("marks", "n_words")}
        out |= {name: _unpacked(row[name].as_py(), kind) for name, kind in (("ids", np.int32), ("numbers", np.int64))}
        out["keys"] = out["numbers"].astype(np.int32)
        out |= corpus.words(out.pop("numbers"))
        yield out


_CODES_COLUMNS = "part bigint, mark int, codes binary"


def _codes(corpus: Corpus, groups: int, row: dict) -> Iterator[pa.RecordBatch]:
    """The training documents of a chunk, two bytes a token, with the group of each."""
    marks = row["marks"][np.asarray(row["train"], bool)]
    for t in document_tokens(corpus, row, True) if len(marks) else ():
        ends = np.cumsum(t.doc_tokens).tolist()
        own, marks, here = t.own.astype(np.uint16), marks[len(ends) :], marks[: len(ends)]
        codes = [own[i:j].tobytes() for i, j in zip([0, *ends], ends)]
        part = (_hashed(11, here.astype(np.int64) & 0xFFFFFFFF)).astype(np.int64) % groups
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(here, pa.int32()), pa.array(codes, pa.binary())], ["part", "mark", "codes"]
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Codes of documents of one group that are worked on together; groups come one after another."""
    held, size, part = [], 0, None
    for batch in batches:
        for own, codes in zip(batch.column("part").to_pylist(), batch.column("codes").to_pylist()):
            if held and (own != part or size >= 2 * TOGETHER):
                yield part, held
                held, size = [], 0
            part, size = own, size + len(codes)
            held.append(codes)
    if held:
        yield part, held


_MOVES_COLUMNS = "part bigint, which int, row int, n bigint, moved array<float>"
_MOVES = pa.schema({"part": pa.int64(), "which": pa.int32(), "row": pa.int32(), "n": pa.int64(), "moved": pa.list_(pa.float32())})


def _moves(corpus: Corpus, start: Weights, part: int, learner: Learner) -> Iterator[pa.RecordBatch]:
    """How far each row has moved, times how often it was met."""
    for which, old in enumerate((start.classes, start.members)):
        met = np.flatnonzero(learner.met[which])
        n = learner.met[which][met]
        moved = (learner.weights[which][met] - old[met]) * n[:, None]
        lists = pa.array(list(moved.astype(np.float32)), pa.list_(pa.float32()))
        same = [pa.array(np.full(len(met), x), kind) for x, kind in ((part, pa.int64()), (which, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*same, pa.array(met, pa.int32()), pa.array(n), lists], _MOVES.names)


def _train_pass(codes: DataFrame, corpus: Corpus, weights: Weights, rate: float) -> Weights:
    """Steps within each group of documents, and the mean of all groups."""
    spark = codes.sparkSession
    common = spark.sparkContext.broadcast((corpus, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, start = common.value
        part, learner = None, None
        for own, held in _groups(batches):
            if own != part:
                if learner is not None:
                    yield from _moves(corpus, start, part, learner)
                part, learner = own, Learner(start.classes, start.members, rate)
            n = np.array([len(x) // 2 for x in held])
            t = Tokens.coded(corpus, n, np.frombuffer(b"".join(held), np.uint16).astype(np.int64))
            run_tokens(corpus, *learner.weights, t, learner)
        if learner is not None:
            yield from _moves(corpus, start, part, learner)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at most as many rows as the model has; groups come in their order
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            keys = zip(batch.column("which").to_pylist(), batch.column("row").to_pylist())
            for key, n, moved in zip(keys, batch.column("n").to_pylist(), batch.column("moved")):
                before = sums.get(key, (0, 0.0))
                sums[key] = (before[0] + n, before[1] + moved.values.to_numpy().astype(float))
        rows = [{"part": 0, "which": k[0], "row": k[1], "n": n, "moved": (v / n).astype(np.float32)} for k, (n, v) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _MOVES)

    moves = codes.sortWithinPartitions("part", "mark", "codes").mapInArrow(run, _MOVES_COLUMNS)
    placed = moves.repartition("which", "row").sortWithinPartitions("which", "row", "part")
    for r in placed.mapInArrow(add_up, _MOVES_COLUMNS).toLocalIterator():
        w = weights.classes if r["which"] == 0 else weights.members
        w[r["row"]] += np.array(r["moved"], np.float32)
    return weights


def language_scores(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    passes: int = 1,
    rate: float = 0.15,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every document.

    ``train`` is a condition on doc_id: the model and the counts learn from the whole
    texts of those documents.  Only A-Z are lower-cased, words are cut at ASCII white
    space, and each document ends with one end token.  base_score sums log10((c + 1) /
    (N + V + 1)); score is the model's log10 probability.  Null and empty texts are the
    end alone; null ids and repeated rows are scored like others; without training
    documents every word is unseen.  An empty table gives an empty result.  Scores do not
    depend on how rows lie in partitions; documents whose hashes of 32 bits are equal are
    told apart by their tokens.
    """
    spark = docs.sparkSession
    ready(spark)
    marked = texts(docs, id_col, text_col).withColumn("train", F.coalesce(train, F.lit(False)))
    marked = marked.withColumn("mark", F.hash("doc_id", "text"))
    chunks = write_once(marked.mapInArrow(_chunks, _CHUNK_COLUMNS), "chunks")

    words = chunks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(1, -(-words // PART_WORDS))
    dealt = chunks.select("chunk", "words", "seen").mapInArrow(lambda x: _words_by_part(parts, x), _WORDS_COLUMNS)
    counted = write_once(dealt.groupBy("part").applyInArrow(_counted, _COUNTS_COLUMNS), "counts")
    n_docs = chunks.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()[0]
    # by part and count the number of words
    runs = counted.select("part", F.explode(F.arrays_zip("counts", "n")).alias("x")).select("part", F.col("x.counts").alias("c"), "x.n")
    total, distinct = runs.agg(F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, distinct = total + n_docs, distinct + (n_docs > 0)
    often = F.col("c") * HEAD_SHARE >= tokens
    heads = counted.select(F.explode(F.arrays_zip("often", "often_counts")).alias("x"))
    heads = heads.select("x.often", F.col("x.often_counts").alias("c")).where(often)  # at most HEAD_SHARE
    head = sorted((-r["c"], r["often"]) for r in heads.toLocalIterator())
    by_count = runs.where(~often).groupBy("c").agg(F.sum("n").alias("n"))
    # different counts add up to no more than the tokens, so they are few
    tail = np.array(sorted(tuple(r) for r in by_count.toLocalIterator()), np.int64).reshape(-1, 2)
    k = tail_class(tail[:, 0])
    totals = np.bincount(k, tail[:, 0] * tail[:, 1], minlength=1).astype(float)
    corpus = Corpus(
        tokens,
        distinct,
        n_docs,
        {w: i for i, (_, w) in enumerate(head, 1)},
        np.array([n_docs, *(-c for c, _ in head)], float),
        totals,
        *tail.T,
    )
    # words of the tail are numbered in the order of their counts, then of their parts
    starts = spark.createDataFrame(pa.table({"c": tail[:, 0], "before": np.cumsum(tail[:, 1]) - tail[:, 1]}))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("before") + F.col("earlier") + FIRST_TAIL
    placed = runs.where(~often).withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, "c")
    placed = placed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("c", begin.alias("before")))).alias("x"))
    placed = counted.join(placed.select("part", F.col("x.before").alias("before")), "part", "left")
    numbered = placed.mapInArrow(lambda x: _numbers(corpus.head, tokens, x), _NUMBERS_COLUMNS)
    whole = chunks.drop("words", "seen").groupBy("chunk").cogroup(numbered.groupBy("chunk"))
    whole = write_once(whole.applyInArrow(_with_numbers, _WHOLE_COLUMNS), "chunks")

    weights = Weights(corpus)
    if n_docs and passes:
        groups = max(1, -(-tokens // GROUP_TOKENS))
        known = spark.sparkContext.broadcast(corpus)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows_of(batch, known.value):
                    yield from _codes(known.value, groups, row)

        codes = whole.mapInArrow(code, _CODES_COLUMNS).repartition("part")
        for _ in range(passes):
            weights = _train_pass(codes, corpus, weights, rate)
    model = spark.sparkContext.broadcast((corpus, weights))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, _ = model.value
        for batch in batches:
            for row in _rows_of(batch, corpus):
                yield from _blocks(corpus, row)

    def score(shard: pa.Table) -> pa.Table:
        return score_shard(*model.value, shard, passes, rate)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, _ = model.value
        for batch in batches:
            for row in _rows_of(batch, corpus):
                yield _base_scores(corpus, row)

    scores = whole.mapInArrow(deal, _BLOCK_COLUMNS).groupBy("shard").applyInArrow(score, _SCORES_COLUMNS)
    scored = whole.mapInArrow(base, _BASE_COLUMNS).groupBy("chunk").cogroup(scores.groupBy("chunk"))
    return scored.applyInArrow(lambda own, found: _whole_scores(tokens, own, found), _RESULT_COLUMNS)
