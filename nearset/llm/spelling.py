"""Spelling variants: words of a vocabulary that differ by one letter, found by bit-sliced indexes.

An index has a bitset over its words for each (position, letter).  A word is looked up
against all words of the index at once: for each of its letters a step of bitwise
operations keeps the sets of words that have matched so far without an error, with one
replaced letter, with one letter fewer (read one position to the left) and with one letter
more (one position to the right).

Words with one difference share their first or their last half, counted on the shorter
word.  So each word goes to the groups of its halves, and every group gets an index of its
own; a group that is too large is cut into blocks, and each pair of blocks is a task row.
"""

from __future__ import annotations

import collections
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import ready, texts
from nearset.runtime import write_once

#: Words of a group on average, and of a block of a group that has more than BLOCK of them.
GROUP = 1 << 10
BLOCK = 1 << 13
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 1 << 18
#: Bytes of bitsets that the words looked up together take.
TOGETHER = 1 << 25
#: Words with more code points have groups of their own, however few they are.
LONG = 128
_RUNS = re.compile("[a-zÀ-ÿ]+")


def damaged_runs(text: str, doc_id: int | None, every: int = 97) -> Iterator[tuple[str, int]]:
    """(word, count) of a text's runs of letters, with A-Z in lower case.

    A run whose crc32 of "doc_id:run" ``every`` divides loses the code point at that crc32
    modulo its length.  A null id is written as an empty text.
    """
    runs = collections.Counter(_RUNS.findall(text.encode(errors="surrogatepass").lower().decode(errors="surrogatepass")))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(
    docs: DataFrame, min_chars: int = 5, min_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): the damaged runs of whole texts with enough code points and occurrences.

    Null and empty texts have none; repeated documents count each time.  A task sums its
    words before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in damaged_runs(text, doc_id, every):
                    if len(word) >= min_chars:
                        counts[word] = counts.get(word, 0) + n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
        yield out()

    ready(docs.sparkSession)
    counted = texts(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths): a row of letter numbers for each word, 0 where it has ended."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    out = np.zeros((len(words), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _bits(members: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bitsets of 64-bit numbers: bit ``members[i]`` of set ``rows[i]``."""
    out = np.zeros((n_rows, width), np.uint64)
    bit = np.uint64(1) << (members & 63).astype(np.uint64)
    np.bitwise_or.at(out, (rows, members >> 6), bit)
    return out


class PositionIndex:
    """Bitsets over ``words`` for each (position, letter) and for each length.

    ``near(queries)`` gives (i, j) for each query i and word j with exactly one inserted,
    deleted or replaced code point between them.
    """

    def __init__(self, words: list[str]):
        letters, sizes = _letters(words)
        self.width = -(-len(words) // 64)
        member, place = np.nonzero(letters)
        # set 0 is empty: letters that no word has there
        self.codes, row = np.unique(place << 32 | letters[member, place], return_inverse=True)
        self.sets = _bits(member, row + 1, len(self.codes) + 1, self.width)
        self.lengths, row = np.unique(sizes, return_inverse=True)
        self.of_length = _bits(np.arange(len(words)), row + 1, len(self.lengths) + 1, self.width)

    def _row(self, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The set of each wanted number, 0 if there is none."""
        at = np.searchsorted(known, wanted)
        at[at == len(known)] = 0
        return np.where(known[at] == wanted, at + 1, 0) if len(known) else np.zeros_like(at)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(queries)), key=lambda i: -len(queries[i]))
        step = max(1, TOGETHER // (8 * max(1, self.width)))
        found = [self._near([queries[i] for i in order[at : at + step]]) for at in range(0, len(order), step)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.concatenate([i + at for (i, _), at in zip(found, range(0, len(order), step))])
        return np.array(order)[first], np.concatenate([j for _, j in found])

    def _near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``near``, for queries by descending length."""
        letters, sizes = _letters(queries)
        shape = (len(queries), self.width)
        same = np.full(shape, ~np.uint64(0))
        replaced, fewer, more = (np.zeros(shape, np.uint64) for _ in range(3))
        for at in range(letters.shape[1]):
            k = int(np.searchsorted(-sizes, -at, "left"))  # queries that have a letter here
            letter = letters[:k, at]
            here, left, right = (
                self.sets[self._row(self.codes, (at + shift) << 32 | letter)] if at + shift >= 0 else np.uint64(0)
                for shift in (0, -1, 1)
            )
            s = same[:k]
            more[:k] = (more[:k] | s) & right
            fewer[:k] = fewer[:k] & left | s
            replaced[:k] = replaced[:k] & here | s & ~here
            same[:k] = s & here
        length = [self.of_length[self._row(self.lengths, sizes + d)] for d in (-1, 0, 1)]
        hits = fewer & length[0] | replaced & length[1] | (more | same) & length[2]
        i, word = np.nonzero(hits)
        bits = np.unpackbits(hits[i, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return i[row], word[row] * 64 + bit


def _pairs(table: pa.Table) -> pa.Table:
    """Near words of a group, or of two of its blocks, in both directions."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    # a word may come to a group by several of its halves
    block = table.column("block").to_numpy()
    _, one = np.unique(np.array(words, object), return_index=True)
    words, n, block = [words[i] for i in one], n[one], block[one]
    if len(np.unique(block)) > 1:
        a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    else:
        a = b = np.arange(len(words))
    i, j = PositionIndex([words[x] for x in b]).near([words[x] for x in a])
    i, j = a[i], b[j]
    if a is not b:
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
    columns = [pa.array([words[x] for x in i], pa.string()), pa.array([words[x] for x in j], pa.string()), pa.array(n[j])]
    return pa.table(columns, ["word", "near", "near_n"])


def near_words(words: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for words (word, n) with one code point inserted, deleted or replaced.

    Rows may repeat.  ``words`` is a written table of distinct words.
    """
    size = F.length("word")
    n_groups = max(1, -(-4 * words.count() // group))

    def halves(shorter: Column) -> list[Column]:
        """The groups of the first and last half of the shorter of two words, as this one holds them."""
        half = F.floor(shorter / 2).cast("int")
        first = F.xxhash64(shorter, F.lit("first"), F.substr("word", F.lit(1), half))
        last = F.xxhash64(shorter, F.lit("last"), F.substr("word", size - (shorter - half) + 1))
        return [F.when(shorter > LONG, key).otherwise(F.pmod(key, F.lit(n_groups))) for key in (first, last)]

    rows = words.select("word", "n", F.explode(F.array(*halves(size), *halves(size - 1))).alias("group"))
    large = rows.groupBy("group").count().where(F.col("count") > block)
    large = large.select("group", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(write_once(large, "large"), "group", "left")
    rows = rows.select("group", "word", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("group", "word", "n", "block", other)
    rows = rows.select(
        "group", "word", "n", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    schema = "word string, near string, near_n bigint"
    return rows.groupBy("group", "low", "high").applyInArrow(_pairs, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words (word, form): forms are followed to the last by doubling steps.

    A form has at least twice its word's count, so chains have no rings and at most 63
    steps, and six rounds are enough.
    """
    steps = write_once(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = write_once(
            steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "forms"
        )
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        steps = write_once(moved.select("word", "root"), "forms")


def spelling_forms(words: DataFrame, times: int = 2, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct words (word, n).

    n_near counts the words with one difference.  The form is the most frequent of them
    (of equals the first in code-point order) if it is at least ``times`` as frequent, else
    null; ``times`` is 2 or more.  The root is the last of the chain of forms, or the word
    itself.  Without words the result is empty.
    """
    if times < 2:
        raise ValueError(f"times must be at least 2: {times}")
    words = write_once(words.select("word", "n"), "words")
    near = near_words(words, group, block)
    # near words of one word are at most some hundred for each of its letters
    found = near.groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("n"), "near")).alias("near"))
    best = F.array_min("near")
    found = found.select("word", F.size("near").cast("bigint").alias("n_near"), best["near"].alias("best"), (-best["n"]).alias("best_n"))
    form = F.col("best_n") >= times * F.col("n")
    out = write_once(
        words.join(write_once(found, "near"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
