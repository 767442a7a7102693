"""Packing token pieces into sequences of a fixed capacity.

The linear grouping scheme (Fernandez de la Vega and Lueker, 1981) over the histogram
of lengths: large lengths are ordered and cut into groups of equal cardinality, each
rounded up to its largest; configurations of the few rounded sizes are filled as
tightly as counts allow, each taken as often as they allow; real pieces take the
places of their group; small lengths then go where they fit best.  The plan is made
from counts per length, at most as many numbers as the capacity, whatever the size
of the corpus.  Pieces find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.llm.common import ready, row_numbers, texts
from nearset.llm.encode import encoded
from nearset.runtime import write_once

GROUPS = 64


class _Group:
    """Pieces of one group in descending length, taken from the front."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = pieces  # (length, first rank, count)
        self.size = pieces[0][0]
        self.left = sum(n for _, _, n in pieces)
        self.at = (0, 0)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        self.left -= n
        out, (i, used) = [], self.at
        while n:
            length, first, count = self.pieces[i]
            m = min(n, count - used)
            out.append((length, first + used, m))
            n, used = n - m, used + m
            if used == count:
                i, used = i + 1, 0
        self.at = (i, used)
        return out


def _groups(counts: dict[int, int], groups: int) -> list[_Group]:
    """Equal-cardinality groups of the pieces in descending length."""
    total = sum(counts.values())
    if not total:
        return []
    size = -(-total // groups)
    out, now, room = [], [], size
    for length in sorted(counts, reverse=True):
        first, n = 0, counts[length]
        while n:
            m = min(n, room)
            now.append((length, first, m))
            first, n, room = first + m, n - m, room - m
            if not room:
                out, now, room = [*out, _Group(now)], [], size
    return [*out, _Group(now)] if now else out


def _configuration(groups: list[_Group], capacity: int) -> dict[int, int]:
    """Groups and how often, filling ``capacity`` most, with the largest size in it."""
    largest = next(i for i, g in enumerate(groups) if g.left)
    room = capacity - groups[largest].size
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, g in enumerate(groups):
        for _ in range(min(g.left - (i == largest), room // g.size)):
            wider = (reach | reach << g.size) & mask
            if wider == reach:
                break
            steps.append((i, reach))
            reach = wider
    at, used = reach.bit_length() - 1, defaultdict(int, {largest: 1})
    for i, before in reversed(steps):
        if not before >> at & 1:
            used[i] += 1
            at -= groups[i].size
    return used


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: int | None = None):
    """Runs (length, first rank, pieces, first sequence, pieces in a sequence), number of sequences.

    A piece of a run with rank r lies in sequence ``first sequence + (r - first rank) //
    pieces in a sequence``.  ``counts`` maps lengths in 1..capacity to pieces; lengths
    up to ``small`` (an eighth of the capacity) are not grouped.
    """
    small = capacity // 8 if small is None else small
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    if n := counts.get(capacity, 0):
        runs.append((capacity, 0, n, 0, 1))
        sequences = n
    large = _groups({k: n for k, n in counts.items() if small < k < capacity and n}, groups)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, sequences)
    while any(g.left for g in large):
        chosen = _configuration(large, capacity)
        times = min(large[i].left // k for i, k in chosen.items())
        room = np.array([[0, capacity]])  # from this sequence on, so much room
        for i, k in chosen.items():
            for _ in range(k):
                at, marks = 0, []
                for length, first, m in large[i].take(times):
                    runs.append((length, first, m, sequences + at, 1))
                    marks.append((at, length))
                    at += m
                marks = np.array(marks)
                cuts = np.union1d(room[:, 0], marks[:, 0])
                left = room[np.searchsorted(room[:, 0], cuts, "right") - 1, 1]
                taken = marks[np.searchsorted(marks[:, 0], cuts, "right") - 1, 1]
                room = np.column_stack([cuts, left - taken])
        ends = [*room[1:, 0].tolist(), times]
        for (at, left), end in zip(room.tolist(), ends):
            free[left].append((sequences + at, end - at))
        sequences += times

    free.pop(0, None)
    rooms = sorted(free)
    for length in sorted((k for k in counts if k <= small and k < capacity), reverse=True):
        n, rank = counts[length], 0
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # nothing has room: new sequences, filled with this length
                each = capacity // length
                m = max(1, n // each)
                room, start, held = capacity, sequences, m
                sequences += m
            else:
                room = rooms[i]
                start, held = free[room].pop()
                each = room // length
                m = min(held, max(1, n // each))
            put = min(n, m * each)
            if put < m * each:  # the last pieces share one sequence
                m, each = 1, put
            runs.append((length, rank, put, start, each))
            rank, n = rank + put, n - put
            if held > m:
                free[room].append((start + m, held - m))
            if i < len(rooms) and not free[room]:
                del free[room]
                rooms.pop(i)
            if left := room - each * length:
                if left not in free or not free[left]:
                    j = bisect_left(rooms, left)
                    if j == len(rooms) or rooms[j] != left:
                        rooms.insert(j, left)
                free[left].append((start, m))
    return runs, sequences


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 0,
    special_tokens: bool = False,
) -> DataFrame:
    """Pieces of the ids of each whole text: (doc_id, piece, start, length, ids_crc32, part).

    A document longer than ``capacity`` is cut every ``capacity`` ids.  Null and empty
    texts are the end id alone.  ``part`` numbers the batches of rows made together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids, counts in encoded(batches, tokenizer, end_id, special_tokens):
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = np.cumsum(length) - length
            sums = [zlib.crc32(ids[i : i + n]) for i, n in zip(at.tolist(), length.tolist())]
            columns = [
                table.column("doc_id").take(pa.array(doc)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array(sums, pa.int64()),
            ]
            yield from pa.table(columns, ["doc_id", "piece", "start", "length", "ids_crc32"]).to_batches()

    ready(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = texts(docs, id_col, text_col).mapInArrow(run, schema)
    return pieces.withColumn("part", F.spark_partition_id())


def pack(pieces: DataFrame, capacity: int, order: list[str], groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, which have ``length`` and ``part``.

    Lengths are 1..capacity.  Pieces of a sequence stand without gaps from 0, longest
    first and then by ``order``; the sequences number as few as the scheme finds.
    Repeated rows are packed as often as they come; no rows give no rows.
    """
    pieces = write_once(pieces, "pieces")
    counted = pieces.groupBy("length").count().where(f"length <= {int(capacity)}")
    counts = {r["length"]: r["count"] for r in counted.toLocalIterator()}
    runs, _ = plan(counts, capacity, groups)
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # (length, rank) as one number, to find the run of a piece by one search
    width = int(max(counts.values(), default=0)) + 1
    keys = table[:, 0] * width + table[:, 1]
    ranked = row_numbers(pieces, ["length"], order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = table[np.searchsorted(keys, length * width + rank, "right") - 1]
            yield batch.assign(sequence_id=row[:, 3] + (rank - row[:, 1]) // row[:, 4])

    placed = ranked.mapInPandas(run, f"{fields}, sequence_id bigint")
    before = (
        W.partitionBy("sequence_id")
        .orderBy(F.desc("length"), *order, "rank")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    return placed.withColumn("offset", offset).drop("rank", "part")
