"""Texts to token ids with the tokenizers library, fast enough for whole corpora.

The library is asked once for each distinct chunk of text that a worker meets.  Both
kinds of vocabulary cut a text into pieces before merging bytes, and a piece never
reaches over the places where chunks are cut here:

* byte-level vocabularies start a new piece at a space between two characters that
  are not white space, and a line end between two such characters is its own piece;
* vocabularies that drop white space have no piece with white space in it.

Texts with other white space or with characters outside Latin go to the library as
they are, so the ids are always those of the library.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the chunks a worker keeps may take, at most.
KEPT_BYTES = 96 << 20
#: What one chunk takes besides its characters and ids: two objects and a place in the dictionary.
_ENTRY_BYTES = 200
#: Bytes of text that are encoded together: the more, the fewer look-ups.
TOGETHER = 1 << 23
#: Before the first chunk of a text, and before a run of marks: signs that no chunk has.
_START, _MARKS = "\0", "\1"
_UNUSUAL = re.compile(r"[^\n\x20-\x7e¡-įı-ɏ]")
#: What comes before a word, the word, and marks after it, without the apostrophe.
_WORD = re.compile(r"([\0\n]?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: Fixed value: the pieces of vocabularies that drop white space.
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

def _byte_signs() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: itself where it prints, else a sign from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


class Encoder(dict):
    """``encode(texts)`` gives the ids of texts.

    As a dictionary it maps a chunk to its ids, as little-endian unsigned 32-bit
    numbers.  Chunks met since the dictionary was last half full stay when it is half
    full again, so the chunks kept never take more than KEPT_BYTES.  Strings of special
    tokens in a text are ordinary text unless ``special_tokens``.
    """

    def __init__(self, path: str, special_tokens: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        self.special = [t["content"] for t in spec["added_tokens"]] if special_tokens else []
        before = spec.get("pre_tokenizer") or {}
        steps = [x["type"] for x in before.get("pretokenizers", [])]
        self.byte_level = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
        )
        # pieces that a pattern without white space finds; the rest is removed
        self.drops_space = steps == ["Split", "ByteLevel"] and (
            before["pretokenizers"][0].get("invert") and before["pretokenizers"][0]["behavior"] == "Removed"
        )
        # a word and the marks after it are pieces, which the model can be asked for directly
        self.cuts_words = self.byte_level or (
            self.drops_space and before["pretokenizers"][0]["pattern"].get("Regex") == _DROPPING
        )
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.taken = 0

    def _holds_special(self, text: str) -> bool:
        # the library may look for them after it has put a text in lower case
        low = text.lower()
        return any(s in text or s in low for s in self.special)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array.array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _ids(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the model alone."""
        if piece.isascii():
            signs = piece.replace(" ", _BYTE_SIGNS[32])
        else:
            signs = piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return self._bytes([t.id for t in self.model.tokenize(signs)])

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            m = _WORD.fullmatch(chunk) if self.cuts_words else None
            if m and m[3]:
                return self[m[1] + m[2]] + self[_MARKS + m[3]]
            if m and m[1] == "\n":
                return self["\n"] + self[_START + m[2]]
            if m:
                ids = self._piece(m[2] if m[1] or self.drops_space else " " + m[2])
            elif not chunk:
                ids = b""
            elif chunk[0] == _MARKS:
                ids = self._piece(chunk[1:])
            elif chunk[0] == _START:
                ids = self._ids(chunk[1:])
            elif self.byte_level and chunk[0] != "\n":
                ids = self._ids(" " + chunk)
            else:
                ids = self._ids(chunk)
        self.taken += len(chunk) + len(ids) + _ENTRY_BYTES
        if 2 * self.taken > KEPT_BYTES:
            self.older = dict(self)
            self.clear()
            self.taken = 0
        self[chunk] = ids
        return ids

    def _prepared(self, text: str) -> str | None:
        """The text with a space before each chunk but the first; None if the library must take it whole."""
        if _UNUSUAL.search(text) or self.special and self._holds_special(text):
            return None
        if self.drops_space:
            return text.lower().replace("\n", " ")
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if not self.byte_level or runs or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            return None if text else ""
        return (_START + text.replace("\n", " \n")) if text else ""

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; ``end_id`` ends each text.

        Chunks are looked up once for a call, however often they come in it.
        """
        if not texts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        prepared = [self._prepared(t) for t in texts]
        lists = pc.split_pattern(pa.array([p or "" for p in prepared], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        parts = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        at = np.asarray(lists.offsets)[:-1]
        index = np.asarray(coded.indices)
        if None in prepared:
            # one entry more for each text that goes to the library whole
            index = index.copy()
            for i, p in enumerate(prepared):
                if p is None:
                    index[at[i]] = len(parts)
                    parts.append(self._ids(texts[i]))
        if end_id is not None:
            # the end is one entry more, after the last chunk of each text
            ends = np.asarray(lists.offsets)[1:]
            index = np.insert(index, ends, len(parts))
            parts.append(self._bytes([end_id]))
            at = at + np.arange(len(at))
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        starts = np.zeros(len(parts) + 1, np.int32)
        np.cumsum(size, out=starts[1:])
        held = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(parts), "<u4")))
        ids = held.take(pa.array(index)).flatten().to_numpy()
        return ids, np.add.reduceat(size[index], at).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], chars: int = TOGETHER) -> Iterator[pa.Table]:
    """Batches with ``text`` put together until they hold about ``chars`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= chars:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_tokens: bool = False) -> Encoder:
    """One encoder for a path in each worker process."""
    return Encoder(path, special_tokens)


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = None, special_tokens: bool = False
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows put together, the ids of their texts one after another, and how many each has.

    Chunks stay for the next task of the worker, within their bytes.
    """
    own = encoder(path, special_tokens)
    for table in gathered(batches):
        yield table, *own.encode(table.column("text").to_pylist(), end_id)
    pa.default_memory_pool().release_unused()
