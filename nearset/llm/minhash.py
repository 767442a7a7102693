"""Near-duplicate documents by MinHash.

1. A pass over the texts gives, per document, the size and a 128-bit hash of its
   shingle set, many minima of universal hashes, and from them band keys and a
   one-bit-per-minimum signature (b-bit minwise hashing, Li and Koenig, 2010).
2. Documents with equal sets are one node, named by their smallest id.
3. Round one links every node of a band bucket with the smallest node there.  The
   signatures of a link are compared; what may reach the threshold is confirmed on
   the full shingle sets.  Links give components by large-star and small-star.
4. Round two looks at buckets that still hold several components: pairs of nodes of
   different components, in blocks, again by signature and then on full sets.  Counts
   of the shingles of a set in CLASSES classes bound exactly what two sets can share;
   pairs below the threshold by that bound are not made.  So a bucket of near copies
   costs one link a node, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import ready, texts
from nearset.llm.components import connected_components
from nearset.runtime import write_once

MINIMA = 256
#: Chance that a pair just at the threshold meets in no bucket, at most.
MISSED = 1e-6
#: Nodes of a bucket that meet in one block of round two.
BLOCK = 256
#: Classes of shingles, whose counts bound what two sets share.
CLASSES = 128
_WORDS_KEPT = 1 << 20
_SEED = 20_240_229


def bands_for(threshold: float, minima: int = MINIMA) -> tuple[int, int]:
    """(bands, minima in a band): the longest bands that miss a pair with at most MISSED."""
    rows = 1
    for r in range(1, 17):
        if (1 - threshold**r) ** (minima // r) <= MISSED:
            rows = r
    return minima // rows, rows


def most_unequal(threshold: float, minima: int = MINIMA) -> int:
    """Signature bits in which a pair at the threshold differs, plus 4.5 deviations."""
    p = (1 - threshold) / 2
    return math.ceil(minima * p + 4.5 * math.sqrt(minima * p * (1 - p)))


class _Hashes(dict):
    """64-bit hashes of words, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _odd(rng: np.random.Generator, n: int, kind: type) -> np.ndarray:
    top = np.iinfo(kind).max
    return rng.integers(0, top, n, dtype=kind, endpoint=True) | kind(1)


class Shingler:
    """Distinct hashed shingles of a text: sorted 64-bit numbers.

    Only A-Z are lower-cased and words are cut at ASCII white space; ``bytes`` does
    both.  A text of fewer words is one shingle, a text without words has none.
    """

    def __init__(self, words: int):
        self.words = words
        self.factors = _odd(np.random.default_rng(_SEED), words, np.uint64)
        self.hashes = _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        k = min(n, self.words)
        mixed = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            mixed += h[i : n - k + 1 + i] * self.factors[i]
        return np.unique(_mix(mixed))


class Minima:
    """Smallest values of ``a * x + b`` over a set, and band keys and bits of them."""

    def __init__(self, minima: int, bands: int, rows: int):
        rng = np.random.default_rng(_SEED + 1)
        self.a = _odd(rng, minima, np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, minima, dtype=np.uint32)[:, None]
        self.bands, self.rows = bands, rows
        self.factors = _odd(rng, rows, np.uint64)
        self.own = _odd(rng, bands, np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(least, (self.a * x[None, i : i + 2048] + self.b).min(axis=1), out=least)
        in_bands = least[: self.bands * self.rows].reshape(self.bands, self.rows)
        keys = _mix((in_bands.astype(np.uint64) + np.uint64(1)) @ self.factors + self.own)
        bits = ((least * np.uint32(2_654_435_761)) >> np.uint32(16)) & np.uint32(1)
        return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _profiles(words: int, minima: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, hasher = Shingler(words), Minima(minima, bands, rows)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingler(text)
                if not len(s):
                    out.append((doc_id, 0, 0, 0, None, None))
                    continue
                whole = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                keys, bits = hasher(s)
                out.append((doc_id, len(s), int(whole[0]), int(whole[1]), bits, keys))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "h1", "h2", "bits", "bands"])
            yield frame.astype({"doc_id": "Int64"})

    return run


def profiles(docs: DataFrame, words: int, minima: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bits, bands) of every text; null lists without words."""
    ready(docs.sparkSession)
    schema = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bits array<bigint>, bands array<bigint>"
    return docs.mapInPandas(_profiles(words, minima, bands, rows), schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles, classes): the whole sorted set of each text, and how many of it in each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(text) for text in batch["text"]]
            classes = [np.bincount(s.astype(np.int64) & (CLASSES - 1), minlength=CLASSES) for s in sets]
            lists = [s.view(np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": lists, "classes": classes})

    return docs.mapInPandas(run, "doc_id bigint, shingles array<bigint>, classes array<int>")


def _unequal_bits(a: str, b: str, longs: int) -> Column:
    one = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)]
    return sum(one[1:], one[0])


def _may_link(nodes_a: str, nodes_b: str, threshold: float, minima: int) -> Column:
    """Sizes and signatures allow the threshold."""
    na, nb = F.col(f"{nodes_a}.n"), F.col(f"{nodes_b}.n")
    sizes = F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold - 1e-9)
    bits = _unequal_bits(f"{nodes_a}.bits", f"{nodes_b}.bits", minima // 64)
    return sizes & (bits <= most_unequal(threshold, minima))


def sets_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets of ``nodes`` (doc_id), written once; only their texts are cut again."""
    wanted = write_once(nodes.distinct(), "wanted")
    return write_once(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), words), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have 100 * shared >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("shared", shared)
        .where(F.col("shared") * 100 >= union * percent)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    minima: int = MINIMA,
    block: int = BLOCK,
) -> DataFrame:
    """Components of near copies: (doc_id, n_shingles, component_id, kept), a row per document.

    Documents are linked when 100 * shared >= percent * union over their distinct
    ``words``-word shingles.  ``component_id`` is the smallest id reachable and
    ``kept`` marks the document of that id.

    Null and empty texts have no shingles and link with nothing.  A row without an
    id links with nothing, has no component and is kept.  Rows that share an id are
    one node: what links one of them links all.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    threshold = percent / 100
    bands, rows = bands_for(threshold, minima)
    docs = texts(docs, id_col, text_col)
    seen = write_once(profiles(docs, words, minima, bands, rows), "profiles")

    # one node for equal sets
    usable = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "n_shingles", "bits", "bands"))
    copies = usable.groupBy("h1", "h2").agg(first.alias("first"))
    nodes = write_once(
        copies.select(
            "h1",
            "h2",
            F.col("first.doc_id").alias("node"),
            F.col("first.n_shingles").alias("n"),
            F.col("first.bits").alias("bits"),
            F.col("first.bands").alias("bands"),
        ),
        "nodes",
    )
    node_texts = docs.where(F.col("doc_id").isNotNull())
    # an id that names several sets is one node through its rows
    several = usable.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    several = write_once(several.where("low < high").select("doc_id"), "several")
    held = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    about = nodes.select("node", "n", "bits")

    # round one: a star in each bucket
    shared = held.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    shared = write_once(shared.where("a < z").select("bucket", "a"), "buckets")
    in_buckets = write_once(held.join(shared, "bucket").select("bucket", "band", "a", "node"), "held")
    stars = in_buckets.where("node > a").select("a", F.col("node").alias("b")).distinct()
    stars = (
        stars.join(about.alias("x"), F.col("a") == F.col("x.node"))
        .join(about.alias("y"), F.col("b") == F.col("y.node"))
        .where(_may_link("x", "y", threshold, minima))
        .select("a", "b")
    )
    stars = write_once(stars, "pairs")
    ends = stars.select(F.col("a").alias("doc_id")).unionAll(stars.select(F.col("b").alias("doc_id")))
    links = write_once(confirmed(stars, sets_of(ends, node_texts, words), percent), "links")
    found = write_once(connected_components(links), "components")

    # round two: what is still apart in a bucket
    placed = in_buckets.join(found, "node", "left").select(
        "bucket", "band", "node", F.coalesce("component", "node").alias("component")
    )
    placed = write_once(placed, "placed")
    apart = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    )
    apart = write_once(apart.where("low < high").select("bucket", "size"), "apart")
    n_blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    inside = write_once(placed.join(apart, "bucket"), "inside")
    sets = sets_of(inside.select(F.col("node").alias("doc_id")), node_texts, words)
    classes = sets.join(several, "doc_id", "left_anti").select(
        F.col("doc_id").alias("node"), "classes"
    )
    counted = nodes.join(classes.dropDuplicates(["node"]), "node", "left")
    inside = (
        inside.join(counted.select("node", "n", "bits", "bands", "classes"), "node")
        .withColumn("blocks", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    mine = ["bucket", "band", "node", "component", "n", "bits", "bands", "classes", "block"]
    meeting = inside.select(*mine, other).select(
        *mine, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    meeting = write_once(meeting, "meeting")
    x, y = meeting.alias("x"), meeting.alias("y")
    together = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.i") == F.col("y.i"))
        & (F.col("x.j") == F.col("y.j"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component"))
        # a pair of one block meets in that block's own key only
        & ((F.col("x.block") != F.col("y.block")) | (F.col("x.i") == F.col("x.j")))
    )
    # two sets share no more than the smaller count of each class
    fewer = F.zip_with("x.classes", "y.classes", lambda p, q: F.least(p, q))
    most = F.aggregate(fewer, F.lit(0), lambda total, k: total + k)
    enough = F.coalesce(most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent, F.lit(True))
    # the first bucket that two nodes share makes their pair
    first_here = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")
    crossing = (
        x.join(y, together & _may_link("x", "y", threshold, minima) & first_here & enough)
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    more = write_once(confirmed(write_once(crossing, "pairs"), sets, percent), "links")
    named = usable.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node")
    twice = named.join(several, "doc_id", "left_semi")
    twice = twice.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    if not more.unionAll(twice).isEmpty():
        found = write_once(connected_components(links.unionAll(more).unionAll(twice)), "components")

    labelled = nodes.join(found, "node", "left").select(
        "h1", "h2", F.coalesce("component", "node").alias("component")
    )
    labelled = write_once(labelled, "labelled")
    result = seen.select("doc_id", "n_shingles", "h1", "h2").join(labelled, ["h1", "h2"], "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    # without shingles no label may come by a chance equality of hashes
    component = F.when(F.col("n_shingles") > 0, whole).otherwise(F.col("doc_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
