"""Words of documents: counts, document frequencies and TF-IDF weights.

A document is one row with a unique id.  Words are rows: (doc_id, n_words, term).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearset.functions import text as T
from nearset.runtime import drop, write_once

# Characters of the runs that terms are found by.
_GRAM = 3
# Longest token that is cut into all its pieces.
_WHOLE = 64
# Bits of the filter of terms, for each term and at most.
_TERM_BITS, _FILTER_BITS = 16, 1 << 27


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _words(text: Column, on_whitespace: bool) -> Column:
    return F.array_remove(F.split(text, r"\s+" if on_whitespace else " "), "")


def _each_word(df: DataFrame, *keep: str) -> DataFrame:
    """One row per entry of ``words``: (*keep, term).

    The outer explode keeps Spark from testing every text for words beforehand,
    which would split each text twice.
    """
    exploded = df.select(*keep, F.explode_outer("words").alias("term"))
    return exploded.where(F.col("term").isNotNull())


def tokenize(
    docs: DataFrame,
    stop_words: Iterable[str] | None = None,
    drop_noise: bool = False,
    lower_first: bool = True,
    on_whitespace: bool = False,
) -> DataFrame:
    """Words of each document, one row per occurrence: (doc_id, n_words, term).

    Words are cut at single spaces, or at runs of whitespace with
    ``on_whitespace``.  ``n_words`` counts all words of the document; the rows
    are those, in lower case, that are not stop words and, with ``drop_noise``,
    not short or led by a digit.  ``lower_first=False`` looks words up in the
    stop list as written, so a capitalised stop word stays.
    """
    words = _words(F.lower("text") if lower_first else F.col("text"), on_whitespace)
    # count before exploding, once per document and not once per word
    split = docs.select("doc_id", words.alias("words")).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), "words"
    )
    return _kept(_each_word(split, "doc_id", "n_words"), stop_words, drop_noise, lower_first)


def _kept(tokens: DataFrame, stop_words, drop_noise: bool, lower_first: bool) -> DataFrame:
    """Without stop words and noise, in lower case."""
    term = F.col("term")
    if drop_noise:
        tokens = tokens.where(~T.is_noise(term))
    if stop_words is not None:
        tokens = tokens.where(~T.in_words(term, stop_words))
    return tokens if lower_first else tokens.withColumn("term", F.lower(term))


def words_per_document(docs: DataFrame) -> DataFrame:
    """Words of every document, also of those without any: (doc_id, n_words)."""
    words = F.size(_words(F.coalesce("text", F.lit("")), False))
    return docs.select("doc_id", words.cast("bigint").alias("n_words"))


def count_terms(
    docs: DataFrame,
    stop_words: Iterable[str] | None = None,
    drop_noise: bool = False,
    lower_first: bool = True,
) -> DataFrame:
    """Occurrences of each term in each document: (doc_id, n_words, term, cnt).

    A document is one row, so its words are sorted and counted inside the row, and
    nothing is shuffled.  Options as in ``tokenize``; a term that only differs in
    case from another is one term with it.  Ids must be unique.
    """
    words = _words(F.lower("text") if lower_first else F.col("text"), False)
    cut = docs.select("doc_id", words.alias("words"))
    n_words = F.size("words").cast("bigint").alias("n_words")
    if stop_words is not None or drop_noise:

        def stays(w: Column) -> Column:
            keep = F.lit(True)
            if drop_noise:
                keep = keep & ~T.is_noise(w)
            if stop_words is not None:
                keep = keep & ~T.in_words(w, stop_words)
            return keep

        held = F.filter("words", stays)
    else:
        held = F.col("words")
    if not lower_first:
        held = F.transform(held, lambda w: F.lower(w))
    held = cut.select("doc_id", n_words, F.sort_array(held).alias("held"))
    # where a run of equal words begins, and the end after the last
    n = F.size("held")
    begins = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (F.get("held", i) != F.get("held", i - 1))),
    )
    runs = held.select("doc_id", "n_words", "held", F.array_append(begins, n).alias("at"))
    k = F.size("at") - 1
    terms = F.zip_with(
        F.slice("at", F.lit(1), k),
        F.slice("at", F.lit(2), k),
        lambda i, j: F.struct(F.get("held", i).alias("term"), (j - i).cast("bigint").alias("cnt")),
    )
    counted = runs.select("doc_id", "n_words", F.explode_outer(terms).alias("x"))
    return counted.where("x IS NOT NULL").select("doc_id", "n_words", "x.term", "x.cnt")


def remove_stopwords(tokens: DataFrame, stop_words: DataFrame, column: str = "term") -> DataFrame:
    """Drop rows whose ``column`` is in a stop list held as a table (word)."""
    return tokens.join(stop_words.select(F.col("word").alias(column)), column, "left_anti")


def term_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences of each term in each document, from rows of words: (doc_id, n_words, term, cnt)."""
    return tokens.groupBy("doc_id", "n_words", "term").agg(F.count("*").alias("cnt"))


def word_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences of each term in the corpus, most frequent first: (term, cnt)."""
    return (
        tokens.groupBy("term").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "term")
    )


def doc_frequency(counts: DataFrame) -> DataFrame:
    """Documents per term, from the rows of ``term_counts``: (term, df)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select("term").distinct()


def _grams(text: Column) -> Column:
    """Distinct runs of ``_GRAM`` characters of ``text``, in time linear in its length."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    run = chars
    for n in range(2, _GRAM + 1):
        later = F.slice(chars, F.lit(n), F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        run = F.zip_with(run, later, lambda x, c: F.concat(x, c))  # null where the text has ended
    return F.array_distinct(F.filter(run, lambda x: x.isNotNull()))


def rarest_grams(terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """(gram, term): for each term the run of ``_GRAM`` characters that the fewest tokens hold.

    ``frequency`` is (gram, tokens); terms with a run that is not in it are left out, as no
    token holds them.
    """
    cut = terms.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    rarest = cut.join(frequency, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), "gram")).alias("least")
    )
    return rarest.where("least.tokens > 0").select("least.gram", "term")


def _filter_place(term: str, bits: int) -> tuple[Column, Column]:
    """Word of 64 bits and bit of a term in a filter of ``bits`` bits."""
    place = F.pmod(F.xxhash64(term), F.lit(bits))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def maybe_term(terms: DataFrame, most_bits: int = _FILTER_BITS) -> Column:
    """Whether ``term`` may be one of ``terms``; a few that are none pass, too.

    The filter is one bitmap of ``most_bits`` bits or less, whatever the number of terms.
    """
    bits = 64
    wanted = min(most_bits, _TERM_BITS * terms.count())
    while bits < wanted:
        bits *= 2
    word, bit = _filter_place("term", bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    held = terms.select(word.alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = terms.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"))
    dense = every.join(held, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    bitmap = write_once(dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bitmap")), "filter")
    return F.getbit(F.get(bitmap.scalar(), word), bit) == 1


def _pieces(tokens: DataFrame, longest: int, *keep: str, known: Column | None = None) -> DataFrame:
    """All pieces of up to ``longest`` characters: (*keep, term), each at its first place.

    ``known`` is a condition on ``term`` that pieces have to meet.
    """
    size = F.length("token")
    cut = tokens.select(*keep, "token", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("at") + 1))
    pieces = cut.select(*keep, "token", "at", F.explode(lengths).alias("length")).withColumn(
        "term", F.substring("token", F.col("at"), F.col("length"))
    )
    if known is not None:
        pieces = pieces.where(known)
    return pieces.where(F.instr("token", F.col("term")) == F.col("at")).select(*keep, "term")


def _inside_long(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term) for tokens whose pieces would be too many.

    An index holds each term under the rarest of its runs of ``_GRAM`` characters, a token
    is looked up with its own runs, and what is found is compared.  Terms that are shorter
    than a run are looked for among the characters of runs.  Rows grow with the length of
    the tokens, and a token travels once and not with each of its runs.
    """
    named = tokens.select(F.xxhash64("token").alias("key"), "token")
    runs = named.select("key", F.explode(_grams(F.col("token"))).alias("gram"))
    frequency = write_once(runs.groupBy("gram").agg(F.count("*").alias("tokens")), "grams")
    index = rarest_grams(terms.where(F.length("term") >= _GRAM), frequency)
    found = runs.join(write_once(index, "gram-index"), "gram").select("key", "term")
    # a token is longer than a run, so its shorter pieces are all in runs
    shorter = _pieces(runs.withColumnRenamed("gram", "token"), _GRAM - 1, "key")
    tiny = write_once(terms.where(F.length("term").between(1, _GRAM - 1)), "short-terms")
    found = found.unionByName(shorter.join(tiny, "term").select("key", "term").distinct())
    return named.join(found, "key").where(F.contains(F.col("token"), F.col("term"))).select("token", "term")


def contained_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Which terms occur inside which tokens: (token, term, matches).

    ``tokens`` (token) and ``terms`` (term) are distinct.  Tokens of up to ``_WHOLE``
    characters are cut into all their pieces; those that a filter of the terms lets pass
    are joined with the terms.  Longer ones are looked up in an index of the terms' rarest
    runs.
    """
    size = F.length("token")
    whole = tokens.where(size.between(1, _WHOLE)).withColumn("whole", F.col("token"))
    short = _pieces(whole, _WHOLE, "whole", known=maybe_term(terms))
    inside = short.join(terms, "term").select(F.col("whole").alias("token"), "term")
    long = tokens.where(size > _WHOLE)
    if not long.isEmpty():
        inside = inside.unionByName(_inside_long(long, terms))
    return inside.select("token", "term", T.count_matches(F.col("token"), F.col("term")).alias("matches"))


def _terms_inside(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``contained_terms`` in one row for each token: (token, inside), as text ``matches:term matches:term ...``.

    For tokens and terms without spaces.  A text takes less room than an array when it is shuffled
    with each occurrence of its token.  Written, so that a frequent token is split over tasks.
    """
    found = contained_terms(tokens, terms).select("token", F.concat_ws(":", "matches", "term").alias("entry"))
    return write_once(found.groupBy("token").agg(F.array_join(F.collect_list("entry"), " ").alias("inside")), "inside")


def _each_inside(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per entry of ``inside``: (*keep, term, matches)."""
    entry = rows.select(*keep, F.explode(F.split("inside", " ")).alias("entry"))
    colon = F.instr("entry", F.lit(":"))
    return entry.select(
        *keep,
        F.substr("entry", colon + 1).alias("term"),
        F.substr(F.col("entry"), F.lit(1), colon - 1).cast("bigint").alias("matches"),
    )


def substring_counts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Like ``term_counts``, but a term also counts inside longer words.

    No term holds a space, so its non-overlapping occurrences in the lower-cased
    text are those in the single words, summed.
    """
    words = write_once(count_terms(docs), "words").select("doc_id", F.col("term").alias("token"), "cnt")
    # written, so that the joins with them are planned by their size
    all_words = write_once(words.select("token").distinct(), "tokens")
    inside = _terms_inside(all_words, write_once(vocabulary(counts), "terms"))
    # an id that repeats has the sums of all its rows, once for each row of ``counts``
    repeats = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    held = F.array_compact(F.array(F.max("n_words"))) if repeats.isEmpty() else F.collect_list("n_words")
    # the rows of ``counts`` go along as terms that match nowhere, and only they have n_words
    own = F.concat(F.lit("0:"), "term")
    found = words.join(inside, "token").select(
        "doc_id", F.lit(None).cast("bigint").alias("n_words"), "cnt", "inside"
    )
    sought = counts.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("cnt"), own.alias("inside"))
    # terms travel as one text to their document; there they are counted without another shuffle
    by_doc = found.unionByName(sought).where(F.col("doc_id").isNotNull()).repartition("doc_id")
    summed = _each_inside(by_doc, "doc_id", "n_words", "cnt").groupBy("doc_id", "term").agg(
        F.sum(F.col("cnt") * F.col("matches")).alias("cnt"), held.alias("held")
    )
    return summed.where((F.size("held") > 0) & (F.col("cnt") > 0)).select(
        "doc_id", F.explode("held").alias("n_words"), "term", "cnt"
    )


def incidence(docs: DataFrame, mode: str = "token") -> DataFrame:
    """Documents and the vocabulary terms they hold: (doc_id, term), each pair once.

    ``"substring"`` also counts a term that occurs inside a longer word.
    """
    if mode not in ("token", "substring"):
        raise ValueError(f"unknown incidence mode: {mode!r}")
    words = F.array_distinct(_words(F.lower("text"), on_whitespace=True))
    held = _each_word(docs.select("doc_id", words.alias("words")), "doc_id")
    if mode == "token":
        return held
    terms = write_once(vocabulary(held), "terms")
    inside = _terms_inside(terms.withColumnRenamed("term", "token"), terms)
    found = held.withColumnRenamed("term", "token").join(inside, "token")
    # terms travel as one text to their document; there they are made distinct without another shuffle
    by_doc = found.select("doc_id", "inside").repartition("doc_id")
    return _each_inside(by_doc, "doc_id").select("doc_id", "term").distinct()


def incidence_vectors(docs: DataFrame, pairs: DataFrame, terms: list[str]) -> DataFrame:
    """Dense 0/1 vectors over a given small vocabulary: (doc_id, vector ARRAY<INT>).

    Every document of ``docs`` has one, also those that hold none of the terms.
    """
    held = pairs.where(T.in_words(F.col("term"), terms)).groupBy("doc_id").agg(F.collect_set("term").alias("held"))
    has = [F.coalesce(F.array_contains("held", F.lit(t)), F.lit(False)).cast("int") for t in terms]
    return docs.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.array(*has).alias("vector"))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"))


def _with_most(counts: DataFrame) -> DataFrame:
    """Add ``max_cnt``, the count of the most frequent term of the document."""
    return counts.withColumn("max_cnt", F.max("cnt").over(W.partitionBy("doc_id")))


def tf_idf(
    docs: DataFrame,
    weighting: str = "standard",
    count_mode: str = "token",
    stop_words: Iterable[str] | None = None,
    drop_noise: bool = False,
    lower_first: bool = True,
) -> DataFrame:
    """Term weights per document: (doc_id, term, cnt, weight).

    ``"standard"``   cnt / n_words * ln(N / df)
    ``"reference"``  floor(cnt / max cnt of the document) / floor(N / df)
    ``count_mode``   "token" counts whole words, "substring" also inside words.
    """
    if weighting not in ("standard", "reference") or count_mode not in ("token", "substring"):
        raise ValueError(f"unknown weighting or count mode: {weighting!r}, {count_mode!r}")
    # the words are cut once; frequencies are written before they are joined, so that a
    # word of every document is split over tasks
    tokens = write_once(count_terms(docs, stop_words, drop_noise, lower_first), "counts")
    frequency = write_once(doc_frequency(tokens), "frequency")
    counts = tokens if count_mode == "token" else substring_counts(docs, tokens)
    if count_mode == "substring":
        # written with all that is counted by document, so that the words inside words are gone from
        # disk before the counts meet their frequencies
        if weighting == "reference":
            counts = _with_most(counts)
        counts = write_once(counts, "inside-counts")
        drop(tokens)
    n_docs = write_once(document_count(docs), "documents").scalar()
    cnt, df = F.col("cnt"), F.col("df")
    if weighting == "standard":
        weight = T.standard_weight(cnt, F.col("n_words"), n_docs, df)
    else:
        if count_mode == "token":
            counts = _with_most(counts)
        weight = T.floor_weight(cnt, F.col("max_cnt"), n_docs, df)
    # there are far fewer terms than counts: they are hashed, where a merge would sort all counts
    return counts.join(frequency.hint("shuffle_hash"), "term").select(
        "doc_id", "term", "cnt", weight.alias("weight")
    )


def weight_maps(weights: DataFrame) -> DataFrame:
    """One row per document: (doc_id, weights MAP<STRING, DOUBLE>), terms in order."""
    entries = F.sort_array(F.collect_list(F.struct("term", "weight")))
    return weights.groupBy("doc_id").agg(F.map_from_entries(entries).alias("weights"))


def render_documents(weights: DataFrame) -> DataFrame:
    """Text form ``id: {term=weight, ...}``, terms in order, nine decimals: (doc_id, line)."""

    def entry(x: Column) -> Column:
        digits = F.format_string("%.9f", F.round(x["weight"], 9))
        return F.struct(x["term"].alias("term"), F.concat(x["term"], F.lit("="), digits).alias("text"))

    # numbers travel to their document and become text there
    held = F.collect_list(F.struct("term", "weight"))
    entries = F.transform(F.sort_array(F.transform(held, entry)), lambda x: x["text"])
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": {"), F.array_join("entries", ", "), F.lit("}"))
    return weights.groupBy("doc_id").agg(entries.alias("entries")).select("doc_id", line.alias("line"))


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as sets of lower-cased words: (doc_id, term), each once."""
    words = docs.select("doc_id", F.array_distinct(_words(F.lower("text"), False)).alias("words"))
    return _each_word(words, "doc_id")
