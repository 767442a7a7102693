"""Registered queries and the SQL each is compared with.

``queries()`` runs every operator over whole tables: orders as sets of parts
(``lineitem``), documents as sets of words (``documents``).  ``oracle_sql()`` holds
plain SQL for the same results; similar pairs are checked against a join of all
sets on their items, without any of the pruning the library does.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from nearset.operators import itemsets, simjoin, stats, text  # noqa: E402
from nearset.operators.signatures import (  # noqa: E402
    Scheme,
    make_signatures,
    prefix_rows,
    rank_items,
    rarest_items,
)
from nearset.plans import programs  # noqa: E402
from nearset.runtime import shared_folder  # noqa: E402
from nearset.sources import readers, writers  # noqa: E402

try:
    import corpus_pipeline
    from nearset.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    # without the subpackage its queries are not registered; other failures count
    if missing.name not in ("corpus_pipeline", "nearset.llm"):
        raise
    llm_queries = None

# a short stop list over the languages of the documents
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "der", "die", "und"]

# task bounds that documents reach already in the small tables
SMALL = {"split_rows": 1500, "hot_rows": 16, "block_rows": 16}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_of_parts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


def _rows(spark, sf_dir) -> DataFrame:
    return itemsets.item_rows(_orders_of_parts(spark, sf_dir), "l_orderkey", "l_partkey")


def _unique_rows(spark, sf_dir) -> DataFrame:
    return _rows(spark, sf_dir).distinct()


def _docs(spark, sf_dir) -> DataFrame:
    return text.documents(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _join(threshold: float, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        df = _orders_of_parts(spark, sf_dir)
        return simjoin.similarity_join(df, "l_orderkey", "l_partkey", threshold, **options)

    return query


def _signatures(threshold: float, size: int, mode: str | None = None):
    def query(spark, sf_dir):
        return make_signatures(rank_items(_rows(spark, sf_dir)), Scheme(threshold, size, mode))

    return query


def _prefix(order: str):
    def query(spark, sf_dir):
        scheme = Scheme(0.5, order=order)
        return prefix_rows(rank_items(_rows(spark, sf_dir), order), scheme)

    return query


def _classes(threshold: float, mode: str):
    def query(spark, sf_dir):
        sizes = itemsets.set_sizes(_unique_rows(spark, sf_dir))
        scheme = Scheme(threshold, length_classes=mode)
        return sizes.select("set_id", "n", F.explode(scheme.classes(F.col("n"))).alias("class"))

    return query


def _item_sets(spark, sf_dir):
    sets = itemsets.to_sets(_rows(spark, sf_dir))
    return sets.select("set_id", "chunk", F.concat_ws(";", "items").alias("items"), "n_items")


def _word_sets(spark, sf_dir):
    """Documents as sets of words, the longest in several chunks."""
    words = itemsets.item_rows(text.document_items(_docs(spark, sf_dir)), "doc_id", "term")
    sets = itemsets.to_sets(words, SMALL["split_rows"])
    return sets.select("set_id", "chunk", F.concat_ws(" ", "items").alias("items"), "n_items")


def _bucket_sizes(spark, sf_dir):
    return stats.bucket_sizes(_signatures(0.5, 1)(spark, sf_dir))


def _shared_signatures(spark, sf_dir):
    return stats.shared_signatures(_signatures(0.5, 2)(spark, sf_dir))


def _similar_groups(spark, sf_dir):
    df = _orders_of_parts(spark, sf_dir)
    return simjoin.similar_groups(df, "l_orderkey", "l_partkey", 0.5)[0]


def _set_groups(spark, sf_dir):
    return simjoin.set_groups(_unique_rows(spark, sf_dir))


def _join_stats(threshold: float, size: int, mode: str | None = None):
    def query(spark, sf_dir):
        df = _orders_of_parts(spark, sf_dir)
        return stats.join_stats(df, "l_orderkey", "l_partkey", threshold, size, mode)

    return query


def _counters(spark, sf_dir):
    bag = stats.pair_counts(_join(0.3, distinct=False)(spark, sf_dir))
    names = ["emitted", "distinct_pairs"]
    return stats.sum_counters(stats.as_counters(bag, names))


def _pair_counts(spark, sf_dir):
    return stats.pair_counts(_join(0.3, distinct=False)(spark, sf_dir))


def _with_records(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    pairs = _join(0.9)(spark, sf_dir)
    return simjoin.attach_records(pairs, orders, "o_orderkey", ["o_custkey", "o_orderstatus"])


def _preview(spark, sf_dir):
    freq = itemsets.item_frequency(_unique_rows(spark, sf_dir))
    return writers.preview(freq, "df", "item")


def _duplicates(threshold: float, **bounds):
    def query(spark, sf_dir):
        docs = _table(spark, sf_dir, "documents")
        return programs.near_duplicate_documents(docs, "doc_id", "text", threshold, **bounds)

    return query


def _rarest_words(spark, sf_dir):
    words = itemsets.item_rows(text.document_items(_docs(spark, sf_dir)), "doc_id", "term")
    return rarest_items(rank_items(words, unique=True), 3).select(
        F.col("set_id").alias("doc_id"), F.col("item").alias("term"), "df", "rk"
    )


def _rarest_word_duplicates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return programs.duplicates_by_rarest_words(docs, "doc_id", "text", 3, 0.8)


def _words(**options):
    return lambda spark, sf_dir: text.tokenize(_docs(spark, sf_dir), **options)


def _weights(**options):
    def query(spark, sf_dir):
        weights = text.tf_idf(_docs(spark, sf_dir), **options)
        return weights.withColumn("weight", F.round("weight", 9))

    return query


def _rendered(spark, sf_dir):
    return text.render_documents(_weights()(spark, sf_dir))


def _incidence(mode: str):
    return lambda spark, sf_dir: text.incidence(_docs(spark, sf_dir), mode)


def _incidence_vectors(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    vectors = text.incidence_vectors(docs, text.incidence(docs), STOP_WORDS)
    return vectors.select("doc_id", F.concat_ws("", "vector").alias("vector"))


def _new_path(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _ratings(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("user"),
        F.col("l_partkey").alias("movie"),
        F.col("l_linenumber").alias("rating"),
    )


def _rating_files(spark, sf_dir):
    path = _new_path(spark)
    writers.write_bucketed(_ratings(spark, sf_dir), path)
    return readers.read_ratings(spark, f"{path}/*", with_rating=True, kind="bigint")


def _write_item_files(spark, sf_dir) -> str:
    """Ratings as blocks ``movie:`` with lines ``user,rating``, each block in one file."""
    path = _new_path(spark)
    ratings = _ratings(spark, sf_dir)
    header = F.concat(F.col("movie").cast("string"), F.lit(":"))
    lines = (
        ratings.select("movie").distinct().select("movie", F.lit(0).alias("kind"), header.alias("value"))
    ).unionByName(
        ratings.select("movie", F.lit(1).alias("kind"), F.concat_ws(",", "user", "rating").alias("value"))
    )
    ordered = lines.repartitionByRange("movie").sortWithinPartitions("movie", "kind")
    ordered.select("value").write.text(path)
    return path


def _item_files(spark, sf_dir):
    path = _write_item_files(spark, sf_dir)
    return readers.read_item_files(spark, path, kind="bigint")


def _transposed_files(spark, sf_dir):
    path, target = _write_item_files(spark, sf_dir), _new_path(spark)
    programs.transpose_item_files(spark, path, target)
    ratings = spark.read.schema("user bigint, movie bigint, rating int").csv(target)
    return ratings.groupBy("bucket").agg(
        F.count("*").alias("n_ratings"), F.countDistinct("user").alias("n_users")
    )


def _started_empty(spark, sf_dir):
    """Rating files added one after another to an empty table."""
    path = _new_path(spark)
    writers.write_bucketed(_ratings(spark, sf_dir), path, buckets=2)
    ratings = readers.empty_ratings(spark)
    for bucket in (0, 1):
        ratings = ratings.unionByName(readers.read_ratings(spark, f"{path}/bucket={bucket}"))
    return ratings.groupBy("user").agg(F.count("*").alias("n_ratings"))


def _statistics_files(make, schema: str):
    """Statistics written to files and read back."""

    def query(spark, sf_dir):
        path = _new_path(spark)
        writers.write_stats(make(spark, sf_dir), path)
        return spark.read.schema(schema).csv(path)

    return query


def _stop_words_from_file(spark, sf_dir):
    path = _new_path(spark)
    spark.createDataFrame([(w,) for w in STOP_WORDS], "value string").write.text(path)
    tokens = text.remove_stopwords(_words()(spark, sf_dir), readers.read_stop_words(spark, path))
    return text.word_counts(tokens)


def _abstract_weights(spark, sf_dir):
    """Weights of abstracts from a file of statements and comment lines, by subject."""
    path = _new_path(spark)
    lines = _triple_lines(spark, sf_dir)
    comments = _table(spark, sf_dir, "documents").select(F.concat(F.lit("# "), "source").alias("value"))
    lines.unionAll(comments.distinct()).write.text(path)
    weights = programs.abstract_weights(spark, path)
    return weights.select("subject", "term", "cnt", F.round("weight", 9).alias("weight"))


def _bucketed_users(spark, sf_dir):
    users = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), "o_orderkey")
    return writers.bucketed(users).groupBy("bucket").agg(F.count("*").alias("n_orders"))


def _triple_lines(spark, sf_dir) -> DataFrame:
    literal = F.col("text")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        literal = F.replace(literal, F.lit(plain), F.lit(escaped))
    return _table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("<http://example.org/"),
            F.col("doc_id").cast("string"),
            F.lit('> <http://example.org/abstract> "'),
            literal,
            F.lit('"@'),
            F.col("lang"),
            F.lit(" ."),
        ).alias("value")
    )


def _triples(mode: str):
    def query(spark, sf_dir):
        path = _new_path(spark)
        _triple_lines(spark, sf_dir).write.text(path)
        return readers.read_ntriples(spark, path, mode)

    return query


_XSD = "http://www.w3.org/2001/XMLSchema#integer"


def _statements(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Statements of all kinds of objects in one file, with lines that are no statements."""
    path = _new_path(spark)
    docs = _table(spark, sf_dir, "documents")
    subject = F.format_string("<http://example.org/%d> ", "doc_id")
    escapes = F.format_string("\"\\u00e9%d \\U0001F600\\t\\\\u0041\" .", "doc_id")
    lines = _triple_lines(spark, sf_dir)
    for line in (
        F.concat(subject, F.lit("<http://example.org/from> <http://example.org/"), "lang", F.lit("> .")),
        F.concat(subject, F.lit("<http://example.org/size> "), F.format_string(f'"%d"^^<{_XSD}> . # counted', "n_chars")),
        F.concat(F.format_string("_:d%d ", "doc_id"), F.lit("<http://example.org/of> "), F.format_string("_:e%d.", "doc_id")),
        F.concat(subject, F.lit("<http://example.org/signs> "), escapes),
        F.concat(subject, F.lit("<http://example.org/none> no object .")),
    ):
        lines = lines.unionAll(docs.select(line.alias("value")))
    lines.write.text(path)
    return readers.read_statements(spark, path)


def _pair_files(fmt: str):
    def query(spark, sf_dir):
        path = _new_path(spark)
        writers.write_pairs(_join(0.9)(spark, sf_dir), path, fmt)
        if fmt == "text":
            return spark.read.text(path)
        schema = "id_a bigint, id_b bigint, overlap int, jaccard double"
        return spark.read.schema(schema).format(fmt).load(path)

    return query


def _similar_users(spark, sf_dir):
    path = _new_path(spark)
    writers.write_bucketed(_ratings(spark, sf_dir), path, buckets=16)
    return programs.similar_users(spark, f"{path}/*", 0.5, kind="bigint")


def entry(spark: SparkSession) -> DataFrame:
    """Pairs of orders whose part sets have a Jaccard similarity of at least 0.5."""
    return _join(0.5)(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sets
        "item_frequency": lambda s, d: itemsets.item_frequency(_unique_rows(s, d)),
        "frequency_histogram": lambda s, d: itemsets.frequency_histogram(_unique_rows(s, d)),
        "set_sizes": lambda s, d: itemsets.set_sizes(_unique_rows(s, d)),
        "item_sets": _item_sets,
        "word_sets_in_chunks": _word_sets,
        "set_groups": _set_groups,
        "first_items": _preview,
        # order, prefixes, signatures
        "ranked_prefix": _prefix("frequency"),
        "ranked_prefix_by_item": _prefix("item"),
        "length_classes": _classes(0.5, "reference"),
        "length_classes_complete": _classes(0.3, "complete"),
        "signatures_k1": _signatures(0.5, 1),
        "signatures_k2": _signatures(0.5, 2),
        "signatures_k3": _signatures(0.5, 3),
        "signatures_k2_classes": _signatures(0.5, 2, "reference"),
        "bucket_sizes": _bucket_sizes,
        "shared_signatures_k2": _shared_signatures,
        # joins
        "similarity_join_t90": _join(0.9),
        "similarity_join_t50": _join(0.5),
        "similarity_join_t30": _join(0.3),
        "similarity_join_by_item_t50": _join(0.5, order="item"),
        "similarity_join_k2_t50": _join(0.5, signature_size=2),
        "similarity_join_k3_t30": _join(0.3, signature_size=3),
        "similarity_join_classes_t30": _join(0.3, length_classes="reference"),
        "similarity_join_complete_classes_t30": _join(0.3, length_classes="complete"),
        "similarity_join_bag_t30": _join(0.3, distinct=False),
        "similarity_join_adaptive_t50": _join(0.5, adaptive=True),
        "similarity_join_adaptive_t30": _join(0.3, adaptive=True),
        "similar_groups_t50": _similar_groups,
        "similar_with_records": _with_records,
        # statistics
        "join_stats_t50": _join_stats(0.5, 1),
        "join_stats_k2_t50": _join_stats(0.5, 2),
        "join_stats_classes_t30": _join_stats(0.3, 1, "reference"),
        "pair_counts_t30": _pair_counts,
        "counters_t30": _counters,
        # text
        "word_counts": lambda s, d: text.word_counts(_words()(s, d)),
        "word_counts_without_stop_words": lambda s, d: text.word_counts(
            _words(stop_words=STOP_WORDS, drop_noise=True)(s, d)
        ),
        "word_counts_as_written": lambda s, d: text.word_counts(
            _words(stop_words=STOP_WORDS, drop_noise=True, lower_first=False)(s, d)
        ),
        "vocabulary": lambda s, d: text.vocabulary(_words()(s, d)),
        "document_count": lambda s, d: text.document_count(_docs(s, d)),
        "words_per_document": lambda s, d: text.words_per_document(_docs(s, d)),
        "term_counts": lambda s, d: text.count_terms(_docs(s, d)),
        "doc_frequency": lambda s, d: text.doc_frequency(text.count_terms(_docs(s, d))),
        "word_counts_without_stop_file": _stop_words_from_file,
        "abstract_weights": _abstract_weights,
        "incidence": _incidence("token"),
        "incidence_substring": _incidence("substring"),
        "incidence_vectors": _incidence_vectors,
        "tf_idf_standard": _weights(),
        "tf_idf_stop_words": _weights(stop_words=STOP_WORDS, drop_noise=True),
        "tf_idf_reference": _weights(
            weighting="reference",
            count_mode="substring",
            stop_words=STOP_WORDS,
            drop_noise=True,
            lower_first=False,
        ),
        "rendered_documents": _rendered,
        # documents as sets
        "document_near_duplicates_t90": _duplicates(0.9),
        "document_near_duplicates_t50": _duplicates(0.5),
        "document_near_duplicates_adaptive_t90": _duplicates(0.9, adaptive=True),
        "document_near_duplicates_t90_small_blocks": _duplicates(0.9, **SMALL),
        "rarest_words": _rarest_words,
        "rarest_words_candidates": _rarest_word_duplicates,
        # files
        "rating_files": _rating_files,
        "item_files": _item_files,
        "transposed_files": _transposed_files,
        "bucketed_users": _bucketed_users,
        "ratings_added_to_none": _started_empty,
        "bucket_size_files": _statistics_files(_bucket_sizes, "signature string, size bigint"),
        "histogram_files": _statistics_files(
            lambda s, d: itemsets.frequency_histogram(_unique_rows(s, d)), "n_ratings bigint, n_movies bigint"
        ),
        "counter_files": _statistics_files(_counters, "name string, value bigint"),
        "ntriples": _triples("default"),
        "ntriples_plain_split": _triples("reference"),
        "ntriples_typed": lambda s, d: _statements(s, d)[0],
        "ntriples_rejected": lambda s, d: _statements(s, d)[1].select("value"),
        "pair_files_text": _pair_files("text"),
        "pair_files_csv": _pair_files("csv"),
        "similar_users_from_files": _similar_users,
    } | ({} if llm_queries is None else llm_queries.queries() | {"pipeline": corpus_pipeline.run})


# --- SQL -------------------------------------------------------------------

_SETS = "sets AS (SELECT DISTINCT l_orderkey AS set_id, l_partkey AS item FROM lineitem)"
_SIZES = "sizes AS (SELECT set_id, count(*) AS n FROM sets GROUP BY set_id)"
_DOC_SETS = (
    "words AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents), "
    "sets AS (SELECT DISTINCT doc_id AS set_id, term AS item FROM words WHERE term <> '')"
)


def _sql_ranked(order: str = "df, item") -> str:
    return (
        "freq AS (SELECT item, count(*) AS df FROM sets GROUP BY item), "
        "ranked AS (SELECT set_id, item, df, count(*) OVER (PARTITION BY set_id) AS n, "
        f"row_number() OVER (PARTITION BY set_id ORDER BY {order}) AS rk "
        "FROM sets JOIN freq USING (item))"
    )


def _sql_prefix(t: float, k: int, order: str = "df, item") -> str:
    return (
        f"{_sql_ranked(order)}, prefix AS (SELECT * FROM ranked "
        f"WHERE rk <= n - ceil({t}::DOUBLE * n)::BIGINT + {k})"
    )


def _sql_pairs(t: float) -> str:
    """All similar pairs, by joining sets on every item."""
    return (
        f"{_SIZES}, hits AS (SELECT a.set_id AS id_a, b.set_id AS id_b, count(*) AS overlap "
        "FROM sets a JOIN sets b ON a.item = b.item AND a.set_id < b.set_id GROUP BY 1, 2), "
        "pairs AS (SELECT id_a, id_b, overlap::INTEGER AS overlap, "
        "overlap::DOUBLE / (x.n + y.n - overlap)::DOUBLE AS jaccard, x.n AS n_a, y.n AS n_b "
        "FROM hits JOIN sizes x ON x.set_id = id_a JOIN sizes y ON y.set_id = id_b "
        f"WHERE greatest(x.n, y.n) * {t}::DOUBLE <= least(x.n, y.n) "
        f"AND overlap::DOUBLE / (x.n + y.n - overlap)::DOUBLE >= {t}::DOUBLE)"
    )


def _sql_classes(t: float, mode: str) -> str:
    """Needs ``sizes``; gives classes(set_id, n, class)."""
    starts = (
        "starts(b) AS (SELECT 1::BIGINT UNION ALL "
        f"SELECT 2 * b - ceil({t}::DOUBLE * b)::BIGINT + 1 FROM starts WHERE b < 1000000), "
        "steps AS (SELECT b, coalesce(lag(b) OVER (ORDER BY b), 0) AS before, "
        "coalesce(lead(b) OVER (ORDER BY b), 9000000000000) AS following FROM starts)"
    )
    fewest = f"ceil({t}::DOUBLE * n)"
    if mode == "complete":
        body = f"SELECT set_id, n, b AS class FROM sizes JOIN steps ON b <= n AND following > {fewest}"
    else:
        own = "SELECT set_id, n, b, before FROM sizes JOIN steps ON b <= n AND n < following"
        body = (
            f"SELECT set_id, n, b AS class FROM ({own}) UNION ALL "
            f"SELECT set_id, n, before AS class FROM ({own}) WHERE {fewest} < b"
        )
    return f"{starts}, classes AS ({body})"


def _sql_signatures(k: int) -> str:
    """Needs ``prefix``; gives sigs(set_id, n, signature)."""
    tables = ", ".join(f"prefix p{i}" for i in range(k))
    same = [f"p{i}.set_id = p{i + 1}.set_id AND p{i}.rk < p{i + 1}.rk" for i in range(k - 1)]
    where = f"WHERE {' AND '.join(same)}" if same else ""
    text_ = " || ';' || ".join(f"p{i}.item" for i in range(k))
    short = (
        "SELECT set_id, any_value(n) AS n, string_agg(item::VARCHAR, ';' ORDER BY rk) AS signature "
        f"FROM prefix GROUP BY set_id HAVING count(*) < {k}"
    )
    first = "p0.item::VARCHAR" if k == 1 else text_
    return (
        f"sigs AS (SELECT p0.set_id, p0.n, {first} AS signature FROM {tables} {where} "
        f"UNION ALL {short})"
    )


def _sql_signed(t: float, k: int, mode: str | None = None) -> str:
    head = f"{_SETS}, {_sql_prefix(t, k)}, {_sql_signatures(k)}"
    if mode is None:
        return f"WITH {head}, signed AS (SELECT * FROM sigs)"
    return (
        f"WITH RECURSIVE {head}, {_SIZES}, {_sql_classes(t, mode)}, signed AS ("
        "SELECT s.set_id, s.n, c.class || '_' || s.signature AS signature "
        "FROM sigs s JOIN classes c USING (set_id))"
    )


def _sql_found(t: float, k: int, mode: str | None = None) -> str:
    """Similar pairs once per shared signature: bag(id_a, id_b, overlap, jaccard)."""
    sizes = "" if mode is None else f"{_SIZES}, "
    pairs = _sql_pairs(t)
    if sizes:
        pairs = pairs.replace(f"{_SIZES}, ", "", 1)
    return (
        f"{_sql_signed(t, k, mode)}, {pairs}, bag AS ("
        "SELECT id_a, id_b, overlap, jaccard FROM pairs "
        "JOIN signed a ON a.set_id = id_a JOIN signed b ON b.set_id = id_b "
        "AND a.signature = b.signature)"
    )


def _sql_stats(t: float, k: int, mode: str | None = None) -> str:
    return (
        f"{_sql_found(t, k, mode)}, compared AS (SELECT count(*) AS c FROM signed a "
        "JOIN signed b ON a.signature = b.signature AND a.set_id < b.set_id "
        f"WHERE greatest(a.n, b.n) * {t}::DOUBLE <= least(a.n, b.n)), "
        "counts AS (SELECT count(*) AS emitted, count(DISTINCT (id_a, id_b)) AS distinct_pairs FROM bag) "
        "SELECT (SELECT count(*) FROM signed) AS signatures, (SELECT c FROM compared) AS comparisons, "
        "emitted, distinct_pairs, 1.0::DOUBLE - distinct_pairs::DOUBLE / emitted AS duplicate_rate FROM counts"
    )


def _sql_words(lower_first: bool = True, stop: bool = False) -> str:
    """tokens(doc_id, term), one row per word."""
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    keep = "w <> ''"
    if stop:
        keep += f" AND length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({words})"
    source = "lower(text)" if lower_first else "text"
    return (
        f"raw AS (SELECT doc_id, unnest(string_split({source}, ' ')) AS w FROM documents), "
        f"tokens AS (SELECT doc_id, lower(w) AS term FROM raw WHERE {keep}), "
        "counted AS (SELECT doc_id, term, count(*) AS cnt FROM tokens GROUP BY 1, 2), "
        "dfs AS (SELECT term, count(*) AS df FROM counted GROUP BY term), "
        "all_words AS (SELECT doc_id, count(*) AS n_words FROM (SELECT doc_id, "
        "unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id), "
        "docs AS (SELECT count(*) AS n_docs FROM documents)"
    )


def _sql_standard(stop: bool) -> str:
    return (
        f"WITH {_sql_words(stop=stop)} SELECT doc_id, term, cnt, "
        "round(cnt::DOUBLE / n_words * ln(n_docs::DOUBLE / df), 9) AS weight "
        "FROM counted JOIN dfs USING (term) JOIN all_words USING (doc_id), docs"
    )


_PIECES = (
    "held AS (SELECT DISTINCT doc_id, w AS token FROM (SELECT doc_id, "
    r"unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '')"
)


def oracle_sql() -> dict[str, str]:
    sets, pairs = f"WITH {_SETS}", "SELECT id_a, id_b, overlap, jaccard FROM"
    distinct_bag = "SELECT DISTINCT id_a, id_b, overlap, jaccard FROM bag"
    groups = (
        "contents AS (SELECT set_id, list(item ORDER BY item) AS items FROM sets GROUP BY set_id), "
        "reps AS (SELECT items, min(set_id) AS rep, count(*) AS copies FROM contents GROUP BY items), "
        "members AS (SELECT set_id, rep, copies FROM contents JOIN reps USING (items))"
    )
    escaped = "text"
    for plain, code in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'")):
        escaped = f"replace({escaped}, {plain}, {code})"
    line = (
        "'<http://example.org/' || doc_id || '> <http://example.org/abstract> \"' || "
        f"{escaped} || '\"@' || lang || ' .'"
    )
    joined = {t: f"{sets}, {_sql_pairs(t)} {pairs} pairs" for t in (0.9, 0.5, 0.3)}
    doc_pairs = {t: f"WITH {_DOC_SETS}, {_sql_pairs(t)} {pairs} pairs" for t in (0.9, 0.8, 0.5)}
    bucket_sizes = (
        f"{_sql_signed(0.5, 1)} SELECT signature, count(*) AS size FROM signed "
        "GROUP BY signature HAVING count(*) > 1"
    )
    histogram = (
        f"{sets}, freq AS (SELECT item, count(*) AS df FROM sets GROUP BY item) "
        "SELECT df AS n_ratings, count(*) AS n_movies FROM freq GROUP BY df"
    )
    counters = (
        f"{_sql_found(0.3, 1)} SELECT 'emitted' AS name, count(*) AS value FROM bag UNION ALL "
        "SELECT 'distinct_pairs', count(DISTINCT (id_a, id_b)) FROM bag"
    )
    abstracts = _sql_standard(False).replace("FROM documents", "FROM abstracts")
    return {
        "item_frequency": f"{sets} SELECT item, count(*) AS df FROM sets GROUP BY item",
        "frequency_histogram": histogram,
        "histogram_files": histogram,
        "set_sizes": f"{sets} SELECT set_id, count(*) AS n FROM sets GROUP BY set_id",
        "item_sets": (
            f"{sets} SELECT set_id, 0::INTEGER AS chunk, string_agg(item::VARCHAR, ';' ORDER BY item) AS items, "
            "count(*) AS n_items FROM sets GROUP BY set_id"
        ),
        "word_sets_in_chunks": (
            f"WITH {_DOC_SETS}, placed AS (SELECT set_id, item, count(*) OVER (PARTITION BY set_id) AS n_items, "
            "((row_number() OVER (PARTITION BY set_id ORDER BY item) - 1) "
            f"// {SMALL['split_rows']})::INTEGER AS chunk FROM sets) "
            "SELECT set_id, chunk, string_agg(item, ' ' ORDER BY item) AS items, n_items "
            "FROM placed GROUP BY set_id, chunk, n_items"
        ),
        "set_groups": f"{sets}, {groups} SELECT * FROM members",
        "first_items": (
            f"{sets} SELECT item, count(*) AS df FROM sets GROUP BY item ORDER BY df, item LIMIT 10"
        ),
        "ranked_prefix": f"{sets}, {_sql_prefix(0.5, 1)} SELECT * FROM prefix",
        "ranked_prefix_by_item": f"{sets}, {_sql_prefix(0.5, 1, 'item')} SELECT * FROM prefix",
        "length_classes": (
            f"WITH RECURSIVE {_SETS}, {_SIZES}, {_sql_classes(0.5, 'reference')} SELECT * FROM classes"
        ),
        "length_classes_complete": (
            f"WITH RECURSIVE {_SETS}, {_SIZES}, {_sql_classes(0.3, 'complete')} SELECT * FROM classes"
        ),
        **{
            f"signatures_k{k}": f"{_sql_signed(0.5, k)} SELECT set_id, signature FROM signed"
            for k in (1, 2, 3)
        },
        "signatures_k2_classes": (
            f"{_sql_signed(0.5, 2, 'reference')} SELECT set_id, signature FROM signed"
        ),
        "bucket_sizes": bucket_sizes,
        "bucket_size_files": bucket_sizes,
        "shared_signatures_k2": (
            f"{_sql_signed(0.5, 2)} SELECT signature, set_id FROM signed "
            "QUALIFY count(*) OVER (PARTITION BY signature) > 1"
        ),
        "similarity_join_t90": joined[0.9],
        "similarity_join_t50": joined[0.5],
        "similarity_join_t30": joined[0.3],
        "similarity_join_by_item_t50": joined[0.5],
        "similarity_join_k2_t50": f"{_sql_found(0.5, 2)} {distinct_bag}",
        "similarity_join_k3_t30": f"{_sql_found(0.3, 3)} {distinct_bag}",
        "similarity_join_classes_t30": f"{_sql_found(0.3, 1, 'reference')} {distinct_bag}",
        "similarity_join_complete_classes_t30": joined[0.3],
        "similarity_join_adaptive_t50": joined[0.5],
        "similarity_join_adaptive_t30": joined[0.3],
        "similarity_join_bag_t30": f"{_sql_found(0.3, 1)} SELECT * FROM bag",
        "similar_groups_t50": (
            f"{sets}, {groups}, {_sql_pairs(0.5)} SELECT id_a AS rep_a, id_b AS rep_b, "
            "a.copies AS copies_a, b.copies AS copies_b, overlap, jaccard FROM pairs "
            "JOIN reps a ON a.rep = id_a JOIN reps b ON b.rep = id_b"
        ),
        "similar_with_records": (
            f"{sets}, {_sql_pairs(0.9)} SELECT id_a, id_b, overlap, jaccard, "
            "a.o_custkey AS o_custkey_a, a.o_orderstatus AS o_orderstatus_a, "
            "b.o_custkey AS o_custkey_b, b.o_orderstatus AS o_orderstatus_b FROM pairs "
            "JOIN orders a ON a.o_orderkey = id_a JOIN orders b ON b.o_orderkey = id_b"
        ),
        "join_stats_t50": _sql_stats(0.5, 1),
        "join_stats_k2_t50": _sql_stats(0.5, 2),
        "join_stats_classes_t30": _sql_stats(0.3, 1, "reference"),
        "pair_counts_t30": (
            f"{_sql_found(0.3, 1)}, counts AS (SELECT count(*) AS emitted, "
            "count(DISTINCT (id_a, id_b)) AS distinct_pairs FROM bag) SELECT emitted, distinct_pairs, "
            "1.0::DOUBLE - distinct_pairs::DOUBLE / emitted AS duplicate_rate FROM counts"
        ),
        "counters_t30": counters,
        "counter_files": counters,
        "word_counts": f"WITH {_sql_words()} SELECT term, count(*) AS cnt FROM tokens GROUP BY term",
        "word_counts_without_stop_words": (
            f"WITH {_sql_words(stop=True)} SELECT term, count(*) AS cnt FROM tokens GROUP BY term"
        ),
        "word_counts_as_written": (
            f"WITH {_sql_words(False, True)} SELECT term, count(*) AS cnt FROM tokens GROUP BY term"
        ),
        "vocabulary": f"WITH {_sql_words()} SELECT DISTINCT term FROM tokens",
        "document_count": "SELECT count(*) AS n_docs FROM documents",
        "words_per_document": (
            "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS n_words "
            "FROM documents"
        ),
        "word_counts_without_stop_file": (
            f"WITH {_sql_words()} SELECT term, count(*) AS cnt FROM tokens "
            f"WHERE NOT list_contains({STOP_WORDS!r}, term) GROUP BY term"
        ),
        "abstract_weights": (
            f"WITH abstracts AS (SELECT doc_id, {escaped} AS text FROM documents), "
            f"weighted AS ({abstracts}) SELECT 'http://example.org/' || doc_id AS subject, term, cnt, weight "
            "FROM weighted"
        ),
        "term_counts": (
            f"WITH {_sql_words()} SELECT doc_id, n_words, term, cnt "
            "FROM counted JOIN all_words USING (doc_id)"
        ),
        "doc_frequency": f"WITH {_sql_words()} SELECT term, df FROM dfs",
        "incidence": f"WITH {_PIECES} SELECT doc_id, token AS term FROM held",
        "incidence_substring": (
            f"WITH {_PIECES}, vocab AS (SELECT DISTINCT token FROM held), "
            "starts AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM vocab), "
            "cuts AS (SELECT token, i, unnest(range(1, length(token) - i + 2)) AS j FROM starts), "
            "inside AS (SELECT DISTINCT c.token, v.token AS term FROM cuts c "
            "JOIN vocab v ON v.token = substring(c.token, c.i, c.j)) "
            "SELECT DISTINCT doc_id, term FROM held JOIN inside USING (token)"
        ),
        "incidence_vectors": (
            f"WITH {_PIECES}, stops AS (SELECT unnest({STOP_WORDS!r}) AS token), "
            "known AS (SELECT doc_id, list(token) AS l FROM held SEMI JOIN stops USING (token) GROUP BY doc_id) "
            "SELECT doc_id, "
            + " || ".join(f"coalesce(list_contains(l, '{w}'), false)::INTEGER" for w in STOP_WORDS)
            + " AS vector FROM documents LEFT JOIN known USING (doc_id)"
        ),
        "tf_idf_standard": _sql_standard(False),
        "tf_idf_stop_words": _sql_standard(True),
        "tf_idf_reference": (
            f"WITH {_sql_words(False, True)}, texts AS (SELECT doc_id, lower(text) AS t FROM documents), "
            "subs AS (SELECT doc_id, term, "
            "(length(t) - length(replace(t, term, ''))) // length(term) AS cnt "
            "FROM counted JOIN texts USING (doc_id)) "
            "SELECT doc_id, term, cnt, round((cnt // max(cnt) OVER (PARTITION BY doc_id))::DOUBLE "
            "/ (n_docs // df)::DOUBLE, 9) AS weight FROM subs JOIN dfs USING (term), docs"
        ),
        "rendered_documents": (
            f"WITH weighted AS ({_sql_standard(False)}) SELECT doc_id, doc_id || ': {{' || "
            "string_agg(term || '=' || printf('%.9f', weight), ', ' ORDER BY term) || '}' AS line "
            "FROM weighted GROUP BY doc_id"
        ),
        "document_near_duplicates_t90": doc_pairs[0.9],
        "document_near_duplicates_t50": doc_pairs[0.5],
        "document_near_duplicates_adaptive_t90": doc_pairs[0.9],
        "document_near_duplicates_t90_small_blocks": doc_pairs[0.9],
        "rarest_words": (
            f"WITH {_DOC_SETS}, {_sql_ranked()} "
            "SELECT set_id AS doc_id, item AS term, df, rk FROM ranked WHERE rk <= 3"
        ),
        "rarest_words_candidates": (
            f"WITH {_DOC_SETS}, {_sql_ranked()}, {_sql_pairs(0.8)} SELECT DISTINCT id_a, id_b, overlap, "
            "jaccard FROM pairs JOIN ranked a ON a.set_id = id_a AND a.rk <= 3 "
            "JOIN ranked b ON b.set_id = id_b AND b.rk <= 3 AND b.item = a.item"
        ),
        "rating_files": (
            'SELECT l_orderkey AS "user", l_partkey AS movie, l_linenumber AS rating FROM lineitem'
        ),
        "item_files": (
            'SELECT l_orderkey AS "user", l_partkey AS movie, l_linenumber AS rating FROM lineitem'
        ),
        "transposed_files": (
            "SELECT (l_orderkey % 1000)::INTEGER AS bucket, count(*) AS n_ratings, "
            "count(DISTINCT l_orderkey) AS n_users FROM lineitem GROUP BY 1"
        ),
        "ratings_added_to_none": (
            'SELECT l_orderkey::INTEGER AS "user", count(*) AS n_ratings FROM lineitem GROUP BY 1'
        ),
        "bucketed_users": (
            "SELECT o_custkey % 1000 AS bucket, count(*) AS n_orders FROM orders GROUP BY 1"
        ),
        "ntriples": (
            "SELECT 'http://example.org/' || doc_id AS subject, 'http://example.org/abstract' AS predicate, "
            f"{escaped} AS text, lang FROM documents"
        ),
        "ntriples_typed": (
            "WITH s AS (SELECT *, 'http://example.org/' || doc_id AS subject FROM documents) "
            "SELECT subject, 'http://example.org/abstract' AS predicate, text AS object, 'literal' AS kind, "
            "lang, NULL::VARCHAR AS datatype FROM s "
            "UNION ALL SELECT subject, 'http://example.org/from', 'http://example.org/' || lang, 'iri', NULL, NULL FROM s "
            f"UNION ALL SELECT subject, 'http://example.org/size', n_chars::VARCHAR, 'literal', NULL, '{_XSD}' FROM s "
            "UNION ALL SELECT '_:d' || doc_id, 'http://example.org/of', '_:e' || doc_id, 'blank', NULL, NULL FROM s "
            "UNION ALL SELECT subject, 'http://example.org/signs', "
            "chr(233) || doc_id || ' ' || chr(128512) || chr(9) || '\\u0041', 'literal', NULL, NULL FROM s"
        ),
        "ntriples_rejected": (
            "SELECT '<http://example.org/' || doc_id || '> <http://example.org/none> no object .' AS value FROM documents"
        ),
        "ntriples_plain_split": (
            f"WITH lines AS (SELECT {line} AS value FROM documents) "
            "SELECT split_part(value, '<', 2) AS subject, "
            "split_part(split_part(value, '<', 3), '\"', 2) AS text FROM lines"
        ),
        "pair_files_text": (
            f"{sets}, {_sql_pairs(0.9)} SELECT '(' || id_a || ',' || id_b || ')' AS value FROM pairs"
        ),
        "pair_files_csv": joined[0.9],
        "similar_users_from_files": joined[0.5],
    } | ({} if llm_queries is None else llm_queries.oracle_sql())
