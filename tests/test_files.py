import math
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brute_force import similar_pairs
from nearset.operators import itemsets
from nearset.plans import programs
from nearset.runtime import shared_folder, write_once
from nearset.sources import readers, writers

ABSTRACTS = [
    "# started 2014-08-21T14:51:59Z",
    '<http://example.org/One_(list)> <http://example.org/abstract> "one one two"@en .',
    '<http://example.org/Two> <http://example.org/abstract> "shape.\\"Round\\" and \\u00e9"@en .',
    '<http://example.org/One_(list)> <http://example.org/abstract> "a third text"@en .',
]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_rating_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "0.csv", ["1,10,5", "1,11,3,2005-01-01", "2,10"])
    write(folder / "1.csv", ["3,12,1"])
    got = readers.read_ratings(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 10), (3, 12)]
    assert got.dtypes == [("user", "int"), ("movie", "int")]
    listed = readers.read_ratings(spark, [f"{folder}/0.csv", f"{folder}/1.csv"])
    assert listed.count() == 4
    assert readers.empty_ratings(spark).unionByName(got).count() == 4
    with pytest.raises(PySparkException):
        readers.read_ratings(spark, write(tmp_path / "bad.csv", ["x,1"])).collect()


def test_item_files(spark, tmp_path):
    folder = tmp_path / "items"
    folder.mkdir()
    write(folder / "mv_0000007.txt", ["7:", "1,5,d", "2,3,d"])
    write(folder / "mv_0000008.txt", ["8:", "1,4,d", "9:", "3,1,d"])
    got = readers.read_item_files(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 5), (1, 8, 4), (2, 7, 3), (3, 9, 1)]


def test_item_file_larger_than_a_split(spark, tmp_path):
    lines, expected = [], []
    for movie in (1, 2, 3):
        lines.append(f"{movie}:")
        for user in range(400):
            lines.append(f"{user},{user % 5},d")
            expected.append((user, movie, user % 5))
    path = write(tmp_path / "all.txt", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        got = readers.read_item_files(spark, path)
        assert sorted(map(tuple, got.collect())) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ntriples(spark, tmp_path):
    path = write(tmp_path / "a.nt", ABSTRACTS)
    got = readers.read_ntriples(spark, path).collect()
    assert [(r.subject, r.text, r.lang) for r in got] == [
        ("http://example.org/One_(list)", "one one two", "en"),
        ("http://example.org/Two", 'shape.\\"Round\\" and \\u00e9', "en"),
        ("http://example.org/One_(list)", "a third text", "en"),
    ]
    plain = readers.read_ntriples(spark, path, "reference").collect()
    assert plain[0].subject == "http://example.org/One_(list)> "
    assert plain[1].text == "shape.\\"
    with pytest.raises(ValueError):
        readers.read_ntriples(spark, path, "strict")


def test_long_literal(spark, tmp_path):
    literal = 'word \\"quoted\\" ' * 20_000
    path = write(tmp_path / "long.nt", [f'<http://example.org/s> <http://example.org/p> "{literal}"@en .'])
    assert readers.read_ntriples(spark, path).first().text == literal


def test_weights_of_abstracts(spark, tmp_path):
    path = write(tmp_path / "a.nt", ABSTRACTS)
    weights = programs.abstract_weights(spark, path).collect()
    # repeated subjects stay separate documents
    assert len({r.doc_id for r in weights}) == 3 and len({r.subject for r in weights}) == 2
    parity = programs.abstract_weights(spark, path, ["two"], parity=True).collect()
    assert {r.term for r in parity} == {"one", "shape.\\", "third", "text"}


def test_bucketed_writer(spark, tmp_path):
    ratings = spark.createDataFrame([(u, u % 7, 1) for u in range(50)], "user int, movie int, rating int")
    path = str(tmp_path / "by_user")
    for _ in range(2):  # a second run replaces the first
        writers.write_bucketed(ratings, path, buckets=10)
    back = spark.read.schema("user int, movie int, rating int").csv(path)
    assert back.where(F.col("user") % 10 != F.col("bucket")).count() == 0
    assert back.count() == 50
    assert readers.read_ratings(spark, f"{path}/bucket=3").count() == 5


def test_transposing_and_similar_users(spark, tmp_path):
    folder = tmp_path / "movies"
    folder.mkdir()
    rows = [(u, m) for m in range(1, 5) for u in (1, 2, 3) if (u, m) != (3, 4)]
    for m in range(1, 5):
        write(folder / f"mv_{m}.txt", [f"{m}:"] + [f"{u},3,d" for u, movie in rows if movie == m])
    out = str(tmp_path / "users")
    programs.transpose_item_files(spark, str(folder), out, buckets=2)
    target = str(tmp_path / "pairs")
    programs.write_similar_users(spark, f"{out}/*", target, threshold=0.75)
    lines = {r.value for r in spark.read.text(target).collect()}
    assert lines == {f"({a},{b})" for a, b in similar_pairs(rows, 0.75)}


def test_pair_formats(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "id_a int, id_b int")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        for _ in range(2):
            writers.write_pairs(pairs, path, fmt)
        back = spark.read.schema("id_a int, id_b int").format(fmt).load(path)
        assert sorted(map(tuple, back.collect())) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        writers.write_pairs(pairs, str(tmp_path / "x"), "xml")


def test_statistics_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "set_id int, item int")
    path = str(tmp_path / "histogram")
    writers.write_stats(itemsets.frequency_histogram(rows), path)
    back = spark.read.schema("n_ratings bigint, n_movies bigint").csv(path)
    assert sorted(map(tuple, back.collect())) == [(1, 1), (2, 1)]
    assert [r.item for r in writers.preview(rows, "item", "set_id", rows=2).collect()] == [1, 1]


def test_sets_in_chunks(spark):
    rows = spark.createDataFrame([(1, m) for m in range(50)] + [(2, 1), (2, 1)], "set_id int, item int")
    chunks = itemsets.to_sets(rows, split_rows=10).collect()
    items = sorted(i for r in chunks if r.set_id == 1 for i in r["items"])
    assert items == list(range(50)) and sum(r.set_id == 1 for r in chunks) == 5
    assert {r.chunk: r["items"] for r in chunks if r.set_id == 1}[2] == list(range(20, 30))
    assert {r.n_items for r in chunks if r.set_id == 1} == {50}
    assert [(r["items"], r.n_items) for r in chunks if r.set_id == 2] == [([1], 1)]


def test_stop_word_file(spark, tmp_path):
    got = readers.read_stop_words(spark, write(tmp_path / "s.txt", ["the", " it ", "", "the"]))
    assert sorted(r.word for r in got.collect()) == ["it", "the"]


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder == named
    table = write_once(spark.range(3), "numbers")
    assert table.count() == 3
    assert all(f"{folder}/numbers-" in path for path in table.inputFiles())


def test_numbered_lines(spark):
    assert readers.number_lines(spark.range(4)).select("line").distinct().count() == 4


STATEMENTS = [
    # line, statement or None
    ('<s> <p> "plain" .', ("s", "p", "plain", "literal", None, None)),
    ('<s> <p> "" .', ("s", "p", "", "literal", None, None)),
    ('<s><p><o>.', ("s", "p", "o", "iri", None, None)),
    ('<s> <p> <> .', ("s", "p", "", "iri", None, None)),
    ('  _:a.b-c <p> _:x1 . # why', ("_:a.b-c", "p", "_:x1", "blank", None, None)),
    ('<s> <p> "x"@de-AT .', ("s", "p", "x", "literal", "de-AT", None)),
    ('<s> <p> "1"^^<int> .', ("s", "p", "1", "literal", None, "int")),
    ('<s> <p> "<o> _:b" .', ("s", "p", "<o> _:b", "literal", None, None)),
    (r'<s> <p> "a\"b\\n\n\\\té\U0001F600\\u0041\'" .', ("s", "p", 'a"b\\n\n\\\té😀\\u0041\'', "literal", None, None)),
    (r'<s> <p> "\\\\n\\" .', ("s", "p", "\\\\n\\", "literal", None, None)),
    (r'<s> <p> "\n \x \u12" .', ("s", "p", "\n \\x \\u12", "literal", None, None)),
    ("<s> <p> .", None),
    ('<s> <p> "open .', None),
    ('<s> <p> "x"', None),
    ('<s> <p> "x"@ .', None),
    ("<s> <p> <o> <g> .", None),
    ('"s" <p> <o> .', None),
    ("words", None),
    ("# <s> <p> <o> .", "skipped"),
    ("  # comment", "skipped"),
    ("", "skipped"),
]


def test_statements_of_all_kinds_and_rejected_lines(spark):
    lines = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(STATEMENTS)], "line bigint, value string")
    good, bad = readers.parse_statements(lines)
    key = lambda r: tuple(x or "" for x in r)
    wanted = [s for _, s in STATEMENTS if isinstance(s, tuple)]
    assert sorted((tuple(r) for r in good.collect()), key=key) == sorted(wanted, key=key)
    assert sorted(r.line for r in bad.collect()) == [i for i, (_, s) in enumerate(STATEMENTS) if s is None]


def test_rejected_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<s> <p> <o> .\nbroken\n")
    good, bad = readers.read_statements(spark, str(tmp_path / "a.nt"))
    assert good.count() == 1 and [(r.line, r.value) for r in bad.collect()] == [(1, "broken")]


def test_statements_without_a_literal_are_no_documents(spark, tmp_path):
    lines = [line for line, _ in STATEMENTS]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    got = readers.read_ntriples(spark, str(tmp_path / "a.nt")).collect()
    assert all(r.subject == "s" for r in got) and {"plain", "", "x"} <= {r.text for r in got}
    weights = programs.abstract_weights(spark, str(tmp_path / "a.nt"))
    n_docs = len(got)
    row = weights.where("term = 'plain'").first()
    assert row.weight == pytest.approx(math.log(n_docs))
