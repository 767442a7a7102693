"""Column expressions for lines, tokens and term weights."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole N-Triples statement: <subject> <predicate> "literal"@lang .
# The literal part accepts escaped quotes; possessive quantifiers keep the
# match linear and free of deep recursion on long literals.
TRIPLE = r'^<([^>]*)>\s+<([^>]*)>\s+"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+))?'


# Any N-Triples statement, with the parts: subject IRI, subject blank node, predicate, then
# the object's IRI, blank node, or literal with a language tag or a datatype.
_BLANK_NODE = r"_:([A-Za-z0-9_](?:[\w.-]*[\w-])?)"
_BEFORE_OBJECT = rf"^\s*(?:<([^<>\s]*)>|{_BLANK_NODE})\s*<([^<>\s]*)>\s*"
STATEMENT = (
    rf'{_BEFORE_OBJECT}(?:<([^<>\s]*)>|{_BLANK_NODE}|"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    r"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?)\s*\.\s*(?:#.*)?$"
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}


def number_field(line: Column, index: int, kind: str = "int") -> Column:
    """The ``index``-th comma-separated field as a number; malformed ones raise."""
    return F.get(F.split(line, ","), F.lit(index)).cast(kind)


def is_header(line: Column) -> Column:
    return F.contains(line, F.lit(":"))


def header_id(line: Column, kind: str = "int") -> Column:
    return F.get(F.split(line, ":"), F.lit(0)).cast(kind)


def triple_field(line: Column, group: int) -> Column:
    """Group 1 subject, 2 predicate, 3 literal, 4 language tag (NULL if absent)."""
    value = F.regexp_extract(line, TRIPLE, group)
    return F.when(value != "", value) if group == 4 else value


def is_statement(line: Column) -> Column:
    return line.rlike(STATEMENT)


def object_kind(line: Column) -> Column:
    """Of a statement: "iri", "blank" or "literal"."""
    iri, blank = (line.rlike(_BEFORE_OBJECT + sign) for sign in ("<", "_:"))
    return F.when(iri, "iri").when(blank, "blank").otherwise("literal")


def statement_part(line: Column, group: int) -> Column:
    return F.regexp_extract(line, STATEMENT, group)


def _code_point(piece: Column) -> Column:
    """A piece that starts with \\uXXXX or \\UXXXXXXXX, with the character in its place."""
    short = F.concat(F.decode(F.unhex(F.substring(piece, 3, 4)), "UTF-16BE"), F.substr(piece, F.lit(7)))
    long = F.concat(F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32"), F.substr(piece, F.lit(11)))
    return (
        F.when(piece.rlike(r"^\\u[0-9A-Fa-f]{4}"), short)
        .when(piece.rlike(r"^\\U[0-9A-Fa-f]{8}"), long)
        .otherwise(piece)
    )


def unescaped(literal: Column) -> Column:
    """A literal with its escapes decoded; unknown ones stay as they are.

    Cut at escaped backslashes first, so that what follows one is never taken for an escape.
    """

    def decoded(part: Column) -> Column:
        pieces = F.transform(F.split(part, r"(?=\\[uU])"), _code_point)
        # a decoded character is never the start of an escape, as backslashes were cut out
        part = F.array_join(pieces, "")
        for letter, sign in _ESCAPES.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(sign))
        return part

    parts = F.transform(F.split(literal, r"\\\\"), decoded)
    return F.when(F.contains(literal, F.lit("\\")), F.array_join(parts, "\\")).otherwise(literal)


def plain_subject(line: Column) -> Column:
    """Text between the first and the second '<' (keeps the closing '> ')."""
    return F.get(F.split(line, "<"), F.lit(1))


def plain_literal(line: Column) -> Column:
    """Text between the first two quotes after the second '<'; an escaped quote ends it."""
    return F.get(F.split(F.get(F.split(line, "<"), F.lit(2)), '"'), F.lit(1))


def is_noise(token: Column) -> Column:
    """Tokens dropped before the stop list: under two characters, or a leading digit."""
    return (F.length(token) < 2) | token.rlike("^[0-9]")


def in_words(token: Column, words: Iterable[str]) -> Column:
    return token.isin(sorted(set(words)))


def count_matches(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part`` in ``text``."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.call_function("div", removed, F.length(part))


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    """ln(N / df), and 0 for a term no document holds."""
    return F.when(df > 0, F.log(n_docs / df)).otherwise(F.lit(0.0))


def standard_weight(cnt: Column, n_words: Column, n_docs: Column, df: Column) -> Column:
    return cnt / n_words * inverse_document_frequency(n_docs, df)


def floor_weight(cnt: Column, max_cnt: Column, n_docs: Column, df: Column) -> Column:
    """Integer-division variant: floor(cnt / max) over floor(N / df), no logarithm."""
    tf = F.call_function("div", cnt, max_cnt).cast("double")
    return tf / F.call_function("div", n_docs, df).cast("double")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets))
