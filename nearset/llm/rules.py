"""Quality rules: statistics of texts and decision lists learned from labels.

DataFrame functions only.  A list is learned by sequential covering: a rule grows by
the threshold condition with the best FOIL gain on two thirds of the labelled rows,
is pruned to its best prefix on the other third, and the rows it covers are set
aside.  Each step is one aggregation of the labelled rows to counts per statistic and
bin.  The result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearset.llm.common import SPACE, texts
from nearset.runtime import write_once

WINDOW = 8

#: Statistics that conditions are about, from the columns of ``text_statistics``.
RATIOS = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


def _repeated(windows: str, sorted_windows: str) -> Column:
    """Words that lie in windows found twice; ``sorted_windows`` has (hash, place) in order."""
    s, last = F.col(sorted_windows), F.size(sorted_windows) - 1

    def twice(j: Column) -> Column:
        same = lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda j: F.get(s, j)["i"]))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), at)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, a row per document.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_marks, n_upper,
    n_digits, n_lines (with a word), n_dup_lines (equal to an earlier one), n_distinct
    (words), n_repeat_words (words in 8-word windows found twice or more).  Null and
    empty texts count 0 throughout; a null id stays null; repeated rows stay.
    """
    rows = texts(docs, id_col, text_col)
    words = F.array_remove(F.split("text", SPACE + "+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    cut = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    places = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    windows = F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(-1, WINDOW - 1)]))
    counted = cut.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).cast("bigint").alias("n_marks"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        windows.alias("windows"),
    )
    # only texts with a repeated window are sorted
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = counted.withColumn("ordered", F.when(again, F.sort_array(pairs)))
    found = ordered.withColumn("at", F.when(F.col("ordered").isNotNull(), _repeated("windows", "ordered")))
    k = F.size("at")
    steps = F.zip_with(
        F.slice("at", F.lit(1), k - 1), F.slice("at", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)
    repeated = F.when(F.col("at").isNotNull(), covered).otherwise(0).cast("bigint")
    return found.withColumn("n_repeat_words", repeated).drop("windows", "ordered", "at")


@dataclass(frozen=True)
class Condition:
    statistic: str
    threshold: float
    above: bool

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    return F.expr(" AND ".join(f"{c.statistic} {'>' if c.above else '<='} {c.threshold!r}D" for c in rule))


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, or null: an ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    chain = F.when(rule_column(rules[0]), 1)
    for i, rule in enumerate(rules[1:], 2):
        chain = chain.when(rule_column(rule), i)
    return chain


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame, cuts: dict[str, list[float]], fixed: Rule) -> tuple[Condition | None, int, int]:
    """The condition that adds most to ``fixed``, and the bad and good rows it then covers."""

    def bin_of(name: str, points: list[float]) -> Column:
        below = F.filter(F.lit(points), lambda c: c < F.col(name))
        return F.struct(F.lit(name).alias("name"), F.size(below).alias("bin"))

    bins = [bin_of(name, points) for name, points in cuts.items()]
    counts = (
        rows.select("bad", F.explode(F.array(*bins)).alias("x"))
        .groupBy("x.name", "x.bin")
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    )
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.toLocalIterator():  # a row per statistic and bin
        table.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"])
    best, best_gain, best_p, best_n = None, 0.0, 0, 0
    for name, by_bin in sorted(table.items()):
        p0, n0 = (sum(v[i] for v in by_bin.values()) for i in (0, 1))
        below_p = below_n = 0
        for i, cut in enumerate(cuts[name]):
            p, n = by_bin.get(i, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, hits, misses in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                gain = _gain(p0, n0, hits, misses)
                if gain > best_gain + 1e-9:
                    best, best_gain, best_p, best_n = Condition(name, cut, above), gain, hits, misses
    return best, best_p, best_n


def learn_rules(
    labelled: DataFrame,
    statistics: dict[str, str],
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 3,
    cuts: int = 24,
) -> list[Rule]:
    """Rules that mark rows as bad, from ``labelled`` with columns of ``statistics`` and ``bad``.

    ``bad`` is 1 or 0 and ``fold`` true for the rows that prune.  Thresholds lie halfway
    between quantiles, ``cuts`` of either class.  No bad rows give no rules.  All rows
    are used at any size; the driver sees counts only.
    """
    shares = [(i + 0.5) / cuts for i in range(cuts)]
    at = labelled.groupBy("bad").agg(
        *[F.percentile_approx(F.col(s).cast("double"), shares, 10_000).alias(s) for s in statistics]
    )
    points: dict[str, set[float]] = {s: set() for s in statistics}
    for r in at.toLocalIterator():
        for s in statistics:
            points[s].update(r[s] or ())
    # halfway between neighbours, so that a gap between the classes is cut in its middle
    ordered = {}
    for s, v in points.items():
        if len(v) > 1:
            values = sorted(v)
            ordered[s] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    rest, rules = labelled, []
    while ordered and len(rules) < max_rules:
        grown: Rule = ()
        part = rest.where("NOT fold")
        while len(grown) < max_conditions:
            condition, p, n = _best(part, ordered, grown)
            if condition is None:
                break
            grown += (condition,)
            part = part.where(rule_column((condition,)))
            if n == 0:
                break
        if not grown:
            break
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        sums = [
            F.sum(F.when(rule_column(r), value).otherwise(0))
            for r in prefixes
            for value in (F.col("bad"), 1 - F.col("bad"))
        ]
        held = [v or 0 for v in rest.where("fold").agg(*sums).first()]
        # (p - n) / (p + n), the shorter rule on a tie
        scored = [((p - n) / (p + n) if p + n else -1.0, -i, p, n) for i, (p, n) in enumerate(zip(held[::2], held[1::2]))]
        _, i, p, n = max(scored)
        if p < min_covered or p / (p + n) < min_precision:
            break
        rules.append(prefixes[-i])
        rest = rest.where(~F.coalesce(rule_column(prefixes[-i]), F.lit(False)))
    return rules


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdicts of every document, and the rules learned from ``labels``.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows with a null in either, or
    of documents that are not there, teach nothing.  Result columns: those of
    ``text_statistics``, base_failed, rule (the first that holds, or null) and kept.
    Rows without an id are judged like others.  Without labels only base_failed decides.
    """
    counted = write_once(text_statistics(docs, id_col, text_col), "statistics")
    ratios = counted.withColumns({k: F.expr(v) for k, v in RATIOS.items()})
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality")).where(
        "doc_id IS NOT NULL AND quality IN (0, 1)"
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    labelled = (
        ratios.where(~base)
        .join(known, "doc_id")
        .select(
            *RATIOS,
            (1 - F.col("quality")).cast("bigint").alias("bad"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("fold"),
        )
    )
    rules = learn_rules(write_once(labelled, "labelled"), RATIOS, **options)
    judged = ratios.withColumns({"base_failed": base, "rule": decision(rules)})
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.withColumn("kept", kept).drop(*RATIOS), rules
