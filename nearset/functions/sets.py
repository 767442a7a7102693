"""Column expressions for set sizes, prefixes, length classes and similarity.

Thresholds are always DOUBLE.  ``ceil(t * n)`` and ``max * t <= min`` follow
IEEE arithmetic on purpose, so a boundary such as 0.55 * 100 (slightly more
than 55) behaves the same here and in the SQL the tests compare with.
"""

from __future__ import annotations

import math
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slack for the overlap bound.  The bound only prunes candidates, and every
# candidate is checked exactly afterwards, so it may be loose but never tight.
_SLACK = 1e-6

# Largest set size a literal table of class starts has to cover.
_MAX_SET_SIZE = 1 << 40


def min_partner_size(n: Column, threshold: float) -> Column:
    """``ceil(t * n)``: the fewest items a similar set must share with a set of n."""
    return F.ceil(F.lit(float(threshold)) * n)


def prefix_length(n: Column, threshold: float, size: int = 1) -> Column:
    """How many of its rarest items a set of ``n`` items has to expose."""
    return n - min_partner_size(n, threshold) + F.lit(size)


def length_filter(n_a: Column, n_b: Column, threshold: float) -> Column:
    """True when two set sizes are close enough to reach the threshold."""
    return F.greatest(n_a, n_b) * F.lit(float(threshold)) <= F.least(n_a, n_b)


def required_overlap(n_a: Column, n_b: Column, threshold: float) -> Column:
    """Fewest shared items with which two sets of these sizes can be similar."""
    share = threshold / (1.0 + threshold)
    return F.ceil((n_a + n_b) * F.lit(share) - F.lit(_SLACK))


def overlap_bound(n_a: Column, last_a: Column, n_b: Column, last_b: Column, shared: Column) -> Column:
    """Most items two sets can share if their first ``shared`` common items end at
    positions ``last_a`` and ``last_b`` of their sorted item lists."""
    return shared + F.least(n_a - last_a, n_b - last_b)


def overlap(items_a: Column, items_b: Column) -> Column:
    return F.size(F.array_intersect(items_a, items_b))


def jaccard(shared: Column, n_a: Column, n_b: Column) -> Column:
    """|A and B| / |A or B|, from the overlap and the two sizes."""
    return shared.cast("double") / (n_a + n_b - shared).cast("double")


def combinations_count(m: Column, k: int) -> Column:
    """m choose k as BIGINT; zero when m < k."""
    total = F.lit(1).cast("bigint")
    for i in range(k):
        # a product of i + 1 consecutive integers is divisible by (i + 1)!
        total = F.call_function("div", total * (m - F.lit(i)), F.lit(i + 1).cast("bigint"))
    return F.when(m < k, F.lit(0).cast("bigint")).otherwise(total)


def signature_text(items: Column, length_class: Column | None = None) -> Column:
    """Items joined by ';', with ``<class>_`` in front when a class is given."""
    text = F.concat_ws(";", F.transform(items, lambda x: x.cast("string")))
    if length_class is None:
        return text
    return F.concat(length_class.cast("string"), F.lit("_"), text)


def class_starts(threshold: float, largest: int = _MAX_SET_SIZE) -> list[int]:
    """Smallest set size of each length class, ascending.

    A class that starts at b covers as many sizes as a set of b items exposes
    prefix items, so the next one starts at b + (b - ceil(t * b) + 1).
    """

    def starts():
        start = 1
        while True:
            yield start
            start += start - math.ceil(threshold * start) + 1

    return list(takewhile(lambda s: s <= largest, starts()))


def _class_of(n: Column, threshold: float) -> Column:
    """(before, own): the start of the class of ``n`` and the one before it, 0 before the first.

    The plan holds every so-manieth class start, and the row steps on from there, so that
    both the table and the steps are the square root of the number of classes.
    """
    starts = class_starts(threshold)
    stride = max(1, math.isqrt(len(starts)))
    before = [0, *starts[:-1]]

    def table(numbers: list[int]) -> Column:
        return F.from_json(F.lit(str(numbers)), "array<bigint>")

    marks, marks_before = table(starts[::stride]), table(before[::stride])
    at = F.size(F.filter(marks, lambda s: s <= n)) - 1
    first = F.struct(F.get(marks_before, at).alias("before"), F.get(marks, at).alias("own"))

    def step(state: Column, _: Column) -> Column:
        following = _following(state["own"], threshold)
        on = F.struct(state["own"].alias("before"), following.alias("own"))
        return F.when(following <= n, on).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(stride)), first, step)


def _following(start: Column, threshold: float) -> Column:
    """Start of the class after the one that starts at ``start``, as in ``class_starts``."""
    return (start + prefix_length(start, threshold)).cast("bigint")


def length_classes(n: Column, threshold: float, mode: str = "reference") -> Column:
    """Length classes of a set of ``n`` items, as an array of class starts.

    ``"reference"`` gives the set's own class and, when the smallest similar
    set falls below it, the one class before (0 in front of the first).  Wide
    thresholds reach further down than that, so it can miss pairs.
    ``"complete"`` gives every class from the smallest similar set's upwards.
    """
    if mode not in ("reference", "complete"):
        raise ValueError(f"unknown length class mode: {mode!r}")
    n = n.cast("bigint")
    fewest = min_partner_size(n, threshold)
    if threshold == 1.0:  # every size is a class of its own
        return F.array(n)
    if mode == "complete":
        # from t * n to n a class start grows by a factor of 2 - t at least
        most = 3 + math.ceil(math.log(1 / threshold) / math.log(2 - threshold))

        def add(classes: Column, _: Column) -> Column:
            following = _following(F.element_at(classes, -1), threshold)
            return F.when(following <= n, F.array_append(classes, following)).otherwise(classes)

        first = F.array(_class_of(fewest, threshold)["own"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, add)
    own = _class_of(n, threshold)
    both = F.array(own["own"], own["before"])
    return F.when(fewest < own["own"], both).otherwise(F.array(own["own"]))
