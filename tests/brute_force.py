"""Plain Python models the Spark results are compared with."""

import itertools
import math
from collections import Counter


def families(rows):
    sets = {}
    for set_id, item in rows:
        sets.setdefault(set_id, set()).add(item)
    return sets


def similar_pairs(rows, threshold):
    """{(id_a, id_b): (overlap, jaccard)} by comparing every pair."""
    sets = families(rows)
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        sa, sb = sets[a], sets[b]
        if max(len(sa), len(sb)) * threshold > min(len(sa), len(sb)):
            continue
        shared = len(sa & sb)
        if shared and shared / len(sa | sb) >= threshold:
            out[a, b] = (shared, shared / len(sa | sb))
    return out


def class_list(n, threshold, mode):
    starts = [1]
    while True:
        b = starts[-1]
        following = 2 * b - math.ceil(threshold * b) + 1
        if following > n:
            break
        starts.append(following)
    fewest = math.ceil(threshold * n)
    if mode == "complete":
        first = max(i for i, s in enumerate(starts) if s <= fewest)
        return starts[first:]
    if fewest < starts[-1]:
        return [starts[-1], starts[-2] if len(starts) > 1 else 0]
    return [starts[-1]]


def signatures(rows, threshold, size=1, mode=None, order="frequency"):
    """[(set_id, class or None, items of the signature)]."""
    sets = families(rows)
    df = Counter(item for items in sets.values() for item in items)
    key = (lambda x: (df[x], x)) if order == "frequency" else (lambda x: x)
    out = []
    for set_id, items in sets.items():
        n = len(items)
        prefix = sorted(items, key=key)[: n - math.ceil(threshold * n) + size]
        combos = (
            list(itertools.combinations(prefix, size)) if len(prefix) >= size else [tuple(prefix)]
        )
        for combo in combos:
            for c in class_list(n, threshold, mode) if mode else [None]:
                out.append((set_id, c, combo))
    return out


def signature_join(rows, threshold, size=1, mode=None, order="frequency"):
    """(bag of similar pairs as a Counter, comparisons) found through shared signatures."""
    similar = similar_pairs(rows, threshold)
    sets = families(rows)
    buckets = {}
    for set_id, c, combo in signatures(rows, threshold, size, mode, order):
        buckets.setdefault((c, combo), []).append(set_id)
    bag, comparisons = Counter(), 0
    for ids in buckets.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            na, nb = len(sets[a]), len(sets[b])
            if max(na, nb) * threshold <= min(na, nb):
                comparisons += 1
                if (a, b) in similar:
                    bag[a, b] += 1
    return bag, comparisons
