"""What one task holds and what is shuffled, on tables of a few rows."""

import pytest

from nearset.operators import signatures, simjoin
from nearset.operators.signatures import Scheme, nest_prefix, prefix_rows, rank_items


@pytest.mark.parametrize("options", [{}, {"signature_size": 2}, {"length_classes": "complete"}, {"adaptive": True}])
def test_small_sets_are_compared_where_they_meet(spark, options):
    """candidates of small sets are not shuffled; only pairs with a wide set are listed."""
    wide = [(100 + s, i) for s in (0, 1) for i in range(s, 40 + s)]
    sets = {s: {s % 7 + k * (s % 3 + 1) for k in range(1 + s % 5)} for s in range(60)}
    rows = wide + [(s, i) for s, items in sets.items() for i in items]
    df = spark.createDataFrame(rows, "u long, m long")
    scheme = Scheme(0.3, options.get("signature_size", 1), options.get("length_classes"), adaptive=options.get("adaptive", False))
    prepared = simjoin.prepare(simjoin.unique_rows(simjoin.item_rows(df, "u", "m")), scheme)
    signed, blocks, sought = simjoin.join_keys(prepared.sets, scheme)
    listed = simjoin.wide_candidates(signed, scheme, blocks, sought)
    assert [(r.a, r.b) for r in listed.collect()] == [(100, 101)]
    met = simjoin.verified_inline(signed, scheme, blocks, sought)
    assert met.where("n_b > 32").isEmpty()
    if options.get("signature_size") is None:
        got = {(r.id_a, r.id_b): r.overlap for r in simjoin.similarity_join(df, "u", "m", 0.3, **options).collect()}
        content = sets | {100 + s: set(range(s, 40 + s)) for s in (0, 1)}
        expected = {
            (a, b): len(content[a] & content[b])
            for a in content
            for b in content
            if a < b and len(content[a] & content[b]) / len(content[a] | content[b]) >= 0.3
        }
        assert got == expected


def _nodes(df, name):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count(name)


def test_prefixes_are_nested_without_an_aggregate(spark):
    """ranked rows lie in order, so nesting them neither gathers nor sorts them again."""
    rows = spark.createDataFrame([(s, i) for s in range(5) for i in range(s, s + 4)], "set_id long, item long")
    ranked = rank_items(rows)
    nested = nest_prefix(prefix_rows(ranked, Scheme(0.5, 2)))
    assert _nodes(nested, "Aggregate") == 0
    planned = nested._jdf.queryExecution().executedPlan().toString()
    assert planned.split("Window", 1)[1].count("Sort [set_id") == 1
    assert sorted((r.set_id, r.n, len(r["items"])) for r in nested.collect()) == [(s, 4, 4) for s in range(5)]


def test_ranking_deals_rows_out_where_partitions_are_few(spark, monkeypatch):
    """the rows that one task ranks do not grow with the table."""
    rows = spark.createDataFrame([(s, i) for s in range(40) for i in range(5)], "set_id long, item long")
    plain = sorted(map(tuple, rank_items(rows).collect()))
    monkeypatch.setattr(signatures, "TASK_ROWS", 1)
    ranked = rank_items(rows)
    assert "REPARTITION_BY_NUM" in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ranked.collect())) == plain
