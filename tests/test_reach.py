"""Pairs that can enter a frontier: bounds, what tasks leave, blocks of queries."""

import pytest

from quillspark.operators import concepts, frontier, reach
from quillspark.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return catalogue.table(spark, SMALL, "benchmark"), catalogue.table(spark, SMALL, "documents")


def ranked(tables, limit=frontier.FRONTIER):
    """The rows of a ranking, and how many pairs it wrote."""
    own, written = frontier.stage, {}

    def stage(df, what):
        written[what] = own(df, what)
        return written[what]

    frontier.stage = stage
    try:
        rows = {(r["query_id"], r["doc_id"]): r for r in frontier.rank(*tables, limit).collect()}
    finally:
        frontier.stage = own
    return rows, {(r["query_id"], r["doc_id"]): r for r in written["pairs"].collect()}


def test_bounds_hold_and_tasks_leave_what_cannot_enter(tables, monkeypatch):
    every, pairs = ranked(tables, 1000)
    assert len(every) == len(pairs) == len(set(pairs))
    assert all(pairs[k]["low"] <= every[k]["score"] <= pairs[k]["high"] for k in every)
    best, fewer = ranked(tables)
    assert {k: r for k, r in every.items() if r["rank"] <= frontier.FRONTIER} == best
    assert len(best) <= len(fewer) < len(pairs)  # before, all pairs were written
    monkeypatch.setattr(reach, "QUERIES", 7)
    monkeypatch.setattr(reach, "CELLS", 40)
    assert ranked(tables)[0] == best


def test_distances_are_those_of_the_graph(spark):
    near = {}
    for a, b in concepts.pairs():
        near.setdefault(a, set()).add(b)
    got = {(r["a"], r["b"]): r["distance"] for r in concepts.distances(spark, 2).collect()}
    want = {(a, c): 2 for a in near for b in near[a] for c in near[b]} | {(a, b): 1 for a in near for b in near[a]} | {(a, a): 0 for a in near}
    assert got == want


def test_synthetic_sources_rank_once(spark, monkeypatch):
    own, calls = frontier.rank, []
    monkeypatch.setattr(frontier, "rank", lambda *a: calls.append(a) or own(*a))
    catalogue.QUERIES["synthetic_sources"](spark, SMALL)
    assert len(calls) == 1


def test_profiles_flatten_a_text_once(spark):
    plan = catalogue.QUERIES["profile_alignment"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 1
