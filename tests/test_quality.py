"""Measures of sources and books, and their distributions, against plain Python."""

import random
import re
import statistics

import pytest

from quillspark.functions.text import STOP_WORDS
from quillspark.operators import quality

SOURCES = "query_id long, place long, title string, content string, relevance double, authority double, focus array<string>"
WORDS = ["solar", "panel", "the", "grid", "wind", "cost", "roof", "of", "a1"]


def _tokens(text):
    return set(re.findall("[a-z0-9']{2,}", (text or "").lower()))


def _mean_overlap(sets):
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    return sum(len(a & b) / len(a | b) if a and b else 0.0 for a, b in pairs) / len(pairs) if pairs else 0.0


def test_measures_equal_plain_python(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    sources = [(q, p, rng.choice([None, text(2)]), rng.choice([None, "", text(9)]), round(rng.random(), 3), round(rng.random(), 3), WORDS[: q * 2]) for q in range(4) for p in range(1, q + 2)]
    chapters = [(q, k, f"Chapter {text(1)}", text(rng.randrange(8))) for q in range(3) for k in range(q * 2)]
    got = {r["query_id"]: r for r in quality.measures(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(chapters, "query_id long, chapter int, title string, content string")).collect()}
    for q in range(4):
        own, book = [s for s in sources if s[0] == q], [c for c in chapters if c[0] == q]
        said = set().union(*(_tokens(f"{s[2] or ''} {s[3] or ''}") for s in own))
        want = {
            "average_relevance": statistics.mean(s[4] for s in own), "average_authority": statistics.mean(s[5] for s in own), "focus_coverage": len(said & set(own[0][6])) / len(own[0][6]) if own[0][6] else 1.0,
            "redundancy": _mean_overlap([_tokens(s[3]) - set(STOP_WORDS) for s in own]), "chapter_distinctness": 1 - _mean_overlap([_tokens(f"{c[2]} {c[3]}") for c in book])}
        assert {m: got[q][m] for m in quality.METRICS} == {m: pytest.approx(v, abs=1e-6) for m, v in want.items()}
        assert (got[q]["n_sources"], got[q]["n_chapters"]) == (len(own), len(book))


def test_distribution_equals_plain_python(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float(rng.randrange(6)), rng.random()])) for g in "abc" for _ in range({"a": 41, "b": 1, "c": 6}[g])] + [("d", None)]
    got = {r["g"]: r for r in quality.distribution(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        x = sorted(v for k, v in rows if k == g and v is not None)
        if not x:
            assert g not in got
            continue
        at = lambda p: x[int((len(x) - 1) * p)] + (x[min(int((len(x) - 1) * p) + 1, len(x) - 1)] - x[int((len(x) - 1) * p)]) * ((len(x) - 1) * p % 1)  # noqa: B023, E731
        want = {"n": len(x), "mean": statistics.mean(x), "median": statistics.median(x), "stdev": statistics.pstdev(x), "lowest": x[0], "highest": x[-1], "p25": at(0.25), "p75": at(0.75)}
        assert {k: got[g][k] for k in want} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert "d" not in got


def test_suite_has_a_pack_for_each_tag_and_one_for_all(spark):
    rows = [(1, "place", *[0.5] * 5), (2, "place", *[0.7] * 5), (3, None, *[0.9] * 5)]
    got = {(r["pack"], r["metric"]): (r["n"], r["mean"]) for r in quality.suite(spark.createDataFrame(rows, "query_id long, archetype string, " + ", ".join(f"{m} double" for m in quality.METRICS)), "archetype").collect()}
    assert got == {(p, m): v for m in quality.METRICS for p, v in (("all", (3, 0.7)), ("place", (2, 0.6)), ("", (1, 0.9)))}
