"""Latent similarity, topics, clusters, assignment, archetypes and labels against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import structure
from quillspark.functions.text import STOP_WORDS
from quillspark.operators import archetypes, clusters, latent

GROUPS = {
    1: ["grid resilience planning overview", "utility restoration priorities and asset hardening of the grid", "continuity metrics for electric networks", "grid grid planning"],
    2: ["movie soundtrack awards", "", None, "luxury retail expansion", "concert ticket bundle, movie ticket"],
    3: ["alone"], 4: ["the and of", "of the"], 5: ["same words here"] * 3,
}


def _texts(spark, groups=GROUPS):
    return spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "group long, pos long, text string")


def _terms(text):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _matrix(texts):
    held = [_terms(t) for t in texts]
    names = sorted({t for h in held for t in h})
    x = np.zeros((len(texts), len(names)))
    for i, h in enumerate(held):
        for j, name in enumerate(names):
            if name in h:
                x[i, j] = (1 + math.log(h.count(name))) * (math.log((1 + len(texts)) / (1 + sum(name in o for o in held))) + 1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=x, where=size > 0), names


def _latent(texts, k=3):
    x, names = _matrix([t for t in texts if t and t.strip()])
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    k = min(len(x) - 1, len(names) - 1, k)
    if len(x) < 3 or k < 1:
        return 0.0
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    p = u[:, :k] * s[:k]
    size = np.linalg.norm(p, axis=1)
    cosines = [p[i] @ p[j] / (size[i] * size[j]) if size[i] * size[j] > 1e-12 else 0.0 for i in range(len(p)) for j in range(i + 1, len(p))]
    return min(1.0, max(0.0, sum(cosines) / len(cosines)))


def test_latent_similarity_equals_a_singular_value_decomposition(spark):
    got = {r["group"]: r["latent"] for r in latent.group_similarity(_texts(spark)).collect()}
    for g, texts in GROUPS.items():
        assert got.get(g, 0.0) == pytest.approx(_latent(texts), abs=2e-6), g
    assert got[5] == 1.0


def test_coherence_prefers_sections_that_fit(spark):
    sections = {
        1: ("grid resilience planning overview", "utility restoration priorities and asset hardening", "continuity metrics for electric networks"),
        2: ("movie soundtrack awards campaign", "luxury retail expansion strategy", "concert ticket bundle performance"), 3: (None, " ")}
    queries = spark.createDataFrame([(g, "Grid resilience  planning") for g in (1, 2, 3, 4)], "group long, query string")
    got = {r["group"]: r for r in latent.coherence(queries, _texts(spark, sections)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["coherence"] > got[2]["coherence"] and got[3]["coherence"] == got[4]["coherence"] == 0.0
    want = got[1]["to_query"] * 0.45 + got[1]["to_each_other"] * 0.40 + got[1]["latent"] * 0.15
    assert got[1]["coherence"] == pytest.approx(want, abs=2e-6) and got[1]["latent"] == pytest.approx(_latent(["grid resilience planning", *sections[1]]), abs=2e-6)


def test_factors_come_near_and_stay_non_negative():
    rng = np.random.default_rng(2)
    x = rng.random((7, 3)) @ rng.random((3, 20))
    w, h = latent.factors(x, 3)
    start = latent.start(x, 3)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(x - w @ h) < 0.1 * np.linalg.norm(x - start[0] @ start[1])
    assert all(np.array_equal(a, b) for a, b in zip(latent.factors(x, 3), (w, h), strict=True))


def test_branches_join_what_is_near():
    points = np.array([[0.0], [10.0], [0.1], [10.1], [5.0]])
    assert latent.branches(points, 3) == [0, 1, 0, 1, 2] and len(set(latent.branches(points, 2))) == 2


def test_subtopics_of_a_corpus(spark):
    corpus = [
        "Exchange performance is shaped by foreign investment flows and sector rotation.", "Commodity pricing and energy exports influence equities and earnings revisions.",
        "Regulatory policy, listing rules and market oversight shape confidence.", "Dividend yields and valuation multiples remain central to investor positioning."]
    queries = spark.createDataFrame([(1, "outlook for the stock market"), (2, "outlook"), (3, "")], "group long, query string")
    texts = _texts(spark, {1: corpus, 2: ["one text"], 3: [None]})
    rows = latent.subtopics(queries, texts, most=5).orderBy("group", "place").collect()
    assert {r["group"] for r in rows} <= {1, 2} and len([r for r in rows if r["group"] == 1]) >= 3
    own = [r for r in rows if r["group"] == 1]
    assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and len({r["label"].lower() for r in own}) == len(own)
    assert all(0 <= r["pos"] < 4 and 0 <= r["divergence"] <= 1 and set(r["label"].lower().split()) <= set(r["keywords"]) for r in own)
    assert sorted(r["divergence"] for r in own)[::-1] == [r["divergence"] for r in own]
    assert rows == latent.subtopics(queries, texts.orderBy(F.desc("pos")), most=5).orderBy("group", "place").collect()


# ---------------------------------------------------------------- clusters


def _random_sources(seed, queries=5):
    rng = random.Random(seed)
    vocabulary = ["solar", "panel", "storage", "battery", "grid", "tariff", "wind", "turbine", "policy", "market", "cost", "roof"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for q in range(queries):
        focus = rng.sample(vocabulary, rng.randrange(4))
        for place in range(1, rng.randrange(2, 8)):
            title = rng.choice([text(2), text(3), "", "the of"])
            rows.append((q, place, 100 * q + place, title, text(rng.randrange(30)), round(rng.random(), 6), focus, [(text(2), "d") for _ in range(rng.randrange(3))], [(text(3), "s") for _ in range(rng.randrange(2))]))
    return rows


SOURCES = "query_id long, place long, doc_id long, title string, content string, relevance double, focus array<string>, definitions array<struct<term:string,description:string>>, subtopics array<struct<title:string,summary:string>>"


def _words(text):
    return [w for w in re.findall("[a-z0-9']{2,}", text.lower()) if w not in STOP_WORDS]


def _alike(a, b):
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    if not a or not b:
        return 0.0
    x, y = (set(re.findall("[a-z0-9']{2,}", t)) for t in (a, b))
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b)]
    return 1.0 if a == b else round(share(x, y) * 0.55 + share(*grams) * 0.45, 6) if x and y else 0.0


def _brute_clusters(rows):
    out = []
    for _, place, _, title, content, relevance, focus, defined, topics in sorted(rows, key=lambda r: r[1]):
        names = [title, *(t for t, _ in defined), *(t for t, _ in topics)]
        terms = {w for n in names for w in _words(n)} | set(_words(content)[:18])
        key = lambda t: " ".join(_words(t)[:6])
        lead = " ".join(f"{title} {content[:320]}".lower().split())
        best, score = None, 0.0
        for c in out:
            s = len(c["terms"] & terms) / len(c["terms"] | terms) if c["terms"] and terms else 0.0
            s += (0.18 if key(title) and key(title) in c["keys"] else 0.0) + 0.3 * len(terms & set(focus)) / max(len(focus), 1) + 0.26 * _alike(lead, c["told"])
            if round(s, 9) > score:
                best, score = c, round(s, 9)
        if best is None or score < 0.18:
            best = {"id": len(out), "label": "", "terms": set(), "keys": set(), "places": [], "titles": [], "defined": [], "topics": [], "relevance": []}
            out.append(best)
        best["terms"] |= terms
        for k, v in (("places", [place]), ("titles", [title]), ("defined", [t for t, _ in defined]), ("topics", [t for t, _ in topics]), ("relevance", [relevance])):
            best[k] = best[k] + v
        parts = [best["label"], " ".join(best["titles"][:3]), " ".join(best["defined"][:4]), " ".join(best["topics"][:4])]
        best["told"] = " ".join(" ".join(p for p in parts if p).lower().split())
        best["keys"] |= {key(n) for n in names if key(n)}
        named = []
        for i, n in enumerate(names):
            w = set(_words(n))
            if w:
                named.append((len(w & set(focus)) / len(w) * 1.2 + min(len(w) / 6, 1) * 0.35 + relevance * 0.55, -i, n))
        best["label"] = max(named)[2] if named else best["label"] or title
    for c in out:
        c["mean"] = round(sum(c["relevance"]) / len(c["relevance"]), 9)
    return sorted(out, key=lambda c: (-c["mean"], -len(c["places"]), -len(c["terms"]), c["id"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_a_fold(spark, seed):
    rows = _random_sources(seed)
    got = {}
    for r in clusters.leader_clusters(spark.createDataFrame(rows, SOURCES)).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["cluster"], list(r["places"]), set(r["terms"]), r["relevance"], r["label"]))
    for q in {r[0] for r in rows}:
        want = _brute_clusters([r for r in rows if r[0] == q])
        assert [g[:4] for g in got[q]] == [(c["id"], c["places"], c["terms"], pytest.approx(c["mean"])) for c in want]
        assert [g[4] for g in got[q]] == [c["label"] for c in want]


def test_no_sources_no_clusters(spark):
    assert clusters.leader_clusters(spark.createDataFrame([], SOURCES)).count() == 0


def test_assignment_equals_rounds_of_argmax(spark):
    rng = random.Random(5)
    words = [w for _, ws in clusters.TEMPLATES for w in ws]
    rows = [(q, c, p, rng.sample(words, 9), list(range(rng.randrange(1, 5))), round(rng.random(), 3)) for q in range(4) for p, c in enumerate(rng.sample(range(4), 4), 1)]
    focus = {q: rng.sample(words, q) for q in range(4)}
    got = {}
    table = spark.createDataFrame(rows, "query_id long, cluster int, place int, terms array<string>, places array<int>, relevance double")
    for r in clusters.assign(table, spark.createDataFrame(list(focus.items()), "query_id long, focus array<string>")).orderBy("query_id", "chapter").collect():
        got.setdefault(r["query_id"], []).append(r["cluster"])
    for q in range(4):
        used, want = {}, []
        for _, keywords in clusters.TEMPLATES:
            score = lambda r: round(r[5] * 0.8 + len(set(r[3]) & set(keywords)) / len(keywords) * 0.7 + (len(set(r[3]) & set(focus[q])) / len(focus[q]) if focus[q] else 0) * 0.35 + min(len(r[4]) / 3, 1) * 0.18 - used.get(r[1], 0) * 0.22, 8)  # noqa: B023, E731
            best = max((r for r in rows if r[0] == q), key=lambda r: (score(r), -r[2]))
            used[best[1]] = used.get(best[1], 0) + 1
            want.append(best[1])
        assert got[q] == want


def test_subtopic_candidates(spark):
    rows = [
        (1, 1, "Solar book", "Solar panels turn light into electric current. Cheap batteries store the spare solar energy of long summer days, some say. Cheap batteries store the spare solar energy of short winter days. Short one here now. Roof tiles with hidden cells look like plain old slate.", ["solar"], ["solar", "energy"]),
        (1, 2, "One sentence", "There is nothing but one sentence in this text.", ["solar"], []), (1, 3, None, None, [], []), (1, 4, "", "", [], [])]
    got = {r["doc_id"]: [(x["title"], x["summary"][:12]) for x in r["subtopics"]] for r in structure.subtopics(spark.createDataFrame(rows, "query_id long, doc_id long, title string, content string, words array<string>, focus array<string>")).collect()}
    # Both battery sentences have both focus words and one title; the first one stays, the tiles follow.
    assert got == {1: [("Cheap Batteries Store Spare Energy", "Cheap batter"), ("Roof Tiles Hidden Cells Look", "Roof tiles w")], 2: [("Context for One sentence", "There is not")]}


# ---------------------------------------------------------------- archetypes and labels


def test_archetypes_on_literal_rows(spark):
    asked = {
        1: ("how will the iran war go", [], "impact"), 2: ("thomas cup 2026 chances", [], "generic"), 3: ("acme vs zenith revenue", [], "organization"), 4: ("the bank of fishes", [], "organization"),
        5: ("commodity exports", [], "market"), 6: ("rocket launch", [], "technology"), 7: ("mount kara", [], "place"), 8: ("a small island", [], "place"), 9: ("Ada Lovelace", [], "person"),
        10: ("Which Ada", [], "generic"), 11: ("quiet evenings", ["She was a writer, (born 1815) and author"], "person"), 12: ("quiet evenings", ["glacier and summit with a peak in the valley"], "place"),
        13: ("quiet evenings", ["commodity demand, liquidity and trade"], "market"), 14: (None, [], "generic"), 15: ("quiet evenings", ["x" * 420 + " commodity demand, liquidity and trade"], "generic")}
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in asked.items()], "query_id long, query string")
    rows = spark.createDataFrame([(i, k, None, t) for i, (_, ts, _) in asked.items() for k, t in enumerate(ts, 1)], "query_id long, rank int, title string, content string")
    got = {r["query_id"]: r["archetype"] for r in archetypes.infer(queries, rows).collect()}
    assert got == {i: a for i, (_, _, a) in asked.items()}


def _blocks(a, b):
    """Characters in matching blocks by their definition: the longest, earliest in a, then in b."""
    best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in [next(k for k in range(len(a) + 1) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k])]), default=(0, 0, 0))
    n, i, j = best[0], -best[1], -best[2]
    return n + _blocks(a[:i], b[:j]) + _blocks(a[i + n :], b[j + n :]) if n else 0


def test_block_ratio_equals_its_definition():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(14))) for _ in range(2))
        assert archetypes.block_ratio(a, b) == (2 * _blocks(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_canonical_labels(spark):
    queries = spark.createDataFrame([(1, "mahathir mohamad"), (2, "solar power"), (3, None)], "query_id long, query string")
    rows = [(1, 1, "Something else"), (1, 2, "Mahathir Mohammad - biography"), (1, 3, "Mahathir Mohamad (politician)"), (2, 1, "Solar"), (2, 2, None), (1, 9, "mahathir mohamad")]
    got = {r["query_id"]: r["label"] for r in archetypes.canonical_labels(queries, spark.createDataFrame(rows, "query_id long, rank int, title string")).collect()}
    assert got == {1: "Mahathir Mohamad", 2: "solar power", 3: ""}
