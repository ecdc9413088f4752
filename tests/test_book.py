"""Titles and book assembly on literal rows and against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import structure
from quillspark.operators import book, titles
from quillspark.operators.clusters import TEMPLATES

QUESTION = "What is the most probable AI landscape over the next decade, considering investment flows and application domains, and how should enterprises respond?"
TEXTS = [
    ("AI investment flows and frontier model economics", "Investment flows in AI increasingly favor compute-intensive frontier models. Cloud infrastructure is the base of enterprise products with measurable productivity gains. Analysts expect steady funding for accelerator capacity in most regions."),
    ("Enterprise AI applications and workflow adoption", "High-value AI application domains include software engineering and industrial automation. Knowledge work assistance spreads through office suites, and scientific discovery follows. Workflow adoption is a slow process in regulated sectors."),
    ("AI governance, resilience and risk controls", "Capability building for AI requires governance, evaluation and procurement discipline. Model governance is the set of rules that keeps deployment safe. Risk mitigation plans describe incident response and recovery in detail."),
    ("Gardens of the coast", "Coastal gardens are planted with salt-tolerant shrubs and grasses. Wind shapes the trees along the cliffs, and sand covers the paths in winter. Visitors walk there in the late spring."),
]


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def sources(spark):
    focus = ["ai", "investment", "flows", "application", "domains", "landscape"]
    rows = [(q, i, 10 * q + i, t, c, round(0.9 - 0.1 * i, 2), 0.8, 0.7, focus, focus) for q in (1, 2) for i, (t, c) in enumerate(TEXTS[: 4 if q == 1 else 1], 1)]
    table = spark.createDataFrame(rows, "query_id long, place long, doc_id long, title string, content string, relevance double, informative double, authority double, words array<string>, focus array<string>")
    return structure.structured(table).cache()


@pytest.fixture(scope="module")
def chapters(spark, sources):
    queries = spark.createDataFrame([(1, QUESTION), (2, "gardens"), (3, "nothing chosen")], "query_id long, query string")
    return book.assemble(queries, sources).orderBy("query_id", "chapter").collect()


def test_every_query_with_sources_has_ten_chapters(chapters):
    assert [(r["query_id"], r["chapter"]) for r in chapters] == [(q, k) for q in (1, 2) for k in range(10)]


def test_no_sentence_twice(chapters):
    for q, n in ((1, 12), (2, 3)):
        used = [(s["place"], s["n"]) for r in chapters if r["query_id"] == q for s in r["sentences"] or []]
        assert len(used) == len(set(used)) == n  # all sentences, as the book is longer than the sources
    first = next(r for r in chapters if r["query_id"] == 1)
    assert 4 <= len(first["sentences"]) <= 6 and first["content"].count(". ") + 1 == len(first["sentences"]) and first["sources"]


def test_titles_begin_with_their_label_and_differ(chapters):
    own = [r["title"] for r in chapters if r["query_id"] == 1]
    assert all(t.startswith(label + ": ") for t, (label, _) in zip(own, TEMPLATES, strict=True)) and len(set(own)) == 10
    assert all(len(t) <= titles.CHARS and "What Is" not in t and "How Should" not in t for t in own)
    assert any(w in " ".join(own) for w in ("Investment Flows", "Frontier Model", "Workflow Adoption", "Governance"))


def test_items_rotate_before_they_repeat(chapters):
    seen = [d for r in chapters if r["query_id"] == 1 for d in r["definitions"] or []]
    fresh = list(dict.fromkeys(seen))
    assert seen[: len(fresh)] == fresh and all(len(r["definitions"] or []) <= book.DEFINITIONS for r in chapters)


def test_items_equal_a_plain_fold(spark):
    rng = random.Random(6)
    words = ["solar", "panel", "grid", "wind", "cost", "roof"]
    items = [(q, n, " ".join(rng.choices(words, k=2)).title(), " ".join(rng.choices(words, k=rng.randrange(8)))) for q in range(3) for n in range(9)]
    plan = [(q, k, rng.sample(words, 2)) for q in range(3) for k in range(4)]
    got = {(r["query_id"], r["chapter"]): [x["name"] for x in r["items"]] for r in book.pick_items(spark.createDataFrame(items, "query_id long, n long, name string, told string"), spark.createDataFrame(plan, "query_id long, chapter int, keywords array<string>"), 2).collect()}
    for q in range(3):
        used, own = set(), {}
        for _, n, name, told in [i for i in items if i[0] == q]:
            own.setdefault(name.lower(), (n, name, f"{name} {told}".lower().split()))
        for k in range(4):
            keys = next(p[2] for p in plan if p[:2] == (q, k))
            rank = sorted(own, key=lambda x: (x in used, -round(len(set(own[x][2]) & set(keys)) * 1.4 + min(len(own[x][2]) / 25, 0.5), 9), own[x][0]))[:2]  # noqa: B023
            used |= set(rank)
            assert got[q, k] == [own[x][1] for x in rank]


def _told(seed, n=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return book.Sentences(pd.DataFrame({"place": [rng.randrange(4) for _ in range(n)], "quality": [rng.random() for _ in range(n)], "base": [rng.random() for _ in range(n)],
                                        "words": [rng.sample(words, rng.randrange(5, 20)) for _ in range(n)], "focus": [words[:6]] * n}))


def test_search_is_no_worse_than_the_best_sentences_and_repeats():
    for seed in range(5):
        told = _told(seed)
        order = [int(i) for i in np.argsort(-told.base)]
        chosen = book.search(told, order, told.quality, np.random.default_rng(seed))
        assert len(set(chosen)) == len(chosen) and book.SHORTEST <= len(chosen) <= book.LONGEST
        assert told.fitness(chosen, told.quality) >= told.fitness(tuple(order[: len(chosen)]), told.quality)
        assert chosen == book.search(told, order, told.quality, np.random.default_rng(seed))
        words = set().union(*(set(told.words[i].tolist()) for i in chosen))
        want = len([w for w in words if told.in_focus[w]]) / 6 * 0.4 + told.quality[list(chosen)].mean() * 0.3 + len({told.place[i] for i in chosen}) / len(chosen) * 0.2 + max(0, 1 - abs(len(words) - 65) / 65) * 0.1
        assert told.fitness(chosen, told.quality) == pytest.approx(want, abs=1e-8)


def test_noise_of_sentences(spark):
    cases = {"Publisher: Acme, London": 0.72 + 0.45 + 0.18 + 0.22, "Rivers carry fine sand to the sea": 0.0, "One, two, three, four, five, six rivers meet": 0.12, "Its first edition came out late last year": 0.18, "": 0.22}
    got = {t: _value(spark, book.noise(F.lit(t), F.lit(len(t.split())))) for t in cases}
    assert got == {t: pytest.approx(v) for t, v in cases.items()}


def test_compact_phrases(spark):
    cases = {
        "What is the AI landscape (2026), and how should firms respond?": "AI Landscape", "solar-panel / wind tariffs of the NASA programme": "Solar Panel Wind Tariffs NASA", "The Solar solar SOLAR roof": "Solar Roof",
        "": "", "what should": "", "2026 ml budget! And more": "2026 ML Budget"}
    assert {t: _value(spark, titles.compact(F.lit(t))) for t in cases} == cases
    assert _value(spark, titles.trimmed(F.lit("Label:   " + "word " * 30))) == "Label: " + " ".join(["word"] * 16)
    assert _value(spark, titles.trimmed(F.lit("x" * 100))) == "x" * 88
    assert _value(spark, titles.soft_share(F.array(F.lit("market"), F.lit("governance")), F.array(F.lit("governing"), F.lit("risk")))) == 0.5


def test_best_titles_follow_their_rules(spark):
    phrases = ["stock market", "Foundations", "review", "Bursa Malaysia", "dividend yields", "xi", "market report"]
    candidates = spark.createDataFrame([(1, 0, p, 0.1, i) for i, p in enumerate(phrases)], "query_id long, chapter int, phrase string, bonus double, n long")
    chapter = spark.createDataFrame([(1, 0, "Foundations", ["definition"], "", "the stock market", ["stock", "market", "markets"]), (2, 0, "Core Concepts", ["core"], "", "solar roofs", ["solar", "roofs"]), (3, 0, "Core Concepts", ["core"], "battery storage", "", [])], "query_id long, chapter int, label string, keywords array<string>, path string, query string, focus array<string>")
    topics = spark.createDataFrame([(1, 1, "Dividend Yields", 1.0)], "query_id long, place int, label string, divergence double")
    got = {r["query_id"]: r["title"] for r in titles.best_titles(candidates, chapter, topics, 10).collect()}
    # The query, the label, weak words and weak words with a focus word cannot be titles; a topic's branch decides.
    assert got == {1: "Foundations: Dividend Yields", 2: "Core Concepts: Solar Roofs Key Concepts", 3: "Core Concepts: Battery Storage"}
