"""Properties of the operators on literal rows."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import sets, structure, text, web
from quillspark.operators import concepts, feedback, frontier, merge, selection


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_variants(spark):
    assert value(spark, text.tokenize(F.lit("It’s  A  big—TEST x 42"))) == ["it's", "big", "test", "42"]
    got = value(spark, text.focus_words(F.array(F.lit("cities"), F.lit("malaysian"), F.lit("testing"))))
    assert {"cities", "city", "malaysian", "malaysia", "testing", "test", "teste"} <= set(got)
    assert value(spark, text.term_key(F.lit("The history of the ancient city and the river"))) == "history ancient city river"


def test_sentences_and_summary(spark):
    t = F.lit("First sentence is long enough. Short. Published in a year that nobody knows! The last one has many words here.")
    assert value(spark, F.size(text.sentences(t))) == 4
    assert value(spark, text.usable_sentences(t)) == ["First sentence is long enough.", "The last one has many words here."]
    assert value(spark, text.summarize(t, 40, 6)) == "First sentence is long enough. Short."
    assert value(spark, text.summarize(F.lit(None).cast("string"))) == ""


def test_empty_sets(spark):
    none = F.array().cast("array<string>")
    one = F.array(F.lit("a"))
    assert value(spark, sets.overlap(none, one)) == 0 and value(spark, sets.jaccard(one, none)) == 0 and value(spark, sets.jaccard(one, one)) == 1
    assert value(spark, sets.soft_member(F.lit("malaysia"), F.array(F.lit("malaysian"))))


def test_similarity_orders(spark):
    s = lambda a, b: value(spark, sets.lexical_similarity(F.lit(a), F.lit(b)))
    assert s("stock market growth", "growth of the stock market") > s("stock market growth", "recipes for apple cake")
    assert s("same", "same") == 1 and s("", "x") == 0


def test_urls(spark):
    urls = {"example.com/a b": "https://example.com/a b", " http://x.org/p. ": "http://x.org/p", "ftp://x.org": "", "javascript:alert(1)": "", "": "", "https://": ""}
    for u, want in urls.items():
        assert value(spark, web.normalize_url(F.lit(u))) == want, u
    assert value(spark, web.title_from_url(F.lit("https://www.a.org/docs/the-big_page.html?x=1"))) == "The Big Page"
    assert not value(spark, web.fetchable(F.lit("https://news.google.com/x"))) and not value(spark, web.fetchable(F.lit("https://a.org/x.pdf"))) and value(spark, web.fetchable(F.lit("https://a.org/x")))
    assert value(spark, web.authority(F.lit("https://en.wikipedia.org/wiki/A"), F.lit("short"), F.lit("Two words"))) == 0.89


def test_html(spark):
    page = F.lit("<title>A &amp; B</title><script>x</script><p>One</p><!-- no --><style>y</style> <b>two &lt;</b>")
    assert value(spark, web.html_title(page)) == "A & B" and value(spark, web.readable_text(page)) == "A & B One two <"


def test_ordered_fold(spark):
    rows = [(1, 0, "u1", "T1", "short", "a"), (1, 1, "u2", "t1", "much longer", "b"), (1, 2, "u2", "T3", "x", "c"), (1, 3, "U1", "T4", "y", "a")]
    got = merge.ordered_fold(spark.createDataFrame(rows, "query_id long, pos long, url string, title string, content string, provider string")).orderBy("pos").collect()
    # The row that joined by its title did not register its own URL.
    assert [(r["pos"], r["content"], r["providers"], r["n_merged"]) for r in got] == [(0, "much longer", ["a", "b"], 3), (2, "x", ["c"], 1)]


def test_gate(spark):
    rows = [(2, 0.9, 0.9, 0.9), (8, 0.45, 0.8, 0.6), (8, 0.3, 0.5, 0.2), (5, 0.5, 0.6, 0.6)]
    got = frontier.gate(spark.createDataFrame(rows, "real_count long, avg_frontier_score double, avg_relevance double, coverage_ratio double")).collect()
    assert [(r["use_fallback"], r["desired_count"]) for r in got] == [(True, 6), (False, 0), (True, 8), (True, 3)]


def _pool(n=12, seed=1):
    rng = random.Random(seed)
    words = lambda: [rng.choice("abcdefghijklmnop") for _ in range(8)]
    return selection.Pool(pd.DataFrame({"relevance": [rng.random() for _ in range(n)], "informative": 0.5, "spam": 0.1, "authority": [rng.random() for _ in range(n)], "words": [words() for _ in range(n)], "concepts": [words()[:3] for _ in range(n)], "focus": [list("abcdef")] * n}))


def test_search_keeps_the_best_and_stops():
    pool = _pool()
    chosen, history = selection.search(pool, 5, 10, 30)
    assert len(set(chosen)) == selection.target_size(12) == 6
    assert history == sorted(history) and pool.fitness(chosen) >= history[-1]
    assert selection.search(_pool(), 5, 10, 30) == (chosen, history)
    best = max(pool.fitness([int(i) for i in np.random.default_rng(s).permutation(12)[:6]]) for s in range(200))
    assert pool.fitness(chosen) >= best


def test_fitness_equals_the_search_on_random_sets(spark):
    rng = random.Random(3)
    words = lambda n: rng.sample("abcdefghijklmnop", n)
    rewards = {"relevance": 1.2, "evidenceDensity": 0.9, "diversity": 1.1, "structure": 1.35, "antiRedundancy": 0.82, "coherence": 1.3}
    for given in (None, rewards):
        rows = [(s, s, p, *(round(rng.random(), 4) for _ in range(5)), rng.randrange(12), words(6), words(rng.randrange(4)), list("abcdef")[: s + 1]) for s in range(4) for p in range(rng.randrange(1, 6))]
        table = spark.createDataFrame(rows, "set_id long, query_id long, place long, relevance double, informative double, authority double, spam double, coherence double, n_structure long, words array<string>, concepts array<string>, focus array<string>")
        focus = table.groupBy("query_id").agg(F.first("focus").alias("focus"))
        got = {r["set_id"]: r for r in selection.fitness(table.drop("focus"), focus, given).collect()}
        for s in range(4):
            pool = selection.Pool(table.where(F.col("set_id") == s).orderBy("place").toPandas(), given)
            assert abs(got[s]["total"] - pool.fitness(list(range(pool.n)))) <= 2e-6
            own = [r for r in rows if r[0] == s]
            assert abs(got[s]["structure"] - min(1.0, sum(r[8] for r in own) / (8 * len(own)))) <= 1e-6


def test_reward_profile(spark):
    recs = spark.createDataFrame([(1, "positive", ["too_generic"]), (2, "negative", ["too_generic", "repetitive"])], "record_id long, signal string, tags array<string>")
    got = {r["weight"]: r["value"] for r in feedback.reward_profile(recs).collect()}
    assert got["relevance"] == 1.2 and got["titleSpecificity"] == 1.23 and got["coherence"] == 1.06 and got["coverage"] == 1.08 and got["authority"] == 1.0


def test_concepts(spark):
    pairs = spark.createDataFrame([("stock market", "stock market"), ("stock market", "capital market"), ("stock market", "grid resilience")], "seed string, node string")
    assert {r["node"]: r["layer"] for r in concepts.layers(pairs).collect()} == {"stock market": "seed", "capital market": "related", "grid resilience": "tangential"}
    a = lambda t: value(spark, concepts.alignment(F.lit(t), "thomas_cup"))
    assert a("The Thomas Cup is a badminton event") > 0 > a("The FA cup is a football event") and a("") == -1


def test_concept_queries_cover_every_topic(spark, tmp_path):
    """Against brute force over literal tables: nothing but the tables decides what is expanded."""
    from quillspark.functions.lexicon import ALIASES, RELATIONS
    from quillspark.plans import catalogue

    topics = [(1, "Outlook of the  Malaysian stock market"), (2, "AI governance and risk controls"), (3, "zzz qqq"), (4, None), (5, "machine learning for grid resilience")]
    texts = [(10, "The stock market rose. Machine learning governance."), (11, "zzz capital market"), (12, "Nothing of that, zzz qqq"), (13, "risk controls for a resilience grid")]
    spark.createDataFrame(topics, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t, "en", "web", len(t)) for i, t in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    near = {}
    for a, bs in [*RELATIONS.items(), *ALIASES.items()]:
        for b in bs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    names = [(n, n) for n in ALIASES] + [(a, n) for n, al in ALIASES.items() for a in al]
    words = lambda t: set(value(spark, F.regexp_extract_all(F.lit(t), F.lit(text.TOKEN), F.lit(0))))
    own = {t: words(t) for t in {*near, *(a for a, _ in names)}}
    clean = lambda t: " ".join((t or "").lower().split())

    def seeds(t):
        w = words(t)
        first = {n for a, n in names if a in t or len(own[a] & w) / max(len(own[a]), 1) >= 0.8}
        return first or {n for n in near if own[n] and len(own[n] & w) >= min(len(own[n]), 2)}

    def hops(start, most):
        found, ring = {n: 0 for n in start}, set(start)
        for d in range(1, most + 1):
            ring = {b for a in ring for b in near.get(a, ())} - set(found)
            found |= dict.fromkeys(ring, d)
        return found

    want = set()
    for i, t in topics:
        ball = sorted(((d, len(n), n) for n, d in hops(seeds(clean(t)), 2).items() if n in near))
        want |= {(i, n, d, k) for k, (d, _, n) in enumerate(ball[:12], 1)}
    got = {(r["query_id"], r["node"], r["distance"], r["place"]) for r in catalogue.QUERIES["graph_expansion"](spark, str(tmp_path)).collect()}
    assert got == want and {q for q, *_ in got} >= {1, 2, 5}

    bench, table = dict(topics), dict(texts)
    ranked = frontier.rank(catalogue.table(spark, str(tmp_path), "benchmark"), catalogue.table(spark, str(tmp_path), "documents")).collect()
    layers = {(r["query_id"], r["doc_id"]): (r["distance"], r["layer"]) for r in catalogue.QUERIES["concept_layers"](spark, str(tmp_path)).collect()}
    assert ranked and set(layers) == {(r["query_id"], r["doc_id"]) for r in ranked}
    for (q, d), (distance, layer) in layers.items():
        a, b = clean(bench[q]), clean(table[d])
        far = hops(seeds(a), concepts.HOPS)
        best = min((far[n] for n in seeds(b) if n in far), default=None)
        if best is None:
            share = len(words(a) & words(b)) / len(words(b)) if words(b) else 0
            best = 0 if a == b or share >= 0.8 else 1 if share >= 0.3 else None
        assert (distance, layer) == (best, "tangential" if best is None or best > 2 else "seed" if best == 0 else "related")


def test_definitions(spark):
    t = F.lit("My river is a natural stream of water. Glaciers are slow rivers of ice on land. My river is named here a second time. It rained for days on end there.")
    got = value(spark, structure.definitions(F.lit("The water book"), t))
    assert [d["term"] for d in got] == ["The water book", "My river", "Glaciers"] and got[1]["description"] == "My river is a natural stream of water."
    none = F.lit(None).cast("string")
    assert value(spark, structure.definitions(none, none)) == [] and value(spark, structure.definitions(F.lit(""), F.lit(""))) == []


def test_relevance_and_phrases(spark):
    words = F.array(*[F.lit(w) for w in sorted("solar panel storage cost 2026".split())])
    assert value(spark, frontier.anchor_phrases(words)) == ["2026 cost panel", "cost panel solar", "panel solar storage", "2026 cost", "cost panel", "panel solar"]
    bench = spark.createDataFrame([(1, "solar panel storage"), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Solar panel storage\nThe storage of a solar panel is a battery.", "a"), (2, "Cooking\nA panel of cooks.", "a"), (3, None, "a"), (4, "", None)], "doc_id long, text string, source string")
    got = {(r["query_id"], r["doc_id"]): r for r in frontier.rank(bench, docs).collect()}
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1]["rank"] == 1 and got[1, 1]["relevance"] > got[1, 2]["relevance"]
