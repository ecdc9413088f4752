"""What a pass over many texts finds is what the column functions give of each."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import rules, text, web
from quillspark.operators import frontier, reach, scan
from quillspark.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "", " \n\t ", "a", "One. Two!  Three?\nFour ", "\n\n  Leads with blanks. And (more). ", "Title is here\nThe Basics of tests. Anna met Berta. Carl left", "x y’s co­op “q”… End—of it. Is​land",
    "Kelvin and İstanbul naïve École", "aaaaaaaa bbbbbbb", "é" * 8, " " * 9, "abababababababababab", "12345 1234567890", "ab12cd34ef x_ab12cd34ef ab12cd34ef_ 0123456789 abcdefghij",
    "Click\nhere and click  here", "here we can click\nhere", "Top 10 things\nTop\x0b5", "Published in 1990 by somebody else. Work type: a long enough sentence.  Authors: Someone Else Somewhere. Fine sentences remain here, too.",
    "This is long enough to count. " * 5 + "Live retrieval is what this sentence names.", "word " * 30, "Privacy Policy and terms of\tservice K. ok", "‚‘quoted’ «words» don’t", "end.", "No line end . ! ?  ", "A. B. Capital Words Here.\x0bNot", None]


def rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("source", F.lit("s"))
    return frontier.sources(docs.unionByName(catalogue.table(spark, SMALL, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "source")))


def scanned(docs):
    return scan.Scan(pa.array([r["content"] for r in docs], pa.string()), frontier.DEFINING, frontier.LISTICLE, frontier.SPAM_TERMS)


def test_marks_and_words_are_those_of_the_columns(spark):
    c, title, content = F.col, F.col("title"), F.col("content")
    docs = rows(spark)
    flat = frontier.flat(F.concat_ws(" ", title, content))
    docs = docs.withColumns({
        "tokens": text.tokenize(content), "t": F.array_distinct(text.tokenize(title)), "c": F.array_distinct(text.tokenize(content)), "e": F.array_distinct(text.words_of(flat)),
        "proper": F.array_distinct(rules.proper_words(content)), "sentences": text.sentence_count(content), "usable": F.size(text.usable_sentences(content)), "n_title": F.size(text.tokenize(title)),
        "definitional": frontier.definitional_density(title, content), "depth": frontier.content_depth(content), "spam": frontier.spam_risk(title, content),
        "authority": web.authority(F.lit(""), content, title)}).orderBy("doc_id").collect()
    got = scanned(docs)
    for name, words in (*got.words.items(), ("proper", got.proper)):
        own = [[] for _ in docs]
        for row, code in zip(words.row.tolist(), words.code.tolist(), strict=True):
            own[row].append(words.words[code].as_py())
        for r, w in zip(docs, own, strict=True):
            assert len(w) == len(set(w)) and set(w) == set(r[name] or []), (name, r["content"])
    assert got.marks["n_tokens"].tolist() == [len(r["tokens"]) for r in docs]
    for name in ("sentences", "usable", "n_title"):
        assert [(r["content"], n) for r, n in zip(docs, got.marks[name].tolist(), strict=True)] == [(r["content"], r[name]) for r in docs], name
    marks = [{"doc_id": r["doc_id"], "n_c": int(n), **{m: int(got.marks[m][i]) for m in scan.MARKS}} for i, (r, n) in enumerate(zip(docs, got.words["c"].sizes(len(docs)), strict=True))]
    numbers = {r["doc_id"]: r for r in spark.createDataFrame(marks).withColumns(frontier.numbers()).collect()}
    known = [r for r in docs if r["content"] is not None]  # a null text has no word, so it is no candidate
    for name in ("definitional", "depth", "spam", "authority"):
        assert [(r["content"], numbers[r["doc_id"]][name]) for r in known] == [(r["content"], r[name]) for r in known], name
    bounds = reach.numbers_of(got.marks, got.words["c"].sizes(len(docs)))
    exact = [r["definitional"] * 0.16 + r["authority"] * 0.13 + r["depth"] * 0.12 - r["spam"] * 0.18 for r in docs]
    assert np.abs(bounds - exact)[[r["content"] is not None for r in docs]].max() < reach.SLACK / 2


def test_documents_are_cut_once_in_the_tasks(spark):
    """Before, some twenty expressions over each whole text ran in the pass over all documents."""
    docs = frontier.sources(catalogue.table(spark, SMALL, "documents"))
    queries = frontier.asked(catalogue.table(spark, SMALL, "benchmark"))
    about = queries.select("query_id", "phrases", "profiles", "most_grams", *[x for x in queries.columns if x.startswith("n_")])
    plan = frontier.in_sight(queries, about, docs, frontier.FRONTIER)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "translate(" not in plan and "MapInArrow" in plan


def test_portions_hold_all_rows(monkeypatch):
    monkeypatch.setattr(reach, "BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"content": ["abc", None, "x" * 50, "", "yy", "z" * 9, "q"]})
    parts = list(reach.portions(batch, 3))
    assert sum((p.column("content").to_pylist() for p in parts), []) == batch.column("content").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2, 2]


def test_grams_in_numbers_are_those_of_sets():
    texts = ["", "abc", "abcd", "abcdabcd", "the quick brown fox", "the quick fox is brown", "naïve quick — fox", "emoji \U0001f600 quick fox", "emoji \U0001f600 brown fox"]
    sets = [frozenset(t[i : i + 4] for i in range(len(t) - 3)) for t in texts]
    for a, x in zip(texts, sets, strict=True):
        assert frontier.Prepared(a).n_grams == len(x)
        for b, y in zip(texts, sets, strict=True):
            assert frontier.common_grams(frontier.Prepared(a), frontier.Prepared(b)) == len(x & y)


def test_a_document_travels_once_for_all_its_queries(spark, monkeypatch):
    own, given = frontier.side_by_side, []
    monkeypatch.setattr(frontier, "side_by_side", lambda rows: given.append(rows) or own(rows))
    frontier.rank(catalogue.table(spark, SMALL, "benchmark"), catalogue.table(spark, SMALL, "documents"))
    ids = [r["doc_id"] for r in given[0].select("doc_id").collect()]  # before, a row for each pair
    assert len(ids) == len(set(ids)) and "asks" in given[0].columns


def test_queries_on_the_frontier_handle_its_texts_alone(spark, monkeypatch):
    """Before, all documents met the frontier, and semantic_filter normalised each of them first."""
    pairs = spark.createDataFrame([(q, d, r) for q in range(3) for r, d in enumerate(range(q, q + 4), 1)], "query_id long, doc_id long, rank int")
    monkeypatch.setattr(frontier, "rank", lambda *_: pairs)
    for name in ("semantic_filter", "informative_score", "fallback_informative"):
        assert not [f for f in catalogue.QUERIES[name](spark, SMALL).inputFiles() if "documents" in f], name
