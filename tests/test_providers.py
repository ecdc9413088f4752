"""Provider rows from stored payloads."""

import json

from quillspark.sources import providers


def test_crossref(spark):
    items = [
        {"title": ["Grid resilience planning"], "abstract": "We study grid resilience planning for cities. It covers outages, crews and restoration.", "author": [{"given": "A", "family": "Bee"}], "subject": ["Energy", "energy"], "DOI": "10.1/x", "issued": {"date-parts": [[2020, 1]]}},
        {"title": ["Cake"], "publisher": "P", "URL": "https://cake.example/1", "type": "journal-article"},
        {"title": []},
    ]
    df = spark.createDataFrame([(1, "grid resilience", json.dumps({"message": {"items": items}}))], "query_id long, query string, payload string")
    (row,) = providers.crossref(df).collect()
    assert row["url"] == "https://doi.org/10.1/x" and row["authority_score"] == 0.9 and "Subjects include Energy." in row["content"] and row["content"].endswith("Year: 2020.")


def test_openlibrary(spark):
    docs = [{"key": "/works/W1", "title": "Stock", "subtitle": "markets", "author_name": ["X"], "first_publish_year": 1990}, {"key": "/books/B1", "title": "No work"}]
    df = spark.createDataFrame([(1, "stock markets", json.dumps({"docs": docs}))], "query_id long, query string, payload string")
    works = spark.createDataFrame([("/works/W1", json.dumps({"description": {"value": "A long account of how stock markets came to be and what moves them today."}, "subjects": ["Finance"]}))], "key string, payload string")
    (row,) = providers.openlibrary(df, works).collect()
    assert row["url"] == "https://openlibrary.org/works/W1" and row["title"] == "Stock markets" and "First published 1990." in row["content"]


def test_result_links(spark):
    page = '<a class="r" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;z=1"><b>A</b> &amp; B</a><a class="r" href="https://a.org/x">again</a><a class="r" href="https://www.google.com/y">own</a>'
    df = spark.createDataFrame([(1, page.replace('href="//', 'href="https://'))], "query_id long, payload string")
    assert [(r["url"], r["title"]) for r in providers.result_links(df, "duckduckgo", '(?is)<a class="r" href="([^"]*)">(.*?)</a>').collect()] == [("https://a.org/x", "A & B")]
