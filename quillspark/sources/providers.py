"""Rows of search providers from stored payloads: JSON of metadata services, HTML of result pages.

Payloads lie in tables (query_id, query, payload); nothing here reads the network. Each function
gives query_id, pos, url, title, content, informative_score, authority_score, provider, with the
best `limit` rows of each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import jaccard
from ..functions.text import normalize_space, sentences
from ..functions.web import normalize_url, search_internal, unescape

ROW = ["query_id", "pos", "url", "title", "content", "informative_score", "authority_score", "provider"]


def comparable(text: Column) -> Column:
    """The distinct words of three letters or more, without marks."""
    plain = F.replace(F.lower(normalize_space(unescape(text))), F.lit("&"), F.lit(" and "))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 3))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(comparable(a), comparable(b))


def listed(items: Column, limit: int) -> Column:
    """The first distinct values, without regard to case, joined by commas."""
    start = F.array().cast("array<string>")
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    add = lambda xs, x: F.when((x == "") | F.array_contains(lower(xs), F.lower(x)), xs).otherwise(F.concat(xs, F.array(x)))
    values = F.aggregate(F.transform(F.coalesce(items, start), normalize_space), start, add)
    return F.array_join(F.slice(values, 1, limit), ", ")


def excerpt(blocks: Column, max_chars: int = 2200) -> Column:
    """Sentences of the blocks in order, none too like one before, within the budget."""
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        seen = F.exists(s["kept"], lambda k: similarity(k, x) >= 0.9)
        longer = F.concat(s["kept"], F.array(x))
        over = (F.size(s["kept"]) > 0) & (F.length(F.array_join(longer, " ")) > max_chars)
        keep = ~s["full"] & ~seen & ~over
        return F.struct(F.when(keep, longer).otherwise(s["kept"]).alias("kept"), (s["full"] | (~seen & over)).alias("full"))

    every = F.flatten(F.transform(blocks, sentences))
    return F.substring(F.array_join(F.aggregate(every, state, step)["kept"], " "), 1, max_chars)


def _said(form: str, value: Column) -> Column:
    return F.when(value != "", F.format_string(form, value)).otherwise("")


def _best(rows: DataFrame, limit: int, provider: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("_score"), "_at")
    rows = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).withColumn("provider", F.lit(provider))
    return rows.withColumns({c: F.round(c, 4) for c in ("informative_score", "authority_score")}).select(*ROW)


_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    "message struct<items:array<struct<title:array<string>,abstract:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,subject:array<string>,"
    f"publisher:string,type:string,DOI:string,URL:string,`published-print`:{_DATE},`published-online`:{_DATE},issued:{_DATE},created:{_DATE},deposited:{_DATE}>>>"
)


def crossref(payloads: DataFrame, limit: int = 8) -> DataFrame:
    """Scholarly metadata: at least 80 characters, and near the query unless there is an abstract."""
    items = payloads.select("query_id", "query", F.posexplode(F.from_json("payload", CROSSREF)["message"]["items"]).alias("_at", "i"))
    year = F.coalesce(*[F.get(F.get(F.col(f"i.`{k}`.`date-parts`"), F.lit(0)), F.lit(0)).cast("string") for k in ("published-print", "published-online", "issued", "created", "deposited")], F.lit(""))
    names = F.array_join(F.slice(F.filter(F.transform("i.author", lambda a: normalize_space(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != ""), 1, 4), ", ")
    rows = items.select(
        "query_id", "query", "_at", normalize_space(F.get(F.col("i.title"), F.lit(0))).alias("title"), normalize_space(F.col("i.abstract")).alias("abstract"), F.coalesce(names, F.lit("")).alias("authors"),
        listed(F.col("i.`container-title`"), 2).alias("container"), listed(F.col("i.subject"), 5).alias("subjects"), normalize_space(F.col("i.publisher")).alias("publisher"),
        normalize_space(F.replace(F.coalesce("i.type", F.lit("")), F.lit("-"), F.lit(" "))).alias("kind"), year.alias("year"), normalize_space(F.col("i.DOI")).alias("doi"), F.col("i.URL").alias("link")).where("title <> ''")
    blocks = F.array(F.col("abstract"), F.when(F.col("abstract") == "", F.concat("title", F.lit("."))).otherwise(""), *[_said(f, F.col(c)) for f, c in (("Authors: %s.", "authors"), ("Published in %s.", "container"), ("Publisher: %s.", "publisher"), ("Subjects include %s.", "subjects"), ("Work type: %s.", "kind"), ("Year: %s.", "year"))])
    rows = rows.withColumn("content", excerpt(blocks)).where(F.length("content") >= 80)
    has = lambda c, v: F.when(F.col(c) != "", v).otherwise(0.0)
    rows = rows.withColumn("near", similarity(F.col("query"), F.concat_ws(" ", "title", "content"))).where("near >= 0.08 or abstract <> ''")
    bonus = has("abstract", 0.16) + has("subjects", 0.07) + has("container", 0.05) + has("authors", 0.04)
    url = F.when(normalize_url(F.col("link")) != "", normalize_url(F.col("link"))).otherwise(F.when(F.col("doi") != "", normalize_url(F.concat(F.lit("https://doi.org/"), "doi"))).otherwise(""))
    rows = rows.withColumns({"url": url, "_score": F.col("near") + bonus, "informative_score": F.least(F.lit(0.94), 0.6 + bonus + F.least(F.length("content") / 2200, F.lit(0.1))), "authority_score": F.when(F.col("abstract") != "", 0.9).otherwise(0.84)})
    return _best(rows.where("url <> ''"), limit, "crossref")


OPENLIBRARY = "docs array<struct<key:string,title:string,subtitle:string,author_name:array<string>,subject:array<string>,first_publish_year:int>>"


def openlibrary(payloads: DataFrame, works: DataFrame, limit: int = 8) -> DataFrame:
    """Books: search hits joined with the details of their works(key, payload); at least 70 characters."""
    hits = payloads.select("query_id", "query", F.posexplode(F.from_json("payload", OPENLIBRARY)["docs"]).alias("_at", "i")).select("query_id", "query", "_at", "i.*").where(F.col("key").startswith("/works/"))
    text = F.coalesce(F.get_json_object("payload", "$.description.value"), F.get_json_object("payload", "$.description"), F.lit(""))
    details = works.select("key", text.alias("description"), F.from_json("payload", "subjects array<string>")["subjects"].alias("topics"))
    rows = hits.join(details, "key", "left").select(
        "query_id", "query", "_at", "key", normalize_space(F.concat_ws(" ", "title", "subtitle")).alias("title"), normalize_space(F.col("description")).alias("description"), listed(F.col("author_name"), 3).alias("authors"),
        listed(F.when(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0, F.col("topics")).otherwise(F.col("subject")), 6).alias("subjects"), F.coalesce(F.col("first_publish_year").cast("string"), F.lit("")).alias("year"))
    blocks = F.array(F.col("description"), F.when(F.col("description") == "", _said("%s.", F.col("title"))).otherwise(""), *[_said(f, F.col(c)) for f, c in (("By %s.", "authors"), ("First published %s.", "year"), ("Subjects include %s.", "subjects"))])
    rows = rows.withColumn("content", excerpt(blocks)).where(F.length("content") >= 70)
    has = lambda c, v: F.when(F.col(c) != "", v).otherwise(0.0)
    rich = has("description", 0.14) + has("authors", 0.06) + has("subjects", 0.08)
    rows = rows.withColumns({"url": F.concat(F.lit("https://openlibrary.org"), "key"), "_score": similarity(F.col("query"), F.concat_ws(" ", "title", "content")) + rich, "informative_score": F.least(F.lit(0.92), 0.58 + rich + F.least(F.length("content") / 2200, F.lit(0.12))), "authority_score": F.when(F.col("description") != "", 0.86).otherwise(0.8)})
    rows = rows.withColumn("title", F.when(F.col("title") == "", "Open Library Result").otherwise(F.col("title")))
    return _best(rows, limit, "openlibrary")


def result_links(payloads: DataFrame, provider: str, link: str, limit: int = 10) -> DataFrame:
    """Links of stored result pages by a pattern with two groups, target and title; unwrapped,
    without the engine's own pages, the first of each URL."""
    hrefs, names = (F.regexp_extract_all("payload", F.lit(link), F.lit(g)) for g in (1, 2))
    rows = payloads.select("query_id", F.posexplode(F.arrays_zip(hrefs.alias("h"), names.alias("t"))).alias("_at", "x"))
    url = normalize_url(unescape(F.col("x.h")))
    inner = F.coalesce(F.regexp_extract(url, r"[?&](?:uddg|q)=([^&#]*)", 1), F.lit(""))
    url = F.when(url.rlike(r"^https?://([^/]*\.)?(duckduckgo\.com/|google\.[a-z.]+/url)") & (inner != ""), normalize_url(F.try_url_decode(inner))).otherwise(url)
    rows = rows.select("query_id", "_at", url.alias("url"), normalize_space(unescape(F.regexp_replace(F.col("x.t"), "<[^>]*>", ""))).alias("title")).where((F.col("url") != "") & ~search_internal(F.col("url")))
    first = Window.partitionBy("query_id", "url").orderBy("_at")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    w = Window.partitionBy("query_id").orderBy("_at")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("query_id", "pos", "url", "title", F.lit(provider).alias("provider"))
