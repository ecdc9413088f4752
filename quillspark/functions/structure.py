"""Definitions and subtopics that a text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import dealt, stage
from .rules import meaningful, title_without
from .text import let, normalize_space, tokenize, usable_sentences

# Fixed values that results depend on.
DEFINES = r"^([A-Z][A-Za-z0-9][A-Za-z0-9\s&/\-(),]{2,80}?)\s+(?:is|are|was|were|refers to|describes|means|represents)\s+.+"
DEFINITIONS, SUBTOPICS = 6, 4
#: Sentences after the first that may give a subtopic, and the words that one needs.
SUBTOPIC_SENTENCES, SUBTOPIC_WORDS = 9, 6


def first_of_each(rows: Column, field: str) -> Column:
    """The rows of an array of structs whose field, in lower case, no earlier row has."""
    keys = lambda r: F.transform(r, lambda x: F.lower(x[field]))
    return let(rows, lambda r: let(keys(r), lambda k: F.filter(r, lambda x, i: F.array_position(k, F.lower(x[field])) == i + 1)))


def definitions(title: Column, content: Column) -> Column:
    """Up to six of {term, description}: the title with the first sentence, then what the first
    eight sentences name before a defining verb (one to eight words). Null or empty texts: none."""
    return let(usable_sentences(content), lambda s: _definitions(normalize_space(title), s))


def _definitions(title: Column, s: Column) -> Column:
    """The same of a normalised title and usable sentences."""
    row = lambda term, told: F.struct(normalize_space(term).alias("term"), normalize_space(told).alias("description"))
    head = F.filter(F.transform(F.slice(s, 1, 1), lambda x: row(title, x)), lambda x: x["term"] != "")
    named = F.transform(F.slice(s, 1, 8), lambda x: row(F.regexp_extract(x, DEFINES, 1), x))
    named = F.filter(named, lambda x: F.size(tokenize(x["term"])).between(1, 8))
    rows = F.filter(F.concat(head, named), lambda x: meaningful(x["term"], x["description"]))
    return F.slice(first_of_each(rows, "term"), 1, DEFINITIONS)


def leading_sentences(rows: DataFrame) -> DataFrame:
    """doc_id, told: the usable sentences that definitions and subtopics look at, of each text once
    however many queries have it. rows(doc_id, content)."""
    texts = rows.groupBy("doc_id").agg(F.first("content").alias("content"))
    return dealt(texts, "doc_id").select("doc_id", F.slice(usable_sentences(F.col("content")), 1, SUBTOPIC_SENTENCES + 1).alias("told"))


def subtopics(rows: DataFrame) -> DataFrame:
    """query_id, doc_id, subtopics: up to four of {title, summary} of each row of rows(query_id,
    doc_id, title, content, words, focus), words and focus being the query's. The second to the tenth
    sentence, those with most focus words and detail first, give a title each of what the query lacks;
    a text that gives none has its own title as context. One row for each sentence, so
    no expression grows with the number of sentences. Null or empty texts: no row."""
    by = ["query_id", "doc_id"]
    rows = rows if "told" in rows.columns else rows.join(leading_sentences(rows), "doc_id")
    told = dealt(rows.select(*by, normalize_space(F.col("title")).alias("title"), "words", "focus", F.posexplode("told").alias("n", "sentence")), *by, "n")
    told = told.where(F.col("n") <= SUBTOPIC_SENTENCES).withColumns({"sentence": F.trim("sentence"), "said": F.array_distinct(tokenize(F.col("sentence")))})
    later = told.where((F.col("n") > 0) & (F.size("said") >= SUBTOPIC_WORDS))
    share = F.size(F.array_intersect("said", "focus")) / F.greatest(F.size("focus"), F.lit(1))
    later = later.withColumns({"score": share * 1.3 + F.least(F.size("said") / 22, F.lit(1.0)), "label": F.explode(let(title_without(F.col("sentence"), F.col("words")), lambda t: F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))))})  # a filter would compute it again
    first = Window.partitionBy(*by, F.lower("label")).orderBy(F.desc("score"), "n")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "n")
    later = later.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SUBTOPICS)
    found = later.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("label").alias("title"), F.col("sentence").alias("summary")))), lambda x: x.dropFields("place")).alias("subtopics"))
    own = F.concat(F.lit("Context for "), F.col("title"))
    context = told.where((F.col("n") == 0) & (F.col("title") != "")).where(meaningful(own, F.col("sentence"))).select(*by, F.array(F.struct(own.alias("title"), F.col("sentence").alias("summary"))).alias("own"))
    return found.join(context, by, "full").select(*by, F.coalesce("subtopics", "own").alias("subtopics"))


def structured(rows: DataFrame) -> DataFrame:
    """rows with definitions and subtopics, empty where there are none. A doc_id stands for one title and content."""
    titles = rows.groupBy("doc_id").agg(F.first("title").alias("title"))
    texts = stage(leading_sentences(rows).join(titles, "doc_id"), "leading-sentences")
    defined = stage(dealt(texts, "doc_id").select("doc_id", _definitions(normalize_space(F.col("title")), F.col("told")).alias("definitions")), "definitions")
    found = stage(subtopics(rows.select("query_id", "doc_id", "title", "words", "focus").join(texts.select("doc_id", "told"), "doc_id")), "subtopics")
    none = F.array().cast(found.schema["subtopics"].dataType)
    return rows.join(defined, "doc_id").join(found, ["query_id", "doc_id"], "left").withColumn("subtopics", F.coalesce("subtopics", none))
