"""Assembly of a book of chapters from the chosen sources of each query.

Sources are clustered, chapters get clusters and titles, and a search picks the sentences of each
chapter. All but the search are joins, windows and aggregates over all queries. The search goes through
the chapters of a query in turn, since a sentence that a chapter has used is gone for the next; its state
is that of one query, whose sources are the handful that selection chose. It is seeded
from the query and the chapter, so reruns agree.

Defined results: a query without sources has no book; once its sentences are used up, later chapters
have fewer sentences, or none; texts without a usable sentence give the whole text as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, normalize_space, tokenize, usable_sentences
from . import concepts, latent, titles
from .clusters import TEMPLATES, assign, leader_clusters, themes
from .staging import dealt, stage

# Fixed values that results depend on.
LEADING = r"^(?:authors?|by|editor|publisher|published in|first published|work type|subjects include|year|journal|volume|issue|pages?|doi|isbn|issn)\b"
CATALOGUE = r"\b(?:doi|isbn|issn|edition|publisher|journal|volume|issue|work type|subjects include)\b"
SHORTEST, LONGEST = 4, 6
PEOPLE, ROUNDS, ELITE, PARENTS, CHANGES = 15, 8, 2, 5, 0.2
IDEAL_WORDS = 65
DEFINITIONS, SUBTOPICS, LINKS = 4, 3, 3
BEST_TEXTS = 12


def noise(sentence, n_words):
    """What a sentence loses for looking like a catalogue entry."""
    low = F.lower(F.trim(sentence))
    colon = F.substring(low, 1, 22).contains(":") & F.element_at(F.split(low, ":", 2), 1).rlike(LEADING)
    commas = F.length(low) - F.length(F.replace(low, F.lit(","), F.lit("")))
    parts = [(low.rlike(LEADING), 0.72), (colon, 0.45), (low.rlike(CATALOGUE), 0.18), (n_words <= 4, 0.22), (commas >= 5, 0.12)]
    return sum((F.when(test, loss).otherwise(0.0) for test, loss in parts), F.lit(0.0))


def sentence_pool(sources: DataFrame) -> DataFrame:
    """query_id, place, n, sentence, words, quality and base (what its score has whatever the chapter)
    of each usable sentence of sources(query_id, place, content, focus, relevance, informative, authority)."""
    whole = F.filter(F.array(normalize_space(F.col("content"))), lambda s: s != "")
    rows = dealt(sources, "query_id", "place").withColumn("told", let(usable_sentences(F.col("content")), lambda s: F.when(F.size(s) > 0, s).otherwise(whole)))
    quality = F.col("informative") * 0.42 + F.col("authority") * 0.20 + F.col("relevance") * 0.38
    rows = rows.select("query_id", F.col("place").cast("int").alias("place"), "focus", quality.alias("quality"), F.posexplode("told").alias("n", "sentence"))
    rows = rows.withColumns({"sentence": F.trim("sentence"), "words": F.array_distinct(tokenize(F.col("sentence")))})
    share = F.size(F.array_intersect("words", "focus")) / F.greatest(F.size("focus"), F.lit(1))
    base = share * 1.7 + F.least(F.size("words") / 20, F.lit(1.0)) * 0.4 + F.col("quality") - noise(F.col("sentence"), F.size("words"))
    return rows.select("query_id", "place", "n", "sentence", "words", "focus", "quality", base.alias("base"))


class Sentences:
    """The sentences of a query as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.place, self.quality, self.base = rows["place"].to_numpy(), rows["quality"].to_numpy(float), rows["base"].to_numpy(float)
        names: dict[str, int] = {}
        self.words = [np.array([names.setdefault(w, len(names)) for w in ws], np.int64) for ws in rows["words"]]
        self.names = names
        focus = [names[w] for w in rows["focus"].iloc[0] if w in names] if len(rows) else []
        self.in_focus = np.zeros(len(names) + 1, bool)
        self.in_focus[focus] = True
        self.n_focus = max(1, len(rows["focus"].iloc[0])) if len(rows) else 1

    def scores(self, keywords: list[str], preferred: frozenset[int]) -> np.ndarray:
        """The score of each sentence for a chapter."""
        wanted = np.zeros(len(self.names) + 1, bool)
        wanted[[self.names[w] for w in keywords if w in self.names]] = True
        theme = np.array([wanted[w].sum() for w in self.words]) / max(1, len(keywords))
        return self.base + theme * 1.3 + np.where(np.isin(self.place, list(preferred)), 0.16, -0.12)

    def fitness(self, chosen: tuple[int, ...], quality: np.ndarray) -> float:
        """Focus words, quality, sources and length of a set of sentences."""
        rows = list(chosen)
        words = np.unique(np.concatenate([self.words[i] for i in rows]))
        return round(self.in_focus[words].sum() / self.n_focus * 0.4 + float(quality[rows].mean()) * 0.3 + len(set(self.place[rows].tolist())) / len(rows) * 0.2 + max(0.0, 1 - abs(len(words) - IDEAL_WORDS) / IDEAL_WORDS) * 0.1, 9)


def search(told: Sentences, order: list[int], quality: np.ndarray, rng: np.random.Generator) -> tuple[int, ...]:
    """A set of SHORTEST to LONGEST sentences out of order (best first): a generational search with
    elites, one-point mixing of good parents and single changes; its first member are the best sentences."""
    size = min(len(order), int(rng.integers(SHORTEST, LONGEST + 1)))
    if size == len(order):
        return tuple(order)
    known: dict[tuple[int, ...], float] = {}
    value = lambda p: known[p] if p in known else known.setdefault(p, told.fitness(p, quality))
    sort = lambda people: sorted(people, key=lambda p: (-value(p), p))
    people = [tuple(order[:size])] + [tuple(order[i] for i in rng.choice(len(order), size, replace=False)) for _ in range(PEOPLE - 1)]
    for _ in range(ROUNDS):
        ranked = sort(people)
        people = ranked[:ELITE]
        while len(people) < PEOPLE:
            a, b, cut = ranked[int(rng.integers(PARENTS))], ranked[int(rng.integers(PARENTS))], int(rng.integers(1, size))
            child = list(dict.fromkeys(a[:cut] + b[cut:]))
            child += [order[i] for i in rng.permutation(len(order)) if order[i] not in child][: size - len(child)]
            new = order[int(rng.integers(len(order)))]
            if rng.random() < CHANGES and new not in child:
                child[int(rng.integers(size))] = new
            people.append(tuple(child))
    return sort(people)[0]


PICKED = "query_id long, chapter int, place int, n int, position int"


def pick_sentences(pool: DataFrame, chapters: DataFrame) -> DataFrame:
    """PICKED: the sentences of chapters(query_id, chapter, keywords, places), none in two chapters,
    those of the chapter's cluster first, then by source and place in it."""
    def run(rows: pd.DataFrame, chapters: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "n"]).reset_index(drop=True)
        out = []
        if len(rows):
            told, free = Sentences(rows), np.ones(len(rows), bool)
            for ch in chapters.sort_values("chapter").itertuples():
                preferred = frozenset(int(p) for p in ch.places)
                scores = np.round(told.scores(list(ch.keywords), preferred), 9)
                order = [int(i) for i in np.argsort(-scores, kind="stable") if free[i]]
                if not order:
                    break
                quality = told.quality + np.where(np.isin(told.place, list(preferred)), 0.16, 0.0)
                chosen = search(told, order, quality, np.random.default_rng([abs(int(ch.query_id)), int(ch.chapter)]))
                free[list(chosen)] = False
                ordered = sorted(chosen, key=lambda i: (int(rows["place"][i]) not in preferred, rows["place"][i], rows["n"][i]))
                out += [(ch.query_id, ch.chapter, rows["place"][i], rows["n"][i], k) for k, i in enumerate(ordered)]
        return pd.DataFrame(out, columns=["query_id", "chapter", "place", "n", "position"])

    pool, chapters = dealt(pool, "query_id"), dealt(chapters, "query_id")
    return pool.groupBy("query_id").cogroup(chapters.groupBy("query_id")).applyInPandas(run, PICKED)


def pick_items(items: DataFrame, chapters: DataFrame, most: int) -> DataFrame:
    """query_id, chapter, items: up to `most` of items(query_id, n, name, told) for each of
    chapters(query_id, chapter, keywords), in turn: those that no chapter has used yet first, by the
    chapter's words in them and their length. A fold over the chapters holds what is used."""
    own = items.withColumns({"key": F.lower(normalize_space(F.col("name"))), "words": tokenize(normalize_space(F.concat_ws(" ", "name", "told")))}).where("key <> ''")
    own = own.groupBy("query_id", "key").agg(F.min_by(F.struct("name", "told", "words"), "n").alias("x"), F.min("n").alias("n"))
    rows = own.join(chapters.select("query_id", "chapter", "keywords"), "query_id")
    score = F.size(F.array_intersect(F.array_distinct("x.words"), "keywords")) * 1.4 + F.least(F.size("x.words") / 25, F.lit(0.5))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "chapter").orderBy(F.desc(F.round(score, 9)), "n")))
    lists = ranked.groupBy("query_id", "chapter").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "key", "x.name", "x.told"))), lambda x: x.dropFields("k")).alias("all"))
    books = lists.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "all"))).alias("chapters"))
    kind = lists.schema["all"].dataType
    nothing = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<chapter:int,items:{kind.simpleString()}>>").alias("out"))

    def step(s, ch):
        fresh = F.filter(ch["all"], lambda x: ~F.array_contains(s["used"], x["key"]))
        stale = F.filter(ch["all"], lambda x: F.array_contains(s["used"], x["key"]))
        picked = F.slice(F.concat(fresh, stale), 1, most)
        return F.struct(F.array_union(s["used"], F.transform(picked, lambda x: x["key"])).alias("used"), F.concat(s["out"], F.array(F.struct(ch["chapter"].cast("int").alias("chapter"), picked.alias("items")))).alias("out"))

    return books.select("query_id", F.explode(F.aggregate("chapters", nothing, step)["out"]).alias("x")).select("query_id", "x.chapter", "x.items")


def _named(sources: DataFrame, column: str, name: str, told: str) -> DataFrame:
    """query_id, place, n, name, told of the definitions or subtopics of all sources, in order."""
    rows = sources.select("query_id", F.col("place").cast("int").alias("place"), F.posexplode(column).alias("i", "x"))
    return rows.select("query_id", "place", "i", (F.col("place") * 100 + F.col("i")).alias("n"), F.col(f"x.{name}").alias("name"), F.col(f"x.{told}").alias("told"))


def _candidates(query_level: list[tuple[DataFrame, str]], chapter_level: list[tuple[DataFrame, str]], chapters: DataFrame) -> DataFrame:
    """query_id, chapter, phrase, bonus, n: all phrases of a query for each of its chapters, then the chapters' own."""
    out = None
    for k, (rows, kind) in enumerate(query_level + chapter_level):
        rows = rows.withColumns({"bonus": F.lit(titles.BONUS[kind]), "at": (F.lit(k * 100_000) + F.col("n")).cast("long")})
        rows = rows.join(chapters.select("query_id", "chapter"), "query_id") if k < len(query_level) else rows
        rows = rows.select("query_id", "chapter", "phrase", "bonus", F.col("at").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def assemble(queries: DataFrame, sources: DataFrame, templates: list[tuple[str, list[str]]] = TEMPLATES) -> DataFrame:
    """query_id, chapter, title, content, sentences (place and n of each), definitions, subtopics and
    sources (doc_ids) of queries(query_id, query) with chosen sources(query_id, place, doc_id, title,
    content, relevance, informative, authority, focus, definitions, subtopics)."""
    c, count = F.col, len(templates)
    asked = stage(queries.join(sources.groupBy("query_id").agg(F.first("focus").alias("focus")), "query_id"), "book-queries")
    grouped = stage(leader_clusters(sources), "book-clusters")
    theme = themes(grouped, sources, asked)
    texts = sources.where(c("place") <= BEST_TEXTS).select(c("query_id").alias("group"), c("place").alias("pos"), F.concat_ws(" ", "title", "content").alias("text"))
    topics = stage(latent.subtopics(asked.select(c("query_id").alias("group"), "query"), texts, max(6, min(count, 10))).withColumnRenamed("group", "query_id"), "book-topics")
    plan = sources.sparkSession.createDataFrame([(i, label, words) for i, (label, words) in enumerate(templates)], "chapter int, label string, template array<string>")  # one row for each chapter
    chapters = assign(grouped, asked, templates).join(grouped.select("query_id", "cluster", "places", c("label").alias("phrase")), ["query_id", "cluster"])
    chapters = chapters.join(F.broadcast(plan), "chapter").join(titles.title_path(asked, topics, theme, count), ["query_id", "chapter"]).join(asked, "query_id")
    chapters = stage(chapters.withColumn("keywords", c("template")), "book-chapters")

    near = concepts.expand(asked.select(c("query_id").alias("key"), latent.flat(c("query")).alias("text")), 2, max(6, count)).select(c("key").alias("query_id"), c("place").alias("n"), c("node").alias("phrase"))
    topic = topics.select("query_id", c("place").alias("n"), c("label").alias("phrase"))
    zero = F.lit(0).alias("n")
    fixed = [(chapters.select("query_id", "chapter", zero, "phrase"), "focus"), (chapters.select("query_id", "chapter", zero, c("path").alias("phrase")), "path")]
    first = titles.best_titles(_candidates([(topic, "topic"), (near, "near")], fixed, chapters), chapters, topics, count)

    words = lambda t: F.array_union(F.array_union(tokenize(c(t)), c("template")), c("focus"))
    pool = stage(sentence_pool(sources), "book-sentences")
    titled = chapters.join(stage(first, "book-first-titles"), ["query_id", "chapter"]).withColumn("theme", words("title"))
    picked = stage(pick_sentences(pool, titled.select("query_id", "chapter", c("theme").alias("keywords"), "places")), "book-picks")

    terms, topics_of = _named(sources, "definitions", "term", "description"), _named(sources, "subtopics", "title", "summary")
    order = picked.groupBy("query_id", "chapter", "place").agg(F.min("position").alias("first"))
    support = order.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "chapter").orderBy("first"))).where(c("k") <= LINKS).join(sources.select("query_id", c("place").cast("int").alias("place"), "doc_id", c("title").alias("phrase")), ["query_id", "place"])
    of_support = lambda rows: support.select("query_id", "chapter", "k", "place").join(rows.where("i < 2"), ["query_id", "place"]).select("query_id", "chapter", (c("k") * 10 + c("i")).alias("n"), c("name").alias("phrase"))
    named = lambda rows: rows.select("query_id", "n", c("name").alias("phrase"))
    full = _candidates([(named(terms), "definition"), (named(topics_of), "subtopic"), (topic, "topic"), (near, "near")],
                       [*fixed, (support.select("query_id", "chapter", c("k").alias("n"), "phrase"), "source"), (of_support(terms), "source_definition"), (of_support(topics_of), "source_subtopic")], chapters)
    final = stage(chapters.join(titles.best_titles(full, chapters, topics, count), ["query_id", "chapter"]).withColumn("keywords", words("title")), "book-titles")

    told = picked.join(pool.select("query_id", "place", "n", "sentence"), ["query_id", "place", "n"])
    told = told.groupBy("query_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("position", "place", "n", "sentence"))).alias("s"))
    told = told.select("query_id", "chapter", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("content"), F.transform("s", lambda x: F.struct(x["place"].alias("place"), x["n"].alias("n"))).alias("sentences"))
    links = support.groupBy("query_id", "chapter").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"]).alias("sources"))
    items = lambda rows, most, name: pick_items(rows, final, most).select("query_id", "chapter", F.transform("items", lambda x: x["name"]).alias(name))
    by = ["query_id", "chapter"]
    out = final.select(*by, "title").join(told, by, "left").join(links, by, "left").join(items(terms, DEFINITIONS, "definitions"), by, "left").join(items(topics_of, SUBTOPICS, "subtopics"), by, "left")
    return out.select("query_id", "chapter", "title", F.coalesce("content", F.lit("")).alias("content"), "sentences", "definitions", "subtopics", "sources")
