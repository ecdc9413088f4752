"""Leader clustering of the chosen sources of each query, and the assignment of clusters to chapters.

Sources join clusters in their order, and a cluster changes with each source that joins, so the
outcome depends on the order. One round for each place of a list handles that place of all queries
at once: the sources of the round meet the clusters of their query in a join, each picks the best or
founds its own, and the clusters are written as the state of the next round. There are as many rounds as
the longest list has sources (a handful), whatever the number of queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import jaccard, lexical_sets, sets_similarity
from ..functions.text import normalize_space, term_key, tokenize, without_stop_words
from .latent import flat
from .staging import dealt, stage

# Fixed values that results depend on.
JOINS = 0.18
SAME_TITLE, FOCUS, LIKENESS = 0.18, 0.3, 0.26
CONTENT_TERMS, LEAD = 18, 320
USED = 0.22
#: Chapters of a book and the words that each looks for.
TEMPLATES = [
    ("Foundations", ["foundation", "definition", "overview", "origin"]),
    ("Historical Development", ["history", "origin", "timeline", "development"]),
    ("Core Concepts", ["core", "mechanism", "concept", "principle"]),
    ("Systems and Structures", ["system", "structure", "organization", "model"]),
    ("Comparative Perspectives", ["comparison", "variant", "difference", "tradeoff"]),
    ("Applications and Use Cases", ["application", "practice", "use", "deployment"]),
    ("Challenges and Constraints", ["challenge", "constraint", "risk", "limitation"]),
    ("Measurement and Evidence", ["metric", "measurement", "evidence", "evaluation"]),
    ("Strategic Outlook", ["strategy", "impact", "decision", "outlook"]),
    ("Future Directions", ["future", "trend", "innovation", "projection"]),
]


def words_of(text: Column) -> Column:
    return without_stop_words(tokenize(text))


def label_score(label: Column, focus: Column, relevance: Column) -> Column:
    """How well a phrase names a cluster: focus words in it, its length, the relevance of its source."""
    words = F.array_distinct(words_of(label))
    n = F.size(words)
    score = F.size(F.array_intersect(words, focus)) / F.greatest(n, F.lit(1)) * 1.2 + F.least(n / 6, F.lit(1.0)) * 0.35 + relevance * 0.55
    return F.when(n > 0, score).otherwise(-1.0)


def described(sources: DataFrame) -> DataFrame:
    """sources(query_id, place, doc_id, title, content, relevance, focus, definitions, subtopics) with
    what clustering asks for: terms, title_key, lead, keys and best_label. Its sentences stay out."""
    named = F.concat(F.transform("definitions", lambda d: d["term"]), F.transform("subtopics", lambda t: t["title"]))
    rows = sources.withColumns({"names": F.concat(F.array(F.coalesce("title", F.lit(""))), named), "title": F.coalesce("title", F.lit(""))})
    terms = F.array_distinct(F.concat(F.flatten(F.transform("names", words_of)), F.slice(words_of(F.col("content")), 1, CONTENT_TERMS)))
    scored = F.filter(F.transform("names", lambda x, i: F.struct(label_score(x, F.col("focus"), F.col("relevance")).alias("score"), (-i).alias("i"), x.alias("label"), term_key(x).alias("key"))), lambda x: x["key"] != "")
    return rows.select(
        "query_id", F.col("place").cast("int").alias("place"), "doc_id", "title", "relevance", "focus", terms.alias("terms"), term_key(F.col("title")).alias("title_key"),
        flat(F.concat(F.col("title"), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, LEAD))).alias("lead"), F.array_distinct(F.transform(scored, lambda x: x["key"])).alias("keys"),
        F.array_max(scored)["label"].alias("best_label"), F.transform("definitions", lambda d: d["term"]).alias("defined"), F.transform("subtopics", lambda t: t["title"]).alias("topics"))


STATE = ["query_id", "cluster", "label", "terms", "keys", "places", "titles", "defined", "topics", "relevance"]


def _text(state: DataFrame, label: Column) -> DataFrame:
    """state with the text that stands for a cluster: label, three titles, four definitions, four subtopics."""
    part = lambda c, n: F.array_join(F.slice(c, 1, n), " ")
    return state.withColumn("told", flat(F.array_join(F.filter(F.array(label, part("titles", 3), part("defined", 4), part("topics", 4)), lambda x: x != ""), " ")))


def leader_clusters(sources: DataFrame) -> DataFrame:
    """query_id, cluster, place (1 for the most relevant; ties: more sources, more words, founded
    first), label, terms, places (of its sources, as they joined) and relevance (their mean)."""
    rows = described(dealt(sources, "query_id", "place"))
    rows = stage(rows.withColumn("lead_sets", lexical_sets(F.col("lead"))), "cluster-sources")
    last = rows.agg(F.max("place")).first()[0] or 0
    state = None
    c = F.col
    for k in range(1, last + 1):
        now = rows.where(c("place") == k)
        fresh = now.select("query_id", F.lit("").alias("label"), "terms", "keys", F.array("place").alias("places"), F.array("title").alias("titles"), "defined", "topics", F.array("relevance").alias("relevances"), F.coalesce("best_label", "title").alias("new_label"))
        if state is None:
            grown = fresh.withColumn("cluster", F.lit(0))
        else:
            s, x = state.alias("s"), now.alias("x")
            score = (jaccard(c("s.terms"), c("x.terms")) + F.when((c("x.title_key") != "") & F.array_contains("s.keys", c("x.title_key")), SAME_TITLE).otherwise(0.0)
                     + F.size(F.array_intersect("x.terms", "x.focus")) / F.greatest(F.size("x.focus"), F.lit(1)) * FOCUS + F.round(sets_similarity(c("x.lead"), c("s.told"), c("x.lead_sets"), c("s.told_sets")), 6) * LIKENESS)
            met = x.join(s, "query_id").select("query_id", c("s.cluster").alias("cluster"), F.round(score, 9).alias("score"))
            best = met.groupBy("query_id").agg(F.max(F.struct("score", (-c("cluster")).alias("c"))).alias("b"), F.max("cluster").alias("top"))
            picks = now.select("query_id").join(best, "query_id", "left").select("query_id", F.when((c("b.score") >= JOINS) & (c("b.score") > 0), -c("b.c")).alias("joined"), F.coalesce(c("top") + 1, F.lit(0)).alias("next"))
            own = fresh.join(picks, "query_id")
            founded = own.where("joined is null").withColumn("cluster", c("next")).drop("joined", "next")
            f = own.where("joined is not null").select("query_id", c("joined").alias("cluster"), *[c(n).alias(f"x_{n}") for n in fresh.columns if n not in ("query_id", "label")])
            both = state.drop("told", "told_sets").join(f, ["query_id", "cluster"])
            more = lambda n: F.concat(n, f"x_{n}")
            joined = both.select("query_id", "cluster", "label", F.array_union("terms", "x_terms").alias("terms"), F.array_union("keys", "x_keys").alias("keys"),
                                 *[more(n).alias(n) for n in ("places", "titles", "defined", "topics", "relevances")], c("x_new_label").alias("new_label"))
            kept = state.drop("told", "told_sets").join(f.select("query_id", "cluster"), ["query_id", "cluster"], "left_anti").withColumn("new_label", c("label"))
            # A cluster's text has the label that it had before this round; one that nothing joined keeps its text.
            same = state.join(f.select("query_id", "cluster"), ["query_id", "cluster"], "left_anti").select("query_id", "cluster", c("told").alias("old_told"))
            grown = founded.unionByName(joined).unionByName(kept).join(same, ["query_id", "cluster"], "left")
        grown = _text(grown, c("label"))
        if "old_told" in grown.columns:
            grown = grown.withColumn("told", F.coalesce("old_told", "told")).drop("old_told")
        state = dealt(grown.drop("label").withColumnRenamed("new_label", "label"), "query_id")
        state = stage(state.withColumn("told_sets", lexical_sets(c("told"))), f"clusters-{k}")
    if state is None:
        return sources.sparkSession.createDataFrame([], f"query_id {dict(sources.dtypes)['query_id']}, cluster int, place int, label string, terms array<string>, places array<int>, relevance double")
    mean = F.round(F.aggregate("relevances", F.lit(0.0), lambda a, x: a + x) / F.size("relevances"), 9)
    out = state.withColumn("relevance", mean)
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc(F.size("places")), F.desc(F.size("terms")), "cluster")
    return out.select("query_id", "cluster", F.row_number().over(w).alias("place"), "label", "terms", "places", "relevance")


def themes(clusters: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, themes: the labels of clusters, then the titles of sources, each key once and none that is the query."""
    label, title = clusters.select("query_id", F.lit(0).alias("of"), "place", "label"), sources.select("query_id", F.lit(1).alias("of"), F.col("place").cast("int").alias("place"), F.col("title").alias("label"))
    rows = label.unionByName(title).withColumn("key", term_key(F.col("label"))).join(queries.select("query_id", "query"), "query_id")
    rows = rows.where((F.col("key") != "") & (F.lower("label") != F.lower(F.coalesce("query", F.lit("")))))
    first = Window.partitionBy("query_id", "key").orderBy("of", "place")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("of", "place", "label"))), lambda x: x["label"]).alias("themes"))


def assign(clusters: DataFrame, focus: DataFrame, templates: list[tuple[str, list[str]]] = TEMPLATES) -> DataFrame:
    """query_id, chapter (from 0), cluster: the best cluster of each chapter in turn. A cluster scores by
    relevance, the chapter's words, focus words and sources, less USED for each chapter that it has
    already; ties go to the cluster of the better place. A fold over the chapters holds the uses."""
    rows = clusters.join(focus.select("query_id", "focus"), "query_id")
    share = lambda words: F.size(F.array_intersect("terms", words)) / F.greatest(F.size(words), F.lit(1))
    fixed = F.col("relevance") * 0.8 + share(F.col("focus")) * 0.35 + F.least(F.size("places") / 3, F.lit(1.0)) * 0.18
    by_chapter = F.array(*[F.round(fixed + share(F.array(*[F.lit(w) for w in words])) * 0.7, 9) for _, words in templates])
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "cluster", by_chapter.alias("scores")))).alias("all"))
    start = F.struct(F.transform("all", lambda _: F.lit(0)).alias("used"), F.array().cast("array<int>").alias("picks"))

    def step(s: Column, chapter: Column) -> Column:
        scores = F.zip_with(F.col("all"), s["used"], lambda a, u: F.get(a["scores"], chapter) - u * USED)
        best = F.array_max(F.transform(scores, lambda x, i: F.struct(F.round(x, 9).alias("score"), (-i).alias("i"))))["i"]
        return F.struct(F.transform(s["used"], lambda u, i: u + F.when(i == -best, 1).otherwise(0)).alias("used"), F.concat(s["picks"], F.array(-best)).alias("picks"))

    picks = lists.select("query_id", "all", F.aggregate(F.sequence(F.lit(0), F.lit(len(templates) - 1)), start, step)["picks"].alias("picks"))
    return picks.select("query_id", "all", F.posexplode("picks").alias("chapter", "pick")).select("query_id", "chapter", F.get("all", F.col("pick"))["cluster"].alias("cluster"))
