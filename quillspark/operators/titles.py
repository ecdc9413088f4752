"""Chapter titles: candidate phrases of a query are scored for each chapter, and the best that is
neither the query nor the chapter's own label completes the label. All chapters of all queries are
rows of one table, so a title is an aggregate over its candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import depth_target, layer_bonus
from ..functions.text import STOP_WORDS, let, term_key, tokenize
from . import concepts
from .latent import flat
from .staging import dealt, stage

# Fixed values that results depend on.
WORDS, CHARS, SOFT = 5, 88, 5
FILLER = "best can could considering decade decades does how might most next over probable response should what which who why would year years".split()
WEAK = (
    "article articles biographical biography book books career careers chapter chapters context critical epic essay essays legacy paper papers part program programs "
    "report reports review reviews study studies volume volumes").split()
SHORT_NAMES = "ai ml nlp api usa uk".split()
TAILS = {
    "Foundations": "Scope", "Historical Development": "Evolution", "Core Concepts": "Key Concepts", "Systems and Structures": "Value Chains", "Comparative Perspectives": "Approaches",
    "Applications and Use Cases": "Deployment", "Challenges and Constraints": "Risks", "Measurement and Evidence": "Signals", "Strategic Outlook": "Strategic Priorities", "Future Directions": "Scenarios",
}
BONUS = {"focus": 0.06, "path": 0.18, "definition": 0.24, "subtopic": 0.26, "topic": 0.08, "near": 0.04, "source": 0.10, "source_definition": 0.18, "source_subtopic": 0.20}
ON_PATH = 0.42


def display(word: Column) -> Column:
    """A word as titles show it: short capitals and numbers stay, known short names are capitals."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000)))
    shown = ((F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) <= 5)) | ((F.upper(word) == word) & (F.length(word) <= 4)) | word.rlike("^[0-9]+$")
    return F.when(shown, word).when(F.lower(word).isin(SHORT_NAMES), F.upper(word)).otherwise(capital)


def shown(words: Column, most: int = WORDS) -> Column:
    return F.array_join(F.transform(F.slice(words, 1, most), display), " ")


def compact(text: Column, most: int = WORDS) -> Column:
    """The first content words of a phrase, each once whatever its case, up to its first end or question."""
    part = F.element_at(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"[?!.]", 2), 1)
    return let(F.element_at(F.split(part, r"(?i)\b(?:and how should|how should|how can|in response)\b", 2), 1), lambda part: _compact(part, most))


def _compact(part: Column, most: int) -> Column:
    words = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(part, r"\([^)]*\)", " "), r"[\-–—/|]+", " "), F.lit("[A-Za-z0-9']+"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin([*STOP_WORDS, *FILLER]))
    once = let(kept, lambda k: let(F.transform(k, lambda w: F.lower(w)), lambda low: F.filter(k, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)))
    plain = F.filter(tokenize(part), lambda w: ~w.isin(STOP_WORDS))
    return let(once, lambda o: F.when(F.size(o) > 0, shown(o, most)).otherwise(shown(plain, most)))


def trimmed(title: Column) -> Column:
    ends = lambda c: F.btrim(c, F.lit(" :;,-"))
    whole = ends(F.regexp_replace(title, r"\s+", " "))
    cut = F.substring(whole, 1, CHARS)
    return F.when(F.length(whole) <= CHARS, whole).otherwise(F.coalesce(F.nullif(ends(F.regexp_replace(cut, r" [^ ]*$", "")), F.lit("")), ends(cut)))


def soft_share(words: Column, wanted: Column) -> Column:
    """The share of wanted words that are among words or, from five letters, begin like one."""
    starts = F.transform(F.filter(words, lambda w: F.length(w) >= SOFT), lambda w: F.substring(w, 1, SOFT))
    met = F.filter(wanted, lambda k: F.array_contains(words, k) | ((F.length(k) >= SOFT) & F.array_contains(starts, F.substring(k, 1, SOFT))))
    return F.when((F.size(words) > 0) & (F.size(wanted) > 0), F.size(met) / F.size(wanted)).otherwise(0.0)


def title_path(queries: DataFrame, topics: DataFrame, themes: DataFrame, chapters: int) -> DataFrame:
    """query_id, chapter, focus: for each chapter a phrase of its depth. Phrases are the topics (in their
    order), the themes and the near concepts; a chapter takes those as far from the query as its place in the book asks."""
    near = concepts.expand(queries.select(F.col("query_id").alias("key"), flat(F.col("query")).alias("text")), 2, max(8, chapters))
    kinds = dict(queries.dtypes)["query_id"]
    rows = topics.select("query_id", F.lit(0).alias("of"), F.col("place").cast("int").alias("n"), F.col("label").alias("phrase"))
    rows = rows.unionByName(themes.select("query_id", F.lit(1).alias("of"), F.posexplode("themes").alias("n", "phrase")))
    rows = rows.unionByName(near.select(F.col("key").cast(kinds).alias("query_id"), F.lit(2).alias("of"), F.col("place").cast("int").alias("n"), F.col("node").alias("phrase"))).where(F.trim("phrase") != "")
    first = Window.partitionBy("query_id", "phrase").orderBy("of", "n")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").join(queries.select("query_id", "query"), "query_id")
    depth = concepts.layers(rows.select(F.col("query").alias("seed"), F.col("phrase").alias("node"))).select(F.col("seed").alias("query"), F.col("node").alias("phrase"), "layer")
    lists = rows.join(depth, ["query", "phrase"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("of", "n", "phrase", "layer"))).alias("all"))
    pick = lambda layer: F.transform(F.filter("all", lambda x: x["layer"] == layer), lambda x: x["phrase"])
    pools = queries.select("query_id", "query").join(lists, "query_id", "left").select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(chapters - 1))).alias("chapter"), *[pick(x).alias(x) for x in ("seed", "related", "tangential")])
    target = depth_target(F.col("chapter"), F.lit(chapters))
    own = F.when(target == "seed", F.col("seed")).when(target == "related", F.col("related")).otherwise(F.col("tangential"))
    pool = reduce(lambda a, b: F.when(F.size(a) > 0, a).otherwise(b), [own, F.col("related"), F.col("seed"), F.col("tangential")])
    # Without any phrase the query stands for itself.
    return pools.withColumn("pool", pool).select("query_id", "chapter", F.when(F.size("pool") > 0, F.get("pool", F.pmod(F.col("chapter"), F.size("pool")))).otherwise(F.col("query")).alias("path"))


def _words_of_phrases(rows: DataFrame) -> DataFrame:
    """rows(query_id, key, phrase, query, focus) whose phrase can make a title, with it (compact) and its words."""
    c = F.col
    plain = F.filter(F.regexp_extract_all("phrase", F.lit("[A-Za-z0-9']+"), F.lit(0)), lambda w: ~F.lower(w).isin([*STOP_WORDS, *FILLER]))
    rows = stage(rows.withColumns({"plain": plain, "compact": compact(c("phrase"))}), "title-words").where("compact <> ''")  # staged, as a filter would compute them again
    rows = rows.withColumn("fresh", F.filter("plain", lambda w: ~F.array_contains(c("focus"), F.lower(w))))
    rows = rows.withColumn("compact", F.when((F.size("fresh") >= 2) & (F.size("fresh") < F.size("plain")), shown(c("fresh"))).otherwise(c("compact")))
    rows = rows.withColumns({"words": F.array_distinct(tokenize(c("compact"))), "compact_key": term_key(c("compact")), "query_key": term_key(c("query"))})
    weak = F.filter("words", lambda w: w.isin(WEAK) | w.rlike("^[ivxlcdm]+$"))
    rows = rows.withColumns({"weak": F.size(weak), "strong": F.filter("words", lambda w: ~(w.isin(WEAK) | w.rlike("^[ivxlcdm]+$"))), "size": F.size("words"), "in_focus": F.size(F.array_intersect("words", "focus"))})
    n = c("size")
    alone = (n == 1) & ((c("weak") == 1) | (F.length(F.get("words", F.lit(0))) <= 2))
    hollow = (c("weak") > 0) & (n <= 2) & ((c("weak") == n) | ((F.size("strong") > 0) & (F.size(F.array_except("strong", "focus")) == 0)))
    return rows.where((n > 0) & ~alone & ~hollow)


def best_titles(candidates: DataFrame, chapters: DataFrame, topics: DataFrame, count: int) -> DataFrame:
    """query_id, chapter, title. candidates(query_id, chapter, phrase, bonus, n) are in order by n;
    chapters(query_id, chapter, label, keywords, path, query, focus)."""
    c = F.col
    chapters = chapters.select("query_id", "chapter", "label", "keywords", "path", "query", "focus")
    rows = candidates.where(F.trim("phrase") != "").withColumn("key", flat(c("phrase"))).groupBy("query_id", "chapter", "key").agg(F.min_by("phrase", "n").alias("phrase"), F.min("n").alias("n"), F.max("bonus").alias("bonus"))
    branch = topics.withColumn("key", flat(c("label"))).groupBy("query_id", "key").agg(F.max(F.greatest(F.lit(0.0), 0.20 - (c("place") - 1) * 0.015) + F.least(c("divergence") * 0.14, F.lit(0.14))).alias("branch"))
    rows = stage(rows, "title-candidates")
    # What follows from query and phrase alone is computed once, not for each chapter.
    asked = chapters.groupBy("query_id").agg(F.first("query").alias("query"), F.first("focus").alias("focus"))
    phrases = dealt(rows.select("query_id", "key", "phrase").distinct(), "query_id", "phrase").join(asked, "query_id")
    phrases = stage(_words_of_phrases(phrases), "title-phrases")
    depth = concepts.layers(phrases.select(c("query").alias("seed"), c("key").alias("node"))).select(c("seed").alias("query"), c("node").alias("key"), "layer")
    phrases = phrases.join(depth, ["query", "key"], "left").join(branch, ["query_id", "key"], "left").drop("query", "key", "focus")
    of_chapter = chapters.withColumns({"label_key": term_key(c("label")), "path_key": flat(c("path"))})
    rows = stage(rows.join(phrases, ["query_id", "phrase"]).join(of_chapter, ["query_id", "chapter"]), "title-rows")
    n = c("size")
    share = c("in_focus") / F.greatest(n, F.lit(1))
    target = depth_target(c("chapter"), F.lit(count))
    when = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    score = (
        soft_share(c("words"), c("keywords")) * 1.5 + share * 1.2 + F.least(n / WORDS, F.lit(1.0)) * 0.2 + (1 - share) * 0.16 + c("bonus") + F.coalesce(c("branch"), F.lit(0.0))
        + F.when(c("layer").isNotNull(), layer_bonus(c("layer"), target)).otherwise(0.0) + when((c("path_key") != "") & (c("key") == c("path_key")), ON_PATH)
        - F.least(c("weak") * 0.24, F.lit(0.58)) - when(n == 1, 0.16) - when((c("in_focus") == n) & (n <= 3), 0.52) - when((share >= 0.75) & (n <= 3), 0.24)
        - when(c("compact_key") == c("query_key"), 0.5) - when(c("compact_key") == c("label_key"), 0.45) - when((c("label_key") != "") & (c("compact_key") != "") & F.contains("label_key", "compact_key"), 0.18)
        - when(F.startswith(c("key"), F.lower("label")) & (c("query_key") != ""), 0.38) - when((share >= 0.34) & (n > 2), 0.22) - when((share >= 0.5) & (n > F.greatest(F.lit(2), F.size("focus"))), 0.18)
        - when((c("layer") == "seed") & (target == "tangential"), 0.16) - when((c("layer") == "tangential") & (target == "seed"), 0.10))
    fit = rows.where((c("compact_key") != c("query_key")) & (c("compact_key") != c("label_key")))
    best = fit.select("query_id", "chapter", "compact", F.round(score, 9).alias("score"), "n").groupBy("query_id", "chapter").agg(F.max_by("compact", F.struct("score", -c("n"))).alias("compact"))
    topic, on_path = compact(c("query"), 4), compact(c("path"))
    tails = F.create_map(*[F.lit(x) for pair in TAILS.items() for x in pair])
    tail = F.coalesce(F.try_element_at(tails, c("label")), F.lit(""))
    path_fits = (c("path") != "") & (on_path != "") & ~term_key(on_path).isin(term_key(c("query")), term_key(c("label")))
    rest = F.coalesce(c("compact"), F.when(path_fits, on_path).when(topic != "", F.concat(topic, F.lit(" "), tail)).otherwise(tail))
    return chapters.join(best, ["query_id", "chapter"], "left").select("query_id", "chapter", trimmed(F.concat(c("label"), F.lit(": "), F.trim(rest))).alias("title"))
