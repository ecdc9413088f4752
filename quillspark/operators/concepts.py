"""The concept graph and query profiles as DataFrames. Both are fixed lexicons of under two hundred
rows, so distances between all concepts form a small table and travel by broadcast."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import ALIASES, PROFILES, RELATIONS
from ..functions.sets import clamp, lexical_sets, sets_similarity
from ..functions.text import TOKEN, let
from .staging import dealt, stage

HOPS = 10


def pairs() -> list[tuple[str, str]]:
    """Concepts next to each other, both ways: some hundred rows of a fixed lexicon."""
    rows = [(a, b) for a, bs in RELATIONS.items() for b in bs]
    rows += [(node, alias) for node, aliases in ALIASES.items() for alias in aliases]
    return sorted({*rows, *((b, a) for a, b in rows)})


def aliases(spark: SparkSession) -> DataFrame:
    """alias, node, alias_words."""
    rows = [(n, n) for n in ALIASES] + [(a, n) for n, names in ALIASES.items() for a in names]
    return spark.createDataFrame([(a, n, list(dict.fromkeys(re.findall(TOKEN, a)))) for a, n in rows], "alias string, node string, alias_words array<string>")


def distances(spark: SparkSession, hops: int = HOPS) -> DataFrame:
    """a, b, distance of all concepts within `hops` of each other."""
    near: dict[str, set[str]] = {}
    for a, b in pairs():
        near.setdefault(a, set()).add(b)
    out = []
    for a in sorted(near):
        seen, ring = {a}, {a}
        for n in range(hops + 1):
            out += [(a, b, n) for b in sorted(ring)]
            ring = {c for b in ring for c in near[b]} - seen
            seen |= ring
    return spark.createDataFrame(out, "a string, b string, distance int")


def seeds(texts: DataFrame) -> DataFrame:
    """key, node of the concepts that a text names: an alias inside it, or four fifths of its words;
    without any, concepts that share two words (or their only one). texts: key, text (lower case)."""
    spark = texts.sparkSession
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))
    texts = texts.withColumn("words", words(F.col("text")))  # once, not for each alias
    named = F.col("text").contains(F.col("alias")) | (F.size(F.array_intersect("alias_words", "words")) / F.greatest(F.size("alias_words"), F.lit(1)) >= 0.8)
    first = texts.join(F.broadcast(aliases(spark)), named).select("key", "node").distinct()
    nodes = spark.createDataFrame([(n, list(dict.fromkeys(re.findall(TOKEN, n)))) for n in sorted({a for a, _ in pairs()})], "node string, node_words array<string>")
    shared = F.size(F.array_intersect("node_words", "words")) >= F.least(F.size("node_words"), F.lit(2))
    rest = texts.join(first.select("key").distinct(), "key", "left_anti").join(F.broadcast(nodes), shared & (F.size("node_words") > 0)).select("key", "node")
    return first.unionByName(rest)


def expand(texts: DataFrame, depth: int = 2, limit: int = 12) -> DataFrame:
    """key, node, distance, place: the concepts within `depth` of a text's, nearest and shortest first."""
    near = distances(texts.sparkSession, depth)
    ball = seeds(texts).withColumnRenamed("node", "a").join(F.broadcast(near), "a").groupBy("key", F.col("b").alias("node")).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("key").orderBy("distance", F.length("node"), "node")
    return ball.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def layers(pairs: DataFrame) -> DataFrame:
    """seed, node, distance, layer of each pair of texts: by hops, else by shared words."""
    keyed = stage(pairs.select("seed", "node").distinct(), "layer-pairs")  # read many times below
    texts = keyed.select(F.col("seed").alias("text")).union(keyed.select("node")).distinct().select(F.col("text").alias("key"), F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"))
    s = stage(seeds(dealt(texts, "key")), "layer-seeds")
    left, right = s.select(F.col("key").alias("seed"), F.col("node").alias("a")), s.select(F.col("key").alias("node"), F.col("node").alias("b"))
    hops = keyed.join(left, "seed").join(right, "node").join(F.broadcast(distances(pairs.sparkSession)), ["a", "b"]).groupBy("seed", "node").agg(F.min("distance").alias("hops"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(TOKEN), F.lit(0)))
    shared = F.when(F.size(words("node")) > 0, F.size(F.array_intersect(words("seed"), words("node"))) / F.size(words("node"))).otherwise(0.0)
    by_words = F.when((F.lower("node") == F.lower("seed")) | (shared >= 0.8), 0).when(shared >= 0.3, 1)
    out = keyed.join(hops, ["seed", "node"], "left").withColumn("distance", F.coalesce("hops", by_words))
    return out.select("seed", "node", "distance", F.when(F.col("distance") == 0, "seed").when(F.col("distance") <= 2, "related").otherwise("tangential").alias("layer"))


def _has(term: str, text: Column, tokens: Column) -> Column:
    return text.contains(term) if " " in term else F.array_contains(tokens, term)


def alignment(text: Column, name: str) -> Column:
    """How well a text fits a profile, from -1 to 1."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return let(flat, lambda t: let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda w: fit(t, w, name)))


def fit(text: Column, tokens: Column, name: str) -> Column:
    """The same of a flat text with its tokens, or those of them that are profile_words()."""
    profile = PROFILES[name]
    count = lambda terms: reduce(lambda a, b: a + b, [F.when(_has(t, text, tokens), 1).otherwise(0) for t in terms], F.lit(0))
    met = reduce(lambda a, b: a + b, [F.when(reduce(lambda a, b: a | b, [_has(t, text, tokens) for t in g]), 1).otherwise(0) for g in profile["groups"]])
    score = F.least(count(profile["positive"]) * 0.08, F.lit(0.32)) + met * 0.28 - F.least(count(profile["negative"]) * 0.22, F.lit(0.66)) - (len(profile["groups"]) - met) * 0.26 - F.when(met == 0, 0.24).otherwise(0.0)
    return F.when(text == "", -1.0).otherwise(F.round(clamp(score, -1.0, 1.0), 6))


def profile_words() -> list[str]:
    """The single words that profiles ask for."""
    return sorted({t for p in PROFILES.values() for terms in (p["positive"], p["negative"], *p["groups"]) for t in terms if " " not in t})


def alignments(texts: DataFrame) -> DataFrame:
    """doc_id, profile, score of texts(doc_id, text) and every profile. Each text is flattened and cut into
    words once, and the profiles look at the few words that any of them asks for."""
    rows = texts.select("doc_id", F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).alias("flat"))
    told = F.array_intersect(F.regexp_extract_all("flat", F.lit(TOKEN), F.lit(0)), F.array(*[F.lit(w) for w in profile_words()]))
    rows = rows.withColumn("told", told)
    names = F.array(*[F.struct(F.lit(n).alias("profile"), fit(F.col("flat"), F.col("told"), n).alias("score")) for n in PROFILES])
    return rows.select("doc_id", F.explode(names).alias("x")).select("doc_id", "x.profile", "x.score")


def profile_of(query: Column) -> Column:
    """The names of the profiles that a query (lower case) is about."""
    words = F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0))
    every = lambda terms: reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in terms], F.lit(True))
    some = lambda terms: reduce(lambda a, b: a | b, [F.array_contains(words, t) for t in terms], F.lit(False))
    fits = lambda p: every(p["all"]) & (some(p["any"]) if p["any"] else F.lit(True)) & ~some(p["without"])
    return F.filter(F.array(*[F.when(fits(p), F.lit(name)) for name, p in PROFILES.items()]), lambda x: x.isNotNull())


def named_alignment(text: Column, profiles: Column, phrases: Column, phrase_hits: Column) -> Column:
    """How well a flat text fits what the named profiles of its query ask for, from -1 to 1; phrases
    are the query's own, of which phrase_hits are in the text."""
    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda tokens: _named_fit(text, tokens, profiles, phrases, phrase_hits))


def _named_fit(text: Column, tokens: Column, profiles: Column, phrases: Column, phrase_hits: Column) -> Column:
    def of(kind: str) -> dict[str, list[str]]:
        holders: dict[str, list[str]] = {}
        for name, p in PROFILES.items():
            for term in p[kind]:
                holders.setdefault(term, []).append(name)
        return holders

    total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    one = lambda test: F.when(test, 1).otherwise(0)
    mine = lambda names: reduce(lambda a, b: a | b, [F.array_contains(profiles, n) for n in names])
    count = lambda kind: total([one(mine(names) & _has(t, text, tokens)) for t, names in of(kind).items()])
    groups = [(n, reduce(lambda a, b: a | b, [_has(t, text, tokens) for t in g])) for n, p in PROFILES.items() for g in p["groups"]]
    met, missing = total([one(mine([n]) & has) for n, has in groups]), total([one(mine([n]) & ~has) for n, has in groups])
    hits = phrase_hits + total([one(mine(names) & ~F.array_contains(phrases, t) & text.contains(t)) for t, names in of("phrases").items()])
    score = F.least(hits * 0.16, F.lit(0.32)) + F.least(count("positive") * 0.08, F.lit(0.32)) + met * 0.28 - F.least(count("negative") * 0.22, F.lit(0.66)) - missing * 0.26 - F.when(met == 0, 0.24).otherwise(0.0)
    return F.when(text == "", -1.0).otherwise(F.round(clamp(score, -1.0, 1.0), 6))


def semantic_filter(rows: DataFrame, threshold: float = 0.12, keep_min: int = 1) -> DataFrame:
    """rows(query_id, pos, query, content) whose similarity to their query reaches the threshold; at
    least keep_min of each query, the most similar."""
    asked = rows.select("query").distinct().withColumn("asked", lexical_sets(F.col("query")))
    rows = rows.withColumn("told", lexical_sets(F.col("content"))).join(asked, "query")
    rows = rows.select("query_id", "pos", F.round(sets_similarity(F.col("query"), F.col("content"), F.col("asked"), F.col("told")), 6).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "pos")
    passed = F.sum(F.when(F.col("similarity") >= threshold, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_passed", passed)
    return rows.where((F.col("similarity") >= threshold) | ((F.col("_passed") < keep_min) & (F.col("_n") <= keep_min))).select("query_id", "pos", "similarity")
