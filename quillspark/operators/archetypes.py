"""What kind of topic a query is, from its words and the evidence of its best rows, and the label that
its titles give it. All queries at once: evidence is counted by row, summed by query, and one ordered
cascade of rules decides.

Defined results: a query without text or rows is judged by what is there, so it is `generic` unless
its words decide; null titles and contents count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import raw_words
from ..functions.text import STOP_WORDS, normalize_space
from . import concepts

# Fixed values that results depend on.
QUESTIONS = "what when where which who why how can could should would will may might".split()
COMPARING = "vs versus against".split()
MOUNTS = "mount mt".split()
OFFICES = ["(born", " prime minister", " president"]
ORGANIZATIONS = "inc corp corporation company co group bank university committee association ministry agency foundation institute council department".split()
PLACES = "country state city province region district island nation kingdom republic federation territory".split()
#: Words of a query, and terms of texts that support it, by kind.
ASKED = {
    "organization": (
        "business company corporate earnings equity guidance editorial journalism magazine media newspaper newsroom management margin margins outlet platform press "
        "product products publication publisher revenue revenues shareholder stock stocks valuation").split(),
    "market": (
        "capital capacity commodity commodities demand equities equity exchange exports industry industries investment investments liquidity logistics manufacturing "
        "market markets pricing production sector sectors shipping supply trade valuation yields").split(),
    "technology": (
        "ai aerospace algorithm algorithms api apis astronaut automation chip chips cloud compute cybersecurity data digital launch lunar mission missions model models "
        "moon nasa orbit orbital orion platform platforms robotics rocket rockets semiconductor semiconductors software space spacecraft technology technologies").split(),
    "place": "border elevation glacier himalaya himalayas mount mountain peak plateau route summit terrain valley volcano".split(),
}
TOLD = {
    "organization": [
        "board", "business model", "customer", "customers", "ecosystem", "editorial", "executive", "gross margin", "journalism", "management", "market share", "media outlet",
        "newsroom", "platform", "portfolio", "press freedom", "product", "products", "profit", "publication", "publisher", "reporting", "revenue", "revenues", "supplier"],
    "market": [
        "capital flow", "capital flows", "commodity", "commodities", "currency stability", "demand", "disclosure", "earnings", "exchange", "foreign inflow", "foreign investment",
        "inventory", "liquidity", "market", "pricing", "production", "regulation", "sector rotation", "supply chain", "trade", "valuation"],
    "technology": [
        "adoption", "astronaut", "benchmark", "capability", "capabilities", "chip", "chips", "cloud", "compute", "crew", "data center", "deployment", "ecosystem", "evaluation",
        "frontier model", "frontier models", "governance", "inference", "launch", "lunar", "mission", "mission architecture", "model", "models", "moon", "nasa", "orbit", "orbital",
        "orion", "payload", "platform", "platforms", "rocket", "safety", "software", "spacecraft", "workflows"],
    "place": [
        "border", "capital city", "city-state", "demographic", "elevation", "glacier", "governance", "housing policy", "infrastructure planning", "institutional structure",
        "mountain", "peak", "population", "regional role", "summit", "urban system", "valley"],
    "person": [
        "biography", "biographical", "born", "career", "legacy", "leader", "leadership", "politician", "statesman", "prime", "minister", "president", "founder", "author",
        "scientist", "artist", "writer", "actor", "activist", "speech", "government", "administration", "office", "cabinet", "reform"],
}
IMPACT, EVENTS = ["iran_war_impact"], ["thomas_cup", "fifa_world_cup_2026"]
BEST_ROWS, LEAD, LABEL_ROWS, ALIKE = 6, 420, 8, 0.74
LABEL_ENDS = r"\s+[|\-:]\s+|\s+\(|\s+\["


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def evidence(rows: DataFrame) -> DataFrame:
    """query_id and a score for each kind of rows(query_id, rank, title, content): by row, 1 for one
    term, 2 for two, 3 for four (persons: 2 at most, and 2 for an office)."""
    text = F.lower(normalize_space(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, LEAD))))
    best = rows.where(F.col("rank") <= BEST_ROWS).select("query_id", text.alias("text"))
    hits = best.select("query_id", *[_sum([F.when(F.contains("text", F.lit(t)), 1).otherwise(0) for t in terms]).alias(kind) for kind, terms in TOLD.items()],
                       reduce(lambda a, b: a | b, [F.contains("text", F.lit(t)) for t in OFFICES]).alias("office"))
    steps = lambda c: F.when(F.col(c) >= 4, 3).when(F.col(c) >= 2, 2).when(F.col(c) == 1, 1).otherwise(0)
    person = F.least(steps("person"), F.lit(2)) + F.when(F.col("office"), 2).otherwise(0)
    return hits.groupBy("query_id").agg(*[F.sum(person if k == "person" else steps(k)).alias(k) for k in TOLD])


def infer(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, archetype of queries(query_id, query) with their ranked rows."""
    asked = queries.select("query_id", normalize_space(F.col("query")).alias("query")).withColumn("raw", raw_words(F.col("query")))
    asked = asked.withColumns({"low": F.transform("raw", F.lower), "profiles": concepts.profile_of(F.lower("query"))})
    asked = asked.withColumns({"kept": F.filter("low", lambda w: ~w.isin(STOP_WORDS)), "titled": F.size(F.filter("raw", lambda w: w.rlike("^[A-Z]")))})
    told = asked.join(evidence(rows), "query_id", "left")
    n = lambda kind: F.size(F.filter("kept", lambda w: w.isin(ASKED[kind])))
    support = lambda kind: F.coalesce(F.col(kind), F.lit(0))
    some = lambda c, words: F.exists(c, lambda w: w.isin(words))
    words, ratio = F.size("raw"), F.col("titled") / F.greatest(F.size("raw"), F.lit(1))
    compares, mount = some("low", COMPARING), F.coalesce(F.get("low", F.lit(0)).isin(MOUNTS), F.lit(False))
    named = F.arrays_overlap("profiles", F.array(*[F.lit(p) for p in IMPACT])), F.arrays_overlap("profiles", F.array(*[F.lit(p) for p in EVENTS]))
    plain_name = (ratio >= 0.85) & ~compares & ~some("low", [*QUESTIONS, *ORGANIZATIONS, *PLACES, *ASKED["place"]]) & ~mount
    kind = (
        F.when(named[0], "impact").when(named[1], "generic")
        .when((compares & ((n("organization") >= 1) | (support("organization") >= 1))) | some("kept", ORGANIZATIONS) | (n("organization") >= 2), "organization")
        .when(((n("organization") >= 1) & (F.col("titled") > 0)) | (support("organization") >= 3), "organization")
        .when((n("market") >= 2) | (support("market") >= 3), "market").when((n("technology") >= 2) | (support("technology") >= 3), "technology")
        .when(mount | (n("place") >= 2) | some("kept", PLACES) | (support("place") >= 2), "place")
        .when(compares & (ratio >= 0.4), "generic").when(support("person") >= 2, "person")
        .when(words.between(2, 4) & plain_name, "person").otherwise("generic"))
    return told.select("query_id", kind.alias("archetype"))


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all: the longest common block, then on both sides of it."""
    return SequenceMatcher(None, a, b).ratio()


def canonical_labels(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, label: of the first eight titles, cut at a separator, the one most like the query (ties:
    the first) if it is ALIKE; else the query. Titles whose length alone rules that out are never compared."""
    asked = queries.select("query_id", normalize_space(F.col("query")).alias("query"))
    heads = rows.where(F.col("rank") <= LABEL_ROWS).select("query_id", "rank", F.btrim(F.element_at(F.split(normalize_space(F.col("title")), LABEL_ENDS, 2), 1), F.lit(" -:|")).alias("label"))
    pairs = heads.where("label <> ''").join(asked, "query_id")
    a, b = F.length("query"), F.length("label")
    pairs = pairs.where(2 * F.least(a, b) >= ALIKE * (a + b))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["query_id", "rank", "label"]].assign(ratio=[block_ratio(q.lower(), x.lower()) for q, x in zip(f["query"], f["label"], strict=True)])

    kinds = dict(pairs.dtypes)
    scored = pairs.mapInPandas(run, f"query_id {kinds['query_id']}, rank {kinds['rank']}, label string, ratio double")
    w = Window.partitionBy("query_id").orderBy(F.desc("ratio"), "rank")
    best = scored.where(F.col("ratio") >= ALIKE).withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "label")
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("label", "query").alias("label"))
