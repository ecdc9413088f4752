"""What a search does when its results fall short: other queries, a test whether results miss the topic,
merged provider lists, and synthetic sources by facet. All queries at once.

Defined results: a query without content words stays as it is and its results never miss it; rows without
URL, title and text merge by what they have; a query that needs no synthetic source gets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..functions.lexicon import PROFILES
from ..functions.text import STOP_WORDS, focus_words, let, normalize_space, signature, term_key, tokenize, without_stop_words
from . import archetypes, concepts
from .titles import compact

# Fixed values that results depend on.
FILLER = "best considering could decade decades high most next one probable response should value year years".split()
LONG, MOST_WORDS, MOST_WITH_TERMS, SHORT_QUERY = 7, 6, 8, 4
PERSON_WORDS, DEPTH_WORDS = "biography career legacy", "overview background analysis"
LOOKED_AT, ENOUGH, KEY_CHARS = 10, 3, 180
WEIGHT = 0.58
FACETS = [
    ("Foundations", "core scope, baseline concepts, and the main frame for interpreting the topic"),
    ("Drivers", "forces, incentives, dependencies, and external conditions shaping outcomes"),
    ("Systems", "structures, actors, workflows, and operating models involved in the topic"),
    ("Applications", "practical use cases, deployment contexts, and observed implementation patterns"),
    ("Comparisons", "tradeoffs, competing approaches, and divergent pathways across the topic"),
    ("Constraints", "limits, risks, bottlenecks, and failure modes that complicate execution"),
    ("Evidence", "signals, measurements, indicators, and evidence gaps that matter most"),
    ("Strategy", "decision points, prioritization choices, and near-term strategic implications"),
    ("Implementation", "execution patterns, capability needs, and integration considerations"),
    ("Outlook", "future trajectories, scenario shifts, and the most consequential open questions"),
]
TEXT = (
    "{topic} encompasses important dimensions of {facet}, shaped by factors such as {lead} and {support}. Researchers and practitioners have studied {topic} across multiple contexts, "
    "applying frameworks drawn from {about} to explain observed variation in outcomes. Examining {more} alongside established models clarifies the tradeoffs, constraints, "
    "and structural dynamics that define how {topic} operates in practice.")


def simpler(query: Column, archetype: Column, profiles: Column) -> Column:
    """The words of a query that a second search asks for: long ones first, six at most, and terms of
    its profile up to eight; for a person the query with what lives hold."""
    words = without_stop_words(tokenize(query))
    once = F.array_distinct(F.filter(words, lambda w: ~w.isin(FILLER)))
    own = F.slice(F.concat(F.filter(once, lambda w: F.length(w) >= LONG), F.filter(once, lambda w: F.length(w) < LONG)), 1, MOST_WORDS)
    terms = F.array().cast("array<string>")
    for name, p in PROFILES.items():
        terms = F.when(F.array_contains(profiles, name), F.concat(terms, F.array(*[F.lit(w) for t in p["terms"] for w in t.split()]))).otherwise(terms)
    more = F.array_distinct(F.filter(terms, lambda w: ~w.isin(FILLER) & ~F.array_contains(once, w)))
    wanted = F.concat(own, F.slice(more, 1, F.greatest(MOST_WITH_TERMS - F.size(own), F.lit(0))))
    plain = normalize_space(query)
    return F.when(archetype == "person", F.concat(plain, F.lit(f" {PERSON_WORDS}"))).when(F.size(wanted) > 0, F.array_join(wanted, " ")).otherwise(plain)


def second_queries(queries: DataFrame) -> DataFrame:
    """query_id, simpler, deeper of queries(query_id, query): deeper is the simpler query, or, if
    that is the query itself, a short query asked for its background."""
    nothing = queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, rank int, title string, content string")
    rows = queries.select("query_id", normalize_space(F.col("query")).alias("query")).join(archetypes.infer(queries, nothing), "query_id")
    rows = rows.withColumn("simpler", simpler(F.col("query"), F.col("archetype"), concepts.profile_of(F.lower("query"))))
    short = F.size(F.filter(F.split("query", " "), lambda w: w != "")) <= SHORT_QUERY
    deeper = F.when(F.col("query") == "", "").when((F.col("simpler") != "") & (F.col("simpler") != F.col("query")), F.col("simpler")).when(short, F.concat("query", F.lit(f" {DEPTH_WORDS}"))).otherwise(F.col("query"))
    return rows.select("query_id", "simpler", deeper.alias("deeper"))


def missed(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, n_fitting, misses: whether fewer than three (or all) of the first ten of rows(query_id,
    rank, title, content) hold a fifth of the focus words, one of the three longest query words, and
    suit the query's profile."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    asked = queries.select("query_id", signature(F.col("query")).alias("words"), concepts.profile_of(F.lower(normalize_space(F.col("query")))).alias("profiles"))
    longest = F.slice(F.transform(F.sort_array(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 3)
    asked = asked.withColumns({"focus": focus_words(F.col("words")), "longest": longest})
    first = rows.where(F.col("rank") <= LOOKED_AT).select("query_id", text.alias("text")).join(asked, "query_id").withColumn("said", F.array_distinct(tokenize(F.col("text"))))
    enough = F.size(F.array_intersect("said", "focus")) >= F.greatest(F.lit(1), F.floor(F.size("focus") * 0.2))
    near = (F.size("focus") <= 3) | F.arrays_overlap("said", "longest")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    suits = (F.size("profiles") == 0) | (concepts.named_alignment(flat, F.col("profiles"), F.array().cast("array<string>"), F.lit(0)) > 0)
    counts = first.groupBy("query_id").agg(F.count_if(enough & near & suits).alias("n_fitting"))
    every = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = asked.join(every, "query_id", "left").join(counts, "query_id", "left")
    fitting = F.coalesce("n_fitting", F.lit(0))
    return out.select("query_id", fitting.alias("n_fitting"), ((F.size("words") > 0) & (fitting < F.least(F.coalesce("n", F.lit(0)), F.lit(ENOUGH)))).alias("misses"))


def merge_sets(primary: DataFrame, supplemental: DataFrame, limit: int) -> DataFrame:
    """query_id, place, url, title, content, provider: both lists (query_id, pos, url, title, content,
    provider), the primary first; the first row of each URL, or of each title and beginning without one, stays."""
    rows = primary.withColumn("of", F.lit(0)).unionByName(supplemental.withColumn("of", F.lit(1)))
    low = lambda c: F.lower(normalize_space(F.col(c)))
    url = web.normalize_url(F.coalesce("url", F.lit("")))
    rows = rows.withColumn("key", F.when(url != "", url).otherwise(F.concat(low("title"), F.lit("::"), F.substring(low("content"), 1, KEY_CHARS))))
    kept = rows.groupBy("query_id", "key").agg(F.min_by(F.struct("of", "pos", "url", "title", "content", "provider"), F.struct("of", "pos")).alias("x")).select("query_id", "x.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("of", "pos"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "url", "title", "content", "provider")


def evidence_terms(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, terms: the topic label, the query and the titles of its first eight rows(query_id,
    rank, title), each key once, then the query's words."""
    titles = rows.where(F.col("rank") <= 8).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))
    out = queries.join(titles, "query_id", "left")
    none = F.array().cast("array<string>")
    phrases = F.transform(F.concat(F.array(compact(F.col("query"), 4), F.col("query")), F.coalesce("titles", none)), normalize_space)
    keyed = F.filter(F.transform(phrases, lambda p: F.struct(p.alias("p"), term_key(p).alias("k"))), lambda x: x["k"] != "")
    once = let(keyed, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["k"]), x["k"]) == i + 1))
    every = F.array_distinct(F.concat(F.transform(once, lambda x: x["p"]), F.array_except(tokenize(F.col("query")), F.array(*[F.lit(w) for w in STOP_WORDS]))))
    return out.select("query_id", "query", F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("topic"))).alias("terms"))


def synthetic(queries: DataFrame, rows: DataFrame, wanted: DataFrame, facets: list[tuple[str, str]] = FACETS) -> DataFrame:
    """query_id, place, url, title, content, provider, weight: for each query as many facets as
    wanted(query_id, desired_count) says. A facet's text names evidence, which moves on by one term from facet to facet."""
    told = evidence_terms(queries, rows).join(wanted.where(F.col("desired_count") > 0), "query_id")
    topic = let(compact(F.col("query"), 4), lambda t: F.when(t != "", t).otherwise(normalize_space(F.col("query"))))
    list_ = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("facet"), F.lit(b).alias("about")) for i, (a, b) in enumerate(facets)])
    told = told.withColumn("topic", topic).withColumn("x", F.explode(F.slice(list_, F.lit(1), F.least(F.col("desired_count"), F.lit(len(facets))).cast("int")))).select("*", "x.*")
    turned = F.concat(F.slice("terms", F.pmod(F.col("i"), F.size("terms")) + 1, F.size("terms")), F.slice("terms", F.lit(1), F.least(F.col("i"), F.size("terms"))))
    turned = F.when(F.col("i") < F.size("terms"), turned).otherwise(F.col("terms"))
    kept = F.filter(turned, lambda t: (F.lower(t) != F.lower("topic")) & (F.lower(t) != F.lower("query")))
    capital = F.transform(kept, lambda t: F.when((t == F.lower(t)) & (F.length(t) <= 14), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 100))).otherwise(t))
    told = told.withColumn("named", capital)
    slot = {"topic": F.col("topic"), "facet": F.lower("facet"), "about": F.col("about"), "lead": F.coalesce(F.get("named", F.lit(0)), "facet"), "support": F.coalesce(F.get("named", F.lit(1)), "topic"), "more": F.coalesce(F.get("named", F.lit(2)), "query")}
    text: list[Column] = []
    for part in TEXT.replace("{", "\0{").replace("}", "}\0").split("\0"):
        text.append(slot[part[1:-1]] if part.startswith("{") else F.lit(part))
    title = F.btrim(F.concat("facet", F.lit(": "), F.col("topic")), F.lit(": "))
    return told.select("query_id", (F.col("i") + 1).alias("place"), F.concat(F.lit("https://knowledge-base.local/adaptive/"), F.col("i")).alias("url"), title.alias("title"), normalize_space(F.concat(*text)).alias("content"), F.lit("local-synthesis").alias("provider"), F.lit(WEIGHT).alias("weight"))
