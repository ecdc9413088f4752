"""Named queries, each over whole tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, sets, structure, text, web
from ..operators import archetypes, book, clusters, concepts, fallback, feedback, frontier, latent, learning, merge, quality, selection
from ..operators.staging import dealt, shared_dir, small, stage
from ..streaming import feedback as stream
from . import oracles as O  # noqa: N812, E741

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its oracle."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lower(c):
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def _sources(spark, sf_dir) -> DataFrame:
    return frontier.sources(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- text functions


@query(f"SELECT doc_id, length({O.norm('text')}) AS n_clean, md5({O.norm('text')}) AS clean_md5 FROM documents")
def normalize_space_stats(spark, sf_dir):
    clean = text.normalize_space(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean).alias("clean_md5"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_distinct({O.content('t')})) AS n_signature FROM (SELECT doc_id, {O.tok('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    n = lambda c: F.size(c).cast("long")
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", n("t").alias("n_tokens"), n(F.array_distinct("t")).alias("n_distinct"), n(F.array_except("t", F.array(*[F.lit(w) for w in text.STOP_WORDS]))).alias("n_signature"))


@query(f"SELECT doc_id, round({O.ratio('t')}, 6) AS unique_ratio FROM (SELECT doc_id, {O.tok('text')} AS t FROM documents)")
def token_unique_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.unique_ratio(F.col("text")), 6).alias("unique_ratio"))


@query(f"SELECT doc_id, len({O.sentences('text')}) AS n_sentences, len({O.usable('text')}) AS n_usable FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.size(text.usable_sentences(F.col("text"))).cast("long").alias("n_usable"))


@query(f"""SELECT doc_id, i - 1 AS sentence_index, length(s) AS n_chars, len(list_distinct({O.tok('s')})) AS n_words FROM
(SELECT doc_id, unnest({O.usable('text')}) AS s, generate_subscripts({O.usable('text')}, 1) AS i FROM documents)""")
def sentence_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.usable_sentences(F.col("text"))).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("sentence_index"), F.length("s").cast("long").alias("n_chars"), F.size(F.array_distinct(text.tokenize(F.col("s")))).cast("long").alias("n_words"))


@query(f"""WITH s AS (SELECT doc_id, unnest({O.sentences('text')}) AS s, generate_subscripts({O.sentences('text')}, 1) AS i FROM documents),
c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM s),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM c WHERE i <= 6 AND (i = 1 OR upto <= 1800) GROUP BY 1)
SELECT d.doc_id, length(substring(coalesce(t, ''), 1, 1800)) AS n_summary, md5(substring(coalesce(t, ''), 1, 1800)) AS summary_md5 FROM documents d LEFT JOIN k USING (doc_id)""")
def summarize_budget(spark, sf_dir):
    s = text.summarize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(s).cast("long").alias("n_summary"), F.md5(s).alias("summary_md5"))


@query(f"SELECT item_id, array_to_string(list_slice({O.content(O.tok('text'))}, 1, 6), ' ') AS term_key FROM benchmark")
def term_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.term_key(F.col("text")).alias("term_key"))


@query(f"WITH {O.TOPICS} SELECT query_id, word FROM focus")
def focus_word_variants(spark, sf_dir):
    return frontier.topics(table(spark, sf_dir, "benchmark")).select("query_id", F.explode("focus").alias("word"))


@query(f"SELECT doc_id, count(DISTINCT w) AS n_concepts FROM (SELECT doc_id, unnest({O.content(O.tok('text'))}) AS w FROM documents) WHERE length(w) > 8 GROUP BY 1")
def concept_long_words(spark, sf_dir):
    long_words = F.filter(text.signature(F.col("text")), lambda w: F.length(w) > 8)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(long_words).cast("long").alias("n_concepts")).where("n_concepts > 0")


# ---------------------------------------------------------------- pages


_URL = f"SELECT page_id, url, {O._HOST} AS h, {O._PATH} AS p FROM pages"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/?#()<>"'']+([/?#]|$)') THEN u ELSE '' END AS url, regexp_replace(regexp_replace(u, '#.*$', ''), '/+$', '') AS url_key
FROM (SELECT page_id, regexp_replace(trim(regexp_replace(url, '\\s+', ' ', 'g')), '^[.,;)]+|[.,;)]+$', '', 'g') AS u FROM pages)""")
def url_normalize(spark, sf_dir):
    u = web.normalize_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url"), web.key_url(u).alias("url_key"))


@query(f"SELECT page_id, regexp_replace(h, '^www\\.', '') AS domain FROM ({_URL})")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.domain(F.col("url")).alias("domain"))


@query()
def url_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.title_from_url(F.col("url")).alias("title"))


@query(f"SELECT page_id FROM ({_URL}) WHERE regexp_matches(url, '^https?://[^/?#]') AND NOT {O._INTERNAL} AND NOT regexp_matches(lower(p), '\\.({'|'.join(web.FILE_SUFFIXES)})$')")
def fetchable_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(web.fetchable(F.col("url"))).select("page_id")


@query(f"SELECT page_id, {O.TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, length(r) AS n_chars, md5(r) AS text_md5 FROM (SELECT page_id, {O.READABLE} AS r FROM pages)")
def html_readable_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", web.readable_text(F.col("html")).alias("r"))
    return rows.select("page_id", F.length("r").cast("long").alias("n_chars"), F.md5("r").alias("text_md5"))


@query(f"""WITH r AS (SELECT page_id, {O.TITLE} AS title, {O.READABLE} AS text, url FROM pages WHERE page_id IN (SELECT page_id FROM ({_URL}) WHERE regexp_matches(url, '^https?://[^/?#]') AND NOT {O._INTERNAL} AND NOT regexp_matches(lower(p), '\\.({'|'.join(web.FILE_SUFFIXES)})$'))),
s AS (SELECT page_id, unnest({O.sentences('text')}) AS s, generate_subscripts({O.sentences('text')}, 1) AS i FROM r),
c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY page_id ORDER BY i) - 1 AS upto FROM s),
k AS (SELECT page_id, string_agg(s, ' ' ORDER BY i) AS t FROM c WHERE i <= 6 AND (i = 1 OR upto <= 1800) GROUP BY 1)
SELECT page_id, title, length(substring(coalesce(t, ''), 1, 1800)) AS n_excerpt, md5(substring(coalesce(t, ''), 1, 1800)) AS excerpt_md5 FROM r LEFT JOIN k USING (page_id)""")
def page_documents(spark, sf_dir):
    """Title and excerpt of each stored page that a fetch would take."""
    rows = table(spark, sf_dir, "pages").where(web.fetchable(F.col("url"))).select("page_id", web.html_title(F.col("html")).alias("title"), text.summarize(web.readable_text(F.col("html"))).alias("t"))
    return rows.select("page_id", "title", F.length("t").cast("long").alias("n_excerpt"), F.md5("t").alias("excerpt_md5"))


@query(f"""SELECT page_id, round(greatest(0.40::DOUBLE, least(0.99::DOUBLE, 0.48::DOUBLE + CASE WHEN contains(h, 'wikipedia.org') THEN 0.38::DOUBLE WHEN h LIKE '%.gov' THEN 0.28::DOUBLE WHEN h LIKE '%.edu' THEN 0.24::DOUBLE WHEN h LIKE '%.org' THEN 0.16::DOUBLE WHEN h LIKE '%.com' THEN 0.10::DOUBLE ELSE 0 END
 + CASE WHEN len({O.usable('r')}) >= 4 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len({O.tok('t')}) >= 2 THEN 0.03::DOUBLE ELSE 0 END)), 4) AS authority
FROM (SELECT page_id, {O._HOST} AS h, {O.READABLE} AS r, {O.TITLE} AS t FROM pages)""")
def authority_score(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", web.readable_text(F.col("html")).alias("r"), web.html_title(F.col("html")).alias("t"))
    return rows.select("page_id", web.authority(F.col("url"), F.col("r"), F.col("t")).alias("authority"))


# ---------------------------------------------------------------- features, ranking, gate


@query(f"WITH {O.SOURCES} {O.SPAM}")
def spam_risk(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", frontier.spam_risk(F.col("title"), F.col("content")).alias("spam_risk"))


@query(f"WITH {O.SOURCES} SELECT doc_id, {O.DEFINITIONAL} AS definitional_density FROM src")
def definitional_density(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", frontier.definitional_density(F.col("title"), F.col("content")).alias("definitional_density"))


@query(f"WITH {O.SOURCES} SELECT doc_id, {O.DEPTH} AS content_depth FROM src")
def content_depth(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", frontier.content_depth(F.col("content")).alias("content_depth"))


@query(f"WITH {O.RANKED} SELECT query_id, doc_id, relevance, score, authority, informative, spam, coherence, CAST(rank AS INT) AS rank FROM ranked")
def lexical_relevance_topk(spark, sf_dir):
    return frontier.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"WITH {O.QUALITY} SELECT * FROM quality")
def frontier_quality(spark, sf_dir):
    return frontier.quality(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"WITH {O.QUALITY} SELECT query_id, real_count, avg_frontier_score, avg_relevance, coverage_ratio, use_fallback, desired_count FROM ({O.GATE})")
def fallback_gate(spark, sf_dir):
    return frontier.gate(frontier_quality(spark, sf_dir))


def _ranked_sources(spark, sf_dir) -> DataFrame:
    """The frontier with what selection needs."""
    docs = table(spark, sf_dir, "documents")
    ranked = frontier.rank(table(spark, sf_dir, "benchmark"), docs)
    signature = text.signature(F.col("text"))
    extra = docs.join(small(stage(ranked.select("doc_id").distinct(), "ranked-ids")), "doc_id", "left_semi")
    extra = extra.select("doc_id", signature.alias("words"), F.slice(F.filter(signature, lambda w: F.length(w) > 8), 1, 6).alias("concepts"))
    return ranked.join(extra, "doc_id")


def _frontier_texts(spark, sf_dir) -> DataFrame:
    """query_id, doc_id, rank, text, query: the frontier with texts. Only documents in it go beyond the
    reading tasks, as they are; what is made of a text is made of these."""
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    ranked = frontier.rank(bench, docs).select("query_id", "doc_id", "rank")
    held = docs.select("doc_id", "text").join(small(stage(ranked.select("doc_id").distinct(), "ranked-ids")), "doc_id", "left_semi")
    rows = held.join(ranked, "doc_id").join(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return stage(dealt(rows, "query_id", "doc_id"), "frontier-texts")


def _frontier_pairs(ranked: DataFrame) -> DataFrame:
    """query_id, x, y (rank, words) of every two rows of a frontier, which has FRONTIER rows at most:
    made inside the query's one row, so the frontier is computed once and meets no other query."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "words")))
    lists = ranked.groupBy("query_id").agg(rows.alias("rows"))
    first = lists.select("query_id", "rows", F.explode("rows").alias("x"))
    return first.select("query_id", "x", F.explode(F.filter("rows", lambda y: y["rank"] > F.col("x.rank"))).alias("y"))


@query(f"""WITH {O.RANKED}, sig AS (SELECT doc_id, list_distinct({O.content(O.tok('text'))}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ranked)),
p AS (SELECT a.query_id, CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE ELSE 0.0::DOUBLE END AS j
 FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank JOIN sig x ON x.doc_id = a.doc_id JOIN sig y ON y.doc_id = b.doc_id)
SELECT query_id, round(avg(j), 6) AS redundancy FROM p GROUP BY 1""")
def pairwise_redundancy(spark, sf_dir):
    return _frontier_pairs(_ranked_sources(spark, sf_dir)).groupBy("query_id").agg(F.round(F.avg(sets.jaccard(F.col("x.words"), F.col("y.words"))), 6).alias("redundancy"))


def _structured_sources(spark, sf_dir) -> DataFrame:
    """The frontier with words, and the definitions and subtopics of its rows as concepts and structure."""
    docs, topics = _sources(spark, sf_dir), stage(frontier.topics(table(spark, sf_dir, "benchmark")), "topics")
    ranked = frontier.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    ids = small(stage(ranked.select("doc_id").distinct(), "ranked-ids"))
    texts = docs.join(ids, "doc_id", "left_semi").withColumn("signature", text.signature(F.col("content")))
    rows = stage(texts.join(ranked, "doc_id").join(small(topics), "query_id"), "ranked-sources")  # read more than once below
    rows = structure.structured(rows)
    names = F.concat(F.transform("definitions", lambda d: d["term"]), F.transform("subtopics", lambda t: t["title"]))
    keys = F.array_distinct(F.filter(F.transform(names, text.term_key), lambda k: k != ""))
    return stage(rows.withColumn("n_structure", F.size("definitions") + F.size("subtopics")).withColumn("concepts", keys).withColumn("asked", F.col("words")).withColumn("words", F.col("signature")).drop("signature"), "structured")


def _rewards(spark, sf_dir) -> dict[str, float]:
    """The learned reward weights: nine numbers."""
    row = learning.profile(learning.merged(learning.patches(table(spark, sf_dir, "events")))).first()
    return {w: row[w] for w in feedback.WEIGHTS}


@query()
def greedy_selection(spark, sf_dir):
    return selection.greedy(_structured_sources(spark, sf_dir))


@query()
def evolve_selection(spark, sf_dir):
    return selection.evolve(_structured_sources(spark, sf_dir), rewards=_rewards(spark, sf_dir))


@query()
def structured_fitness(spark, sf_dir):
    """The fitness of the set that the search chose for each topic, with its structure."""
    rows, rewards = _structured_sources(spark, sf_dir), _rewards(spark, sf_dir)
    picks = stage(selection.evolve(rows, rewards=rewards), "picks")
    members = rows.join(picks.select("query_id", "doc_id"), ["query_id", "doc_id"]).withColumns({"set_id": F.col("query_id"), "place": F.col("rank")})
    return selection.fitness(members, rows.groupBy("query_id").agg(F.first("focus").alias("focus")), rewards)


@query(f"""WITH {O.RANKED}, m AS MATERIALIZED (SELECT *, query_id * 4 + (rank - 1) // 6 AS set_id, list_distinct(l) AS w, [x for x, i in long if list_position(long, x) = i][1:6] AS k
 FROM (SELECT *, [x for x in l if length(x) > 8] AS long FROM (SELECT r.*, {O.content(O.tok('text'))} AS l FROM ranked r JOIN documents USING (doc_id)))),
o AS (SELECT *, flatten(list(k) OVER (PARTITION BY set_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen FROM m),
s AS (SELECT set_id, query_id, avg(relevance) AS r, avg(informative) AS i, avg(authority) AS a, avg(spam) AS x, avg(coherence) AS h, avg(CASE WHEN len(k) > 0 THEN 1 - len(list_intersect(k, coalesce(seen, []))) / len(k)::DOUBLE ELSE 0.55::DOUBLE END) AS d, list_distinct(flatten(list(w))) AS w FROM o GROUP BY 1, 2),
p AS (SELECT a.set_id, avg(len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)::DOUBLE) AS j FROM m a JOIN m b ON a.set_id = b.set_id AND a.rank < b.rank GROUP BY 1),
f AS (SELECT s.*, coalesce(j, 0.0::DOUBLE) AS j, CASE WHEN len(fw) > 0 THEN len(list_intersect(w, fw)) / len(fw)::DOUBLE ELSE 1.0::DOUBLE END AS c FROM s LEFT JOIN p USING (set_id) JOIN fset USING (query_id))
SELECT set_id, query_id, round(round(c, 12), 6) AS coverage, round(round(d, 12), 6) AS concept_diversity, round(round(1 - j, 12), 6) AS pairwise_diversity, 0.0::DOUBLE AS structure,
 round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (r * 0.25::DOUBLE * w_r + i * 0.20::DOUBLE * w_e + a * 0.18::DOUBLE * w_a + c * 0.14::DOUBLE * w_c + d * 0.13::DOUBLE * w_d) / (0.25::DOUBLE * w_r + 0.20::DOUBLE * w_e + 0.18::DOUBLE * w_a + 0.14::DOUBLE * w_c + 0.13::DOUBLE * w_d + 0.10::DOUBLE * w_s)
   * (0.65::DOUBLE + 0.35::DOUBLE * (1 - j)) * (0.88::DOUBLE + 0.12::DOUBLE * w_n) + h * 0.035::DOUBLE * w_h - x * 0.055::DOUBLE)), 12), 6) AS total
FROM f, (SELECT relevance AS w_r, evidenceDensity AS w_e, authority AS w_a, coverage AS w_c, diversity AS w_d, structure AS w_s, antiRedundancy AS w_n, coherence AS w_h FROM ({O.LEARNED}))""")
def fitness_of_individuals(spark, sf_dir):
    rows = _ranked_sources(spark, sf_dir)
    members = rows.withColumn("set_id", F.col("query_id") * 4 + F.floor((F.col("rank") - 1) / 6)).withColumn("place", F.col("rank"))
    return selection.fitness(members, frontier.topics(table(spark, sf_dir, "benchmark")).select("query_id", "focus"), _rewards(spark, sf_dir))


_GRAMS = "list_distinct([substring(t, i, 4) for i in range(1, greatest(length(t) - 3, 0) + 1)])"


@query(f"""WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark),
g AS (SELECT item_id, t, list_distinct(regexp_extract_all(t, {O.q(text.TOKEN)})) AS w, {_GRAMS} AS c FROM b)
SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN x.t = '' OR y.t = '' THEN 0.0::DOUBLE WHEN x.t = y.t THEN 1.0::DOUBLE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0.0::DOUBLE ELSE
 0.55::DOUBLE * len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) + 0.45::DOUBLE * CASE WHEN len(x.c) = 0 OR len(y.c) = 0 THEN 0 ELSE len(list_intersect(x.c, y.c)) / (len(x.c) + len(y.c) - len(list_intersect(x.c, y.c)))::DOUBLE END END, 6) AS similarity
FROM g x JOIN g y ON y.item_id = x.item_id + 1""")
def char_ngram_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("t")).withColumn("s", sets.lexical_sets(F.col("t")))
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.col("y.item_id") == F.col("x.item_id") + 1).select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.round(sets.sets_similarity(F.col("x.t"), F.col("y.t"), F.col("x.s"), F.col("y.s")), 6).alias("similarity"))


# ---------------------------------------------------------------- merging


@query("""SELECT doc_id, provider, round, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY round, provider, doc_id) AS INT) AS place FROM
(SELECT doc_id, source AS provider, lang AS bucket, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS INT) AS round FROM documents))""")
def provider_interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("bucket"))
    return merge.interleave(rows, "provider", ["doc_id"], ["bucket"]).select("doc_id", "provider", "round", "place")


@query("SELECT doc_id, title FROM (SELECT doc_id, lower(substring(text, 1, 180)) AS title, row_number() OVER (PARTITION BY lower(substring(text, 1, 180)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring("text", 1, 180)).alias("title"))
    return merge.first_wins(rows, ["title"], ["doc_id"])


_KEY = f"lower({O.norm('title')}) || '::' || substring(lower({O.norm('content')}), 1, 180)"


@query(f"""WITH {O.SOURCES} SELECT key, arg_max(content, (length(content), -doc_id)) AS content, count(*) AS n_merged, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers
FROM (SELECT *, {_KEY} AS key FROM src) GROUP BY key""")
def dedupe_merge_by_key(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    key = F.concat(F.lower(text.normalize_space(F.col("title"))), F.lit("::"), F.substring(F.lower(text.normalize_space(F.col("content"))), 1, 180))
    rows = rows.select(F.col("doc_id").alias("pos"), key.alias("key"), "title", "content", "provider", F.lit(0.5).alias("informative_score"), F.lit(0.5).alias("authority_score"))
    return merge.merge_by_key(rows, "key").select("key", "content", "n_merged", F.array_join("providers", ",").alias("providers"))


def _frontier_rows(spark, sf_dir) -> DataFrame:
    """The frontier as a result list, with scores, definitions and subtopics. Documents have no URL, so their own is their id."""
    rows = _structured_sources(spark, sf_dir)
    return rows.select("query_id", F.col("rank").cast("long").alias("pos"), F.concat(F.lit("https://local/"), F.col("doc_id")).alias("url"), "title", "content", "provider", F.col("informative").alias("informative_score"), F.col("authority").alias("authority_score"), "definitions", "subtopics")


@query()
def dedupe_ordered_fold(spark, sf_dir):
    return merge.ordered_fold(_frontier_rows(spark, sf_dir))


@query()
def near_duplicate_fold(spark, sf_dir):
    return merge.near_fold(_frontier_rows(spark, sf_dir))


# ---------------------------------------------------------------- books, feedback, metrics


@query("SELECT conv_id, turn, 3 + coalesce(sum(pages) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS title_page FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS pages FROM conversations)")
def page_numbers(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    pages = F.when(F.col("role") == "assistant", 2).otherwise(1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (3 + F.coalesce(F.sum(pages).over(w), F.lit(0))).cast("long").alias("title_page"))


@query(O.PROFILE)
def feedback_reward_profile(spark, sf_dir):
    return feedback.reward_profile(feedback.records(table(spark, sf_dir, "events")))


@query(O.DOMINANT)
def feedback_dominant_issues(spark, sf_dir):
    return feedback.dominant_issues(feedback.records(table(spark, sf_dir, "events")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def feedback_latest_upsert(spark, sf_dir):
    return feedback.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def feedback_event_antijoin(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return feedback.new_events(events.where("event_type = 'click'"), events).select("event_id", "user_id")




@query("""SELECT l_returnflag, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS stdev, min(x) AS lowest, max(x) AS highest, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75
FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1""")
def metric_distribution(spark, sf_dir):
    return quality.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").drop("n")


@query("""SELECT coalesce(tag, 'all') AS tag, n, round(total, 2) AS total FROM (SELECT o_orderpriority AS tag, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ()))""")
def tag_packs_grouping(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return rows.select(F.coalesce("o_orderpriority", F.lit("all")).alias("tag"), "n", F.round("total", 2).alias("total"))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS similarity FROM v JOIN c USING (label, i) GROUP BY 1""")
def vector_centroid_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = v.groupBy("label", "i").agg(F.avg("x").alias("m"))
    x, m = F.col("x"), F.col("m")
    return v.join(c, ["label", "i"]).groupBy("vec_id").agg(F.round(F.sum(x * m) / (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(m * m))), 5).alias("similarity"))


# ---------------------------------------------------------------- concepts and profiles





@query(f"""WITH RECURSIVE asked AS (SELECT item_id AS query_id, {O.flat('text')} AS qs, {O.words_of(O.flat('text'))} AS qw FROM benchmark), {O.SEEDS},
walk AS (SELECT query_id, node AS concept, 0 AS d FROM g_seed UNION SELECT query_id, e.b, w.d + 1 FROM walk w JOIN edge e ON w.concept = e.a WHERE w.d < {concepts.HOPS})
SELECT query_id, concept, min(d) AS distance FROM walk GROUP BY 1, 2""")
def graph_distance(spark, sf_dir):
    """How far each concept is from those that a topic names."""
    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), _lower(F.col("text")).alias("text"))
    near = concepts.seeds(topics).withColumnRenamed("node", "a").join(F.broadcast(concepts.distances(spark)), "a")  # pairs of the fixed lexicon
    return near.groupBy(F.col("key").alias("query_id"), F.col("b").alias("concept")).agg(F.min("distance").alias("distance"))


@query()
def graph_expansion(spark, sf_dir):
    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), _lower(F.col("text")).alias("text"))
    return concepts.expand(topics).withColumnRenamed("key", "query_id")


@query()
def concept_layers(spark, sf_dir):
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    rows = frontier.rank(bench, docs).select("query_id", "doc_id").join(bench.select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("seed")), "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("node")), "doc_id")
    return rows.join(concepts.layers(rows.select("seed", "node")), ["seed", "node"]).select("query_id", "doc_id", "distance", "layer")


@query(O.ALIGNMENT)
def profile_alignment(spark, sf_dir):
    return concepts.alignments(table(spark, sf_dir, "documents"))


@query(f"""WITH {O.RANKED}, k AS (SELECT query_id, rank, lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS t
 FROM ranked JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)),
g AS (SELECT *, list_distinct(regexp_extract_all(t, {O.q(text.TOKEN)})) AS w, list_distinct(regexp_extract_all(q, {O.q(text.TOKEN)})) AS qw, {_GRAMS} AS c, {_GRAMS.replace('(t', '(q')} AS qc FROM k),
s AS (SELECT query_id, rank AS pos, round(CASE WHEN t = '' OR q = '' THEN 0.0::DOUBLE WHEN t = q THEN 1.0::DOUBLE WHEN len(w) = 0 OR len(qw) = 0 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE * len(list_intersect(w, qw)) / (len(w) + len(qw) - len(list_intersect(w, qw)))
 + 0.45::DOUBLE * CASE WHEN len(c) = 0 OR len(qc) = 0 THEN 0 ELSE len(list_intersect(c, qc)) / (len(c) + len(qc) - len(list_intersect(c, qc)))::DOUBLE END END, 6) AS similarity FROM g)
SELECT query_id, CAST(pos AS INT) AS pos, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS n, count(*) FILTER (similarity >= 0.12) OVER (PARTITION BY query_id) AS passed FROM s)
WHERE similarity >= 0.12 OR (passed < 3 AND n <= 3)""")
def semantic_filter(spark, sf_dir):
    lower = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = _frontier_texts(spark, sf_dir).select("query_id", F.col("rank").alias("pos"), lower("query").alias("query"), lower("text").alias("content"))
    return concepts.semantic_filter(rows, keep_min=3)


# ---------------------------------------------------------------- rules about texts, tags and scores


_TITLE, _BODY = O.norm("title"), O.norm("content")
_ALL = f"regexp_extract_all(lower({_TITLE} || ' ' || {_BODY}), '\\S+')"
_SQUEEZED = f"regexp_replace({_TITLE}, '\\s+', '', 'g')"


@query(f"""WITH {O.SOURCES} SELECT doc_id, {_TITLE} = '' AS empty, regexp_matches({_SQUEEZED}, '^[0-9]+$') AS digits, regexp_matches({_SQUEEZED}, '[0-9]{{10,}}') AS number,
 length({_TITLE}) > 40 AND NOT contains({_TITLE}, ' ') AS unbroken, length({_SQUEEZED}) > 12 AND NOT regexp_matches({_SQUEEZED}, '(?i)[aeiou]') AS voiceless,
 regexp_matches(lower({_TITLE}), {O.q(rules.POISON)}) OR regexp_matches(lower({_BODY}), {O.q(rules.POISON)}) AS poison,
 len({_ALL}) > 30 AND len(list_distinct({_ALL})) / len({_ALL})::DOUBLE < 0.35 AS monotonous,
 regexp_matches({_TITLE}, {O.q(rules.MNEMONIC)}) OR regexp_matches({_BODY}, {O.q(rules.MNEMONIC)}) AS mnemonic, regexp_matches({_TITLE}, {O.q(rules.HEX_ROW)}) AS hex FROM src""")
def text_rejections(spark, sf_dir):
    """The rules that SQL can express; meaningful_text_filter has all."""
    found = rules.rejections(F.col("title"), F.col("content"))
    return _sources(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in found.items() if k not in ("run", "chunks")])


@query()
def meaningful_text_filter(spark, sf_dir):
    return _sources(spark, sf_dir).where(rules.meaningful(F.col("title"), F.col("content"))).select("doc_id", "title")


_COMP = "trim(regexp_replace(replace(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))"
_COMP_TOKENS = f"list_distinct([w for w in string_split({_COMP}, ' ') if length(w) >= 3 and not list_contains([{', '.join(O.q(w) for w in rules.COMPARE_STOP)}], w)])"


@query(f"SELECT doc_id, md5({_COMP}) AS comparable_md5, len({_COMP_TOKENS}) AS n_tokens, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''.-]{{1,}}')) AS n_raw FROM documents")
def comparable_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.comparable(t)).alias("comparable_md5"), F.size(rules.comparable_tokens(t)).cast("long").alias("n_tokens"), F.size(rules.raw_words(t)).cast("long").alias("n_raw"))


@query(f"""WITH c AS (SELECT item_id, {_COMP} AS t, {_COMP_TOKENS} AS w FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN x.t = '' OR y.t = '' THEN 0.0::DOUBLE WHEN x.t = y.t THEN 1.0::DOUBLE
 WHEN least(length(x.t), length(y.t)) >= 28 AND CASE WHEN length(x.t) <= length(y.t) THEN contains(y.t, x.t) ELSE contains(x.t, y.t) END THEN 0.96::DOUBLE
 WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE END, 6) AS similarity
FROM c x JOIN c y ON y.item_id = x.item_id + 1""")
def comparable_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.col("y.item_id") == F.col("x.item_id") + 1).select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.round(rules.text_similarity(F.col("x.text"), F.col("y.text")), 6).alias("similarity"))


@query(f"""WITH {O.RANKED}, k AS (SELECT query_id, doc_id, d.text AS c, {O.tok('d.text')} AS w, {O.concepts('d.text')} AS cc, {O.concepts('b.text')} AS qc FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
f AS (SELECT query_id, list(word) AS fw FROM focus GROUP BY 1)
SELECT query_id, doc_id, round(round(greatest(0.35::DOUBLE, least(0.98::DOUBLE, least(len(w) / 260::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + len(list_intersect(w, fw)) / greatest(len(fw), 1)::DOUBLE * 0.25::DOUBLE
 + CASE WHEN len(qc) > 0 THEN len(list_intersect(cc, qc)) / len(qc)::DOUBLE ELSE 0.0::DOUBLE END * 0.20::DOUBLE + least(len({O.sentences('c')}) / 6::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE)), 12), 4) AS informative FROM k JOIN f USING (query_id)""")
def informative_score(spark, sf_dir):
    rows = _frontier_texts(spark, sf_dir)
    return rows.select("query_id", "doc_id", rules.informative(F.col("text"), F.col("query")).alias("informative"))


_TAG = "substring(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 48)"


def _impact_sql(weight: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(lower({_TAG}), {O.q(p)}) THEN {d[weight]} ELSE 0 END" for p, d in rules.TAG_RULES if weight in d)


_TAGGED = sorted({w for _, d in rules.TAG_RULES for w in d})


@query(f"SELECT conv_id, turn, {', '.join(f'coalesce(CAST({_impact_sql(w)} AS BIGINT), 0) AS {O.q(w)[1:-1]}' for w in _TAGGED)} FROM conversations")
def custom_tag_impact(spark, sf_dir):
    impact = rules.tag_impact(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(impact[w].cast("long"), F.lit(0)).alias(w) for w in _TAGGED])


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


@query(f"""SELECT page_id, CASE WHEN label <> '' THEN label ELSE bare END AS title, CASE WHEN regexp_matches(h, 'wikipedia\\.org') THEN 0.92 WHEN h LIKE '%.gov' THEN 0.88 WHEN h LIKE '%.edu' THEN 0.84 WHEN h LIKE '%.org' THEN 0.78 WHEN h LIKE '%.com' THEN 0.68 ELSE 0.63 END::DOUBLE AS authority
FROM (SELECT *, translate(string_split(bare, '.')[1], '-_', '  ') AS label FROM (SELECT page_id, h, regexp_replace(h, '^www\\.', '') AS bare FROM (SELECT page_id, coalesce({_HOST}, '') AS h FROM pages)))""")
def source_titles(spark, sf_dir):
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", rules.readable_title(host).alias("title"), rules.fallback_authority(host).alias("authority"))


@query(f"""WITH {O.RANKED}, k AS (SELECT query_id, doc_id, d.text AS c, [t for t in string_split_regex(lower(b.text), '[^a-z0-9]+') if length(t) >= 3] AS q FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, doc_id, round(round(greatest(0.48::DOUBLE, least(0.92::DOUBLE, CASE WHEN len(q) > 0 THEN len([t for t in q if contains(lower(c), t)]) / len(q)::DOUBLE ELSE 0.0::DOUBLE END * 0.55::DOUBLE + least(length(c) / 540::DOUBLE, 1.0::DOUBLE) * 0.45::DOUBLE)), 12), 4) AS informative FROM k""")
def fallback_informative(spark, sf_dir):
    rows = _frontier_texts(spark, sf_dir)
    return rows.select("query_id", "doc_id", rules.fallback_informative(F.col("text"), F.col("query")).alias("informative"))


@query(f"""SELECT query_id, array_to_string([x.w for x in list_sort(list({{'n': -length(w), 'w': w}}))[1:3]], ' ') AS anchors FROM
(SELECT DISTINCT item_id AS query_id, unnest({O.content(O.tok('text'))}) AS w FROM benchmark) WHERE NOT list_contains([{', '.join(O.q(w) for w in rules.FILLER)}], w) GROUP BY 1""")
def anchor_terms(spark, sf_dir):
    rows = frontier.topics(table(spark, sf_dir, "benchmark")).select("query_id", rules.anchors(F.col("words")).alias("a"))
    return rows.where(F.size("a") > 0).select("query_id", F.array_join("a", " ").alias("anchors"))


@query("""SELECT conv_id, turn, target, CASE WHEN target = 'related' THEN 0.24 WHEN target = 'seed' THEN 0.12 ELSE 0.12 END::DOUBLE AS bonus FROM
(SELECT conv_id, turn, CASE WHEN n <= 1 OR turn / greatest(n - 1, 1)::DOUBLE <= 0.25 THEN 'seed' WHEN turn / greatest(n - 1, 1)::DOUBLE <= 0.7 THEN 'related' ELSE 'tangential' END AS target
 FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id))""")
def depth_targets(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = turns.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id")
    target = rules.depth_target(F.col("turn"), F.col("n"))
    return rows.select("conv_id", "turn", target.alias("target"), rules.layer_bonus(F.lit("related"), target).alias("bonus"))


_PARTS = "[trim(s) for s in string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if trim(s) <> '']"


@query(f"SELECT doc_id, md5(CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], ' ') ELSE coalesce(text, '') END) AS lead_md5, md5(array_to_string(s[4:], ' ')) AS rest_md5 FROM (SELECT doc_id, text, {_PARTS} AS s FROM documents)")
def chapter_split(spark, sf_dir):
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would get the index as what to trim
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", parts.alias("s"))
    lead = F.when(F.size("s") > 0, F.array_join(F.slice("s", 1, 3), " ")).otherwise(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.md5(lead).alias("lead_md5"), F.md5(F.array_join(F.slice("s", F.lit(4), F.greatest(F.size("s"), F.lit(1))), " ")).alias("rest_md5"))


@query("""SELECT 'feedback-event-' || user_id || '-' || epoch_us(max(ts)) // 1000 AS event_id, user_id AS record_id, epoch_us(max(ts)) // 1000 AS captured_at, count(*) AS n_events FROM events GROUP BY user_id""")
def feedback_events_from_records(spark, sf_dir):
    at = F.unix_millis(F.max("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id")).agg(at.alias("captured_at"), F.count(F.lit(1)).alias("n_events"))
    return rows.select(F.concat_ws("-", F.lit("feedback-event"), "record_id", "captured_at").alias("event_id"), "record_id", "captured_at", "n_events")


@query(f"""WITH {O.RANKED}, sig AS (SELECT doc_id, list_distinct({O.content(O.tok('text'))}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ranked)),
p AS (SELECT a.query_id, CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE ELSE 0.0::DOUBLE END AS j
 FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank AND b.rank <= 10 JOIN sig x ON x.doc_id = a.doc_id JOIN sig y ON y.doc_id = b.doc_id)
SELECT query_id, round(1 - avg(j), 6) AS distinctness FROM p GROUP BY 1""")
def chapter_distinctness(spark, sf_dir):
    pairs = _frontier_pairs(_ranked_sources(spark, sf_dir).where(F.col("rank") <= 10))
    return pairs.groupBy("query_id").agg(F.round(1 - F.avg(sets.jaccard(F.col("x.words"), F.col("y.words"))), 6).alias("distinctness"))


@query(f"""SELECT item_id, array_to_string(w[n + 1:] || w[1:n], ' ') AS rotated, w[item_id % len(w) + 1] AS picked FROM (SELECT item_id, w, CAST(item_id % len(w) AS BIGINT) AS n FROM
(SELECT item_id, {O.content(O.tok('text'))} AS w FROM benchmark) WHERE len(w) > 0)""")
def rotated_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.without_stop_words(text.tokenize(F.col("text"))).alias("w")).where(F.size("w") > 0)
    n = F.pmod("item_id", F.size("w")).cast("int")
    return rows.select("item_id", F.array_join(rules.rotated(F.col("w"), n), " ").alias("rotated"), F.element_at("w", n + 1).alias("picked"))


# ---------------------------------------------------------------- definitions


@query()
def definition_candidates(spark, sf_dir):
    """Terms that a document defines, in order."""
    rows = _sources(spark, sf_dir).select("doc_id", F.posexplode(structure.definitions(F.col("title"), F.col("content"))).alias("place", "x"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "x.term", "x.description")


# ---------------------------------------------------------------- topics, clusters, archetypes


def _topic_texts(spark, sf_dir) -> DataFrame:
    """query_id, query of each topic."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def _ranked_texts(spark, sf_dir, most: int, ranked: DataFrame | None = None) -> DataFrame:
    """The best rows of each topic (of ranked, if it is there already) with title and content."""
    ranked = frontier.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")) if ranked is None else ranked
    ranked = ranked.where(F.col("rank") <= most)
    ids = small(stage(ranked.select("doc_id").distinct(), "ranked-ids"))
    return stage(_sources(spark, sf_dir).join(ids, "doc_id", "left_semi").join(ranked, "doc_id"), "ranked-texts")


@query()
def subtopic_candidates(spark, sf_dir):
    """The subtopics that each of the best six rows of a topic offers."""
    words = frontier.topics(table(spark, sf_dir, "benchmark"))
    rows = structure.subtopics(_ranked_texts(spark, sf_dir, 6).join(words, "query_id"))
    return rows.select("query_id", "doc_id", F.posexplode("subtopics").alias("place", "x")).select("query_id", "doc_id", F.col("place").cast("long").alias("place"), "x.title", "x.summary")


@query()
def semantic_coherence(spark, sf_dir):
    """How the best six texts of each topic hold together."""
    rows = _ranked_texts(spark, sf_dir, 6).select(F.col("query_id").alias("group"), F.col("rank").alias("pos"), F.col("content").alias("text"))
    return latent.coherence(_topic_texts(spark, sf_dir).withColumnRenamed("query_id", "group"), rows).withColumnRenamed("group", "query_id")


@query()
def subtopic_tree(spark, sf_dir):
    """The topics of the best twelve texts of each query."""
    rows = _ranked_texts(spark, sf_dir, 12).select(F.col("query_id").alias("group"), F.col("rank").alias("pos"), F.col("content").alias("text"))
    return latent.subtopics(_topic_texts(spark, sf_dir).withColumnRenamed("query_id", "group"), rows).withColumnRenamed("group", "query_id")


def _chosen(spark, sf_dir) -> DataFrame:
    """The sources that the search chooses for each topic, with their texts, definitions and subtopics."""
    rows = _structured_sources(spark, sf_dir)
    picks = stage(selection.evolve(rows, rewards=_rewards(spark, sf_dir)), "picks")
    return stage(rows.join(picks.select("query_id", "doc_id", "place"), ["query_id", "doc_id"]), "chosen")


@query()
def source_clusters(spark, sf_dir):
    rows = clusters.leader_clusters(_chosen(spark, sf_dir))
    return rows.select("query_id", "cluster", "place", "label", F.size("terms").cast("long").alias("n_terms"), "places", "relevance")


_NO_SUPPORT = "support AS (SELECT 0::BIGINT AS query_id, 0 AS organization, 0 AS market, 0 AS technology, 0 AS place, 0 AS person WHERE false)"
_LEAD = f"lower({O.norm(f'coalesce(title, {chr(39)*2}) || {chr(39)} {chr(39)} || substring(coalesce(content, {chr(39)*2}), 1, {archetypes.LEAD})')})"


def _steps(n: str) -> str:
    return f"CASE WHEN {n} >= 4 THEN 3 WHEN {n} >= 2 THEN 2 WHEN {n} = 1 THEN 1 ELSE 0 END"


def _held(words: str, of: list[str]) -> str:
    return f"len([w for w in {words} if list_contains([{', '.join(O.q(x) for x in of)}], w)])"


_SUPPORT = f"""best AS (SELECT query_id, {_LEAD} AS text FROM ranked JOIN src USING (doc_id) WHERE rank <= {archetypes.BEST_ROWS}),
hits AS (SELECT query_id, {', '.join('(' + ' + '.join(f'contains(text, {O.q(t)})::INT' for t in terms) + f') AS {k}' for k, terms in archetypes.TOLD.items())}, {' OR '.join(f'contains(text, {O.q(t)})' for t in archetypes.OFFICES)} AS office FROM best),
support AS (SELECT query_id, {', '.join(f'sum({_steps(k)}) AS {k}' for k in archetypes.TOLD if k != 'person')}, sum(least({_steps('person')}, 2) + CASE WHEN office THEN 2 ELSE 0 END) AS person FROM hits GROUP BY 1)"""
_JUDGED = f"""words AS (SELECT item_id AS query_id, regexp_extract_all({O.norm('text')}, '[A-Za-z][A-Za-z''.-]{{1,}}') AS raw FROM benchmark),
q AS (SELECT query_id, raw, [lower(w) for w in raw] AS low, [lower(w) for w in raw if not list_contains({O.STOP}, lower(w))] AS kept, len([w for w in raw if regexp_matches(w, '^[A-Z]')]) AS titled FROM words),
n AS (SELECT *, titled / greatest(len(raw), 1)::DOUBLE AS ratio, {', '.join(f'{_held("kept", w)} AS n_{k}' for k, w in archetypes.ASKED.items())}, {_held('low', archetypes.COMPARING)} > 0 AS compares, coalesce(list_contains([{', '.join(O.q(x) for x in archetypes.MOUNTS)}], low[1]), false) AS mount,
  coalesce(organization, 0) AS s_o, coalesce(market, 0) AS s_m, coalesce(technology, 0) AS s_t, coalesce(place, 0) AS s_p, coalesce(person, 0) AS s_x FROM q LEFT JOIN support USING (query_id))"""
_ARCHETYPE = f"""SELECT query_id, CASE WHEN list_has_all(low, ['iran', 'war']) THEN 'impact' WHEN list_has_all(low, ['thomas', 'cup']) THEN 'generic'
 WHEN (compares AND (n_organization >= 1 OR s_o >= 1)) OR {_held('kept', archetypes.ORGANIZATIONS)} > 0 OR n_organization >= 2 THEN 'organization' WHEN (n_organization >= 1 AND titled > 0) OR s_o >= 3 THEN 'organization'
 WHEN n_market >= 2 OR s_m >= 3 THEN 'market' WHEN n_technology >= 2 OR s_t >= 3 THEN 'technology'
 WHEN mount OR n_place >= 2 OR {_held('kept', archetypes.PLACES)} > 0 OR s_p >= 2 THEN 'place' WHEN compares AND ratio >= 0.4 THEN 'generic' WHEN s_x >= 2 THEN 'person'
 WHEN len(raw) BETWEEN 2 AND 4 AND ratio >= 0.85 AND NOT compares AND {_held('low', [*archetypes.QUESTIONS, *archetypes.ORGANIZATIONS, *archetypes.PLACES, *archetypes.ASKED['place']])} = 0 AND NOT mount THEN 'person' ELSE 'generic' END AS archetype FROM n"""


@query(f"WITH {O.RANKED}, {_SUPPORT}, {_JUDGED} {_ARCHETYPE}")
def archetype_cascade(spark, sf_dir):
    return archetypes.infer(_topic_texts(spark, sf_dir), _ranked_texts(spark, sf_dir, archetypes.BEST_ROWS))


@query()
def canonical_labels(spark, sf_dir):
    return archetypes.canonical_labels(_topic_texts(spark, sf_dir), _ranked_texts(spark, sf_dir, archetypes.LABEL_ROWS))


@query()
def book_assembly(spark, sf_dir):
    """Ten chapters for each topic, from the sources that the search chose."""
    return book.assemble(_topic_texts(spark, sf_dir), _chosen(spark, sf_dir))


# ---------------------------------------------------------------- learning from feedback


@query(f"WITH {O.MERGED} SELECT record_id, signal, issue_tag, custom_tag, coalesce(n_chapters, 0) AS n_chapters, updated_at FROM book LEFT JOIN (SELECT record_id, count(*) AS n_chapters FROM entry GROUP BY 1) USING (record_id)")
def feedback_merged_records(spark, sf_dir):
    rows = learning.merged(learning.patches(table(spark, sf_dir, "events")))
    return rows.select("record_id", "signal", "issue_tag", "custom_tag", F.size("chapters").cast("long").alias("n_chapters"), "updated_at")


def _profile(rows: DataFrame) -> DataFrame:
    return rows.select("sample_size", "positive_signals", "negative_signals", F.array_join("dominant_issues", ",").alias("dominant_issues"), F.array_join("dominant_tags", ",").alias("dominant_tags"), *feedback.WEIGHTS, "updated_at")


@query(O.LEARNED)
def feedback_learned_profile(spark, sf_dir):
    return _profile(learning.profile(learning.merged(learning.patches(table(spark, sf_dir, "events")))))


@query(O.LEARNED)
def feedback_stream_profile(spark, sf_dir):
    """The same from the event log as a stream with keyed state."""
    path = shared_dir(spark, "feedback-stream")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream.learn(events, path, f"{path}/checkpoint").awaitTermination()
    return _profile(stream.last_profile(spark, path))


@query(f"WITH {O.PATCHES}, {O.CHANGES} SELECT record_id, event_id FROM changed")
def feedback_appended_events(spark, sf_dir):
    return learning.appended(learning.patches(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- when results fall short


_SIMPLER = f"""w AS (SELECT item_id AS query_id, {O.norm('text')} AS query, list_distinct([]::VARCHAR[]) AS none, [x for x in {O.content(O.tok('text'))} if not list_contains([{', '.join(O.q(x) for x in fallback.FILLER)}], x)] AS all_words FROM benchmark),
o AS (SELECT query_id, query, [x for x, i in all_words if list_position(all_words, x) = i] AS once FROM w),
s AS (SELECT query_id, query, array_to_string(list_concat([x for x in once if length(x) >= {fallback.LONG}], [x for x in once if length(x) < {fallback.LONG}])[1:{fallback.MOST_WORDS}], ' ') AS plain FROM o)"""


@query(f"""WITH {_NO_SUPPORT}, {_JUDGED}, kind AS ({_ARCHETYPE}), {_SIMPLER},
t AS (SELECT query_id, query, CASE WHEN archetype = 'person' THEN query || ' {fallback.PERSON_WORDS}' WHEN plain <> '' THEN plain ELSE query END AS simpler FROM s JOIN kind USING (query_id))
SELECT query_id, simpler, CASE WHEN query = '' THEN '' WHEN simpler <> '' AND simpler <> query THEN simpler WHEN len([x for x in string_split(query, ' ') if x <> '']) <= {fallback.SHORT_QUERY} THEN query || ' {fallback.DEPTH_WORDS}' ELSE query END AS deeper FROM t""")
def second_queries(spark, sf_dir):
    return fallback.second_queries(_topic_texts(spark, sf_dir))


@query(f"""WITH {O.RANKED}, n_all AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1),
hit AS (SELECT query_id, len(list_intersect(cw, fw)) >= greatest(1, floor(len(fw) * 0.2)) AND (len(fw) <= 3 OR len(list_intersect(cw, [x.w for x in list_sort([{{'n': -length(w), 'w': w}} for w in qw])[1:3]])) > 0) AS fits
 FROM ranked JOIN docs USING (doc_id) JOIN fset USING (query_id) JOIN asked USING (query_id) WHERE rank <= {fallback.LOOKED_AT}),
f AS (SELECT query_id, count(*) FILTER (fits) AS n_fitting FROM hit GROUP BY 1)
SELECT a.query_id, coalesce(n_fitting, 0) AS n_fitting, len(qw) > 0 AND coalesce(n_fitting, 0) < least(coalesce(n, 0), {fallback.ENOUGH}) AS misses FROM asked a LEFT JOIN n_all USING (query_id) LEFT JOIN f USING (query_id)""")
def focus_misses(spark, sf_dir):
    return fallback.missed(_topic_texts(spark, sf_dir), _ranked_texts(spark, sf_dir, frontier.FRONTIER))


@query()
def synthetic_sources(spark, sf_dir):
    """The synthetic sources that the gate asks for."""
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    ranked = frontier.rank(bench, docs)  # once, for the gate and for the texts
    wanted = frontier.gate(frontier.quality(bench, docs, ranked)).where("use_fallback").select("query_id", "desired_count")
    return fallback.synthetic(_topic_texts(spark, sf_dir), _ranked_texts(spark, sf_dir, 8, ranked), wanted)


# ---------------------------------------------------------------- quality over all topics


@query()
def benchmark_metrics(spark, sf_dir):
    """Sources and book of each topic, measured; its archetype is its pack."""
    topics, chosen = _topic_texts(spark, sf_dir), _chosen(spark, sf_dir)
    measured = quality.measures(chosen, book.assemble(topics, chosen))
    return measured.join(archetypes.infer(topics, chosen.withColumn("rank", F.col("place").cast("int"))), "query_id")


@query()
def benchmark_distribution(spark, sf_dir):
    return quality.suite(stage(benchmark_metrics(spark, sf_dir), "measured"), "archetype")
