"""DuckDB SQL that gives the rows of the catalogue's queries.

DuckDB's patterns have no look-behind, so sentences are cut by marking their ends first.
"""

from __future__ import annotations

from ..functions import lexicon, rules
from ..functions import text as T
from ..functions import web
from ..operators import feedback, frontier, learning

q = lambda s: "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    x = f"coalesce({x}, '')"
    x = f"translate({x}, {q(''.join(T.ONE_TO_ONE) + T.DROPPED)}, {q(''.join(T.ONE_TO_ONE.values()))})"
    return f"trim(regexp_replace(replace({x}, '…', '...'), '\\s+', ' ', 'g'))"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({norm(x)}), {q(T.TOKEN)})"


STOP = "[" + ", ".join(q(w) for w in T.STOP_WORDS) + "]"


def content(tokens: str) -> str:
    return f"[w for w in {tokens} if not list_contains({STOP}, w)]"


def sentences(x: str) -> str:
    return f"[s for s in string_split_regex(regexp_replace({norm(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if trim(s) <> '']"


def usable(x: str) -> str:
    return f"[s for s in {sentences(x)} if length(trim(s)) > 20 and not regexp_matches(s, {q('(?i)' + chr(92) + 'b(' + T.SCAFFOLD + ')')})]"


def ratio(tokens: str) -> str:
    return f"CASE WHEN len({tokens}) > 0 THEN len(list_distinct({tokens})) / len({tokens})::DOUBLE ELSE 0.0::DOUBLE END"


def variants(w: str) -> str:
    cut = lambda k, add="": f"substring({w}, 1, length({w}) - {k}) || {q(add)}"
    rules = [("ies", 4, cut(3, "y")), ("es", 4, cut(2)), ("s", 3, cut(1)), ("y", 3, cut(1, "ies")), ("ian", 5, cut(3, "ia")), ("ia", 4, cut(2, "ian")), ("ing", 5, cut(3)), ("ing", 5, cut(3, "e")), ("ed", 4, cut(2))]
    return "[" + w + ", " + ", ".join(f"CASE WHEN {w} LIKE '%{end}' AND length({w}) > {n}{' AND ' + w + chr(32) + 'NOT LIKE ' + q('%ss') if end == 's' else ''} THEN {v} END" for end, n, v in rules) + "]"


#: First distinct content words of a text in order of appearance.
TOPICS = f"""
t_words AS (SELECT item_id AS query_id, unnest({content(tok('text'))}) AS w, generate_subscripts({content(tok('text'))}, 1) AS i FROM benchmark),
t_first AS (SELECT query_id, w, min(i) AS i FROM t_words GROUP BY 1, 2),
t_top AS (SELECT query_id, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM t_first)),
focus AS (SELECT DISTINCT query_id, v AS word FROM (SELECT query_id, unnest({variants('w')}) AS v FROM t_top) WHERE v IS NOT NULL AND length(v) >= 2),
n_focus AS (SELECT query_id, count(*) AS n_focus FROM focus GROUP BY 1)"""
SOURCES = "src AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS title, text AS content, source AS provider FROM documents)"
DEPTH = f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(len({tok('content')}) / 280::DOUBLE, 1.0::DOUBLE) * 0.58::DOUBLE + least(len({sentences('content')}) / 7::DOUBLE, 1.0::DOUBLE) * 0.22::DOUBLE)), 6)"
_NSPAM = norm("concat_ws(' ', title, content)")
_RUNS = "|".join(f"{c}{{8,}}" for c in [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "\\.", "-", "_", "=", "\\*", "#", "\\$", "%", "&", "!", "\\?", "\\|", "~", "\\+", "/", "<", ">", "é", "è", "ê", "ç", "ä", "ö", "ü", "ß", "ñ", "á", "í", "ó", "ú"])


def spam(source: str) -> str:
    return f"""SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  CASE WHEN regexp_matches(e, {q(_RUNS)}) THEN 0.24::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(e, '\\d{{10,}}') THEN 0.16::DOUBLE ELSE 0 END
  + least(len([w for w in regexp_extract_all(e, '\\b[A-Za-z0-9]{{10,}}\\b') if regexp_matches(w, '^[A-Za-z]*\\d') and regexp_matches(w, '^\\d*[A-Za-z]')]) * 0.12::DOUBLE, 0.24::DOUBLE)
  + CASE WHEN regexp_matches(title, {q(frontier.LISTICLE)}) THEN 0.12::DOUBLE ELSE 0 END
  + least(({' + '.join(f"CASE WHEN contains(lower(e), {q(t)}) THEN 1 ELSE 0 END" for t in frontier.SPAM_TERMS)}) * 0.10::DOUBLE, 0.25::DOUBLE)
  + CASE WHEN len(a) >= 20 AND u < 0.60 THEN least((0.60::DOUBLE - u) * 0.85::DOUBLE, 0.28::DOUBLE) ELSE 0 END
  + CASE WHEN len({tok('content')}) < 40 OR len({sentences('content')}) < 2 THEN 0.08::DOUBLE ELSE 0 END)), 6) AS spam_risk
FROM (SELECT *, {tok('e')} AS a, {ratio(tok('e'))} AS u FROM (SELECT *, {_NSPAM} AS e FROM {source}))"""


SPAM = spam("src")
DEFINITIONAL = f"""round(least(1.0::DOUBLE, len(regexp_extract_all(title || '. ' || substring(content, 1, 700), {q(frontier.DEFINING)})) * 0.11::DOUBLE
 + CASE WHEN regexp_matches(title, {q(frontier.DEFINING)}) THEN 0.12::DOUBLE ELSE 0 END), 6)"""


def grams(x: str) -> str:
    return f"list_distinct([substring({x}, i, 4) for i in range(1, greatest(length({x}) - 3, 0) + 1)])"


def concepts(x: str) -> str:
    no_start = f"regexp_replace(coalesce({x}, ''), '([.!?]\\s)[A-Z]', '\\1', 'g')"
    return f"list_distinct(list_concat(regexp_extract_all({no_start}, '\\b[A-Z][a-z]{{2,}}\\b'), [w for w in {content(tok(x))} if length(w) > 8]))"


def _soft(term: str, words: str) -> str:
    return f"(list_contains({words}, {term}) OR (length({term}) >= 6 AND len([x for x in {words} if length(x) >= 5 AND substring(x, 1, 5) = substring({term}, 1, 5)]) > 0))"


def _share(words: str) -> str:
    return f"len([y for y in a[2:] if {_soft('y', words)}]) / (len(a) - 1)::DOUBLE"


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y})))::DOUBLE END"


_FILLER = "[" + ", ".join(q(w) for w in rules.FILLER) + "]"
_IGNORED = "[" + ", ".join(q(w) for w in frontier.IGNORED) + "]"
_INFORMATIVE = f"""round(round(greatest(0.35::DOUBLE, least(0.98::DOUBLE, least(len(ct) / 260::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + len(list_intersect(ct, fw)) / greatest(len(fw), 1)::DOUBLE * 0.25::DOUBLE
 + CASE WHEN len(qc) > 0 THEN len(list_intersect(cc, qc)) / len(qc)::DOUBLE ELSE 0.0::DOUBLE END * 0.20::DOUBLE + least(len({sentences('content')}) / 6::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE)), 12), 4)"""
_PAIRS = sorted({(a, b) for a, bs in [*lexicon.RELATIONS.items(), *lexicon.ALIASES.items()] for b in bs})
EDGES = f"half(a, b) AS (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in _PAIRS)}), edge AS (SELECT a, b FROM half UNION SELECT b, a FROM half)"
_NAMES = [(n, n) for n in lexicon.ALIASES] + [(a, n) for n, names in lexicon.ALIASES.items() for a in names]


def words_of(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {q(T.TOKEN)}))"


def flat(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\\\s+', ' ', 'g')))"


#: g_seed: the concepts that asked(query_id, qs, qw) name.
SEEDS = f"""{EDGES}, names(alias, node) AS (VALUES {', '.join(f'({q(a)}, {q(n)})' for a, n in _NAMES)}),
g_first AS (SELECT DISTINCT query_id, node FROM asked JOIN (SELECT *, {words_of('alias')} AS aw FROM names) ON contains(qs, alias) OR len(list_intersect(aw, qw)) / len(aw)::DOUBLE >= 0.8),
g_seed AS (SELECT * FROM g_first UNION ALL SELECT query_id, node FROM asked JOIN (SELECT DISTINCT a AS node, {words_of('a')} AS nw FROM edge) ON len(nw) > 0 AND len(list_intersect(nw, qw)) >= least(len(nw), 2) WHERE query_id NOT IN (SELECT query_id FROM g_first))"""
#: gw: the words of concepts within one step of those that a query names.
GRAPH = f"""{SEEDS},
g_ball AS (SELECT query_id, node, min(d) AS d FROM (SELECT query_id, node, 0 AS d FROM g_seed UNION ALL SELECT query_id, b, 1 FROM g_seed JOIN edge ON node = a) GROUP BY 1, 2),
g_near AS (SELECT query_id, unnest(regexp_extract_all(node, {q(T.TOKEN)})) AS w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, length(node), node) AS n FROM g_ball) WHERE n <= 24),
gset AS (SELECT query_id, list(DISTINCT w) AS gw FROM g_near WHERE length(w) >= 3 AND NOT list_contains({STOP}, w) GROUP BY 1)"""


def like(x: str, words: str, n_grams: str, both: str) -> str:
    """The likeness of the query to the text x with its words, number of n-grams and those in common."""
    grams = f"CASE WHEN {n_grams} = 0 OR n_qg = 0 THEN 0.0::DOUBLE ELSE {both} / ({n_grams} + n_qg - {both})::DOUBLE END"
    return f"round(CASE WHEN {x} = '' OR qs = '' THEN 0.0::DOUBLE WHEN {x} = qs THEN 1.0::DOUBLE WHEN len({words}) = 0 OR len(qw) = 0 THEN 0.0::DOUBLE ELSE ({_jaccard(words, 'qw')}) * 0.55::DOUBLE + ({grams}) * 0.45::DOUBLE END, 6)"


_GRAM_TABLES = ",\n".join(
    f"{p}g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([substring({x}, i, 4) for i in range(1, greatest(length({x}) - 3, 0) + 1)]) AS g FROM told), {p}n AS (SELECT doc_id, count(*) AS {p}_n FROM {p}g GROUP BY 1), {p}b AS (SELECT query_id, doc_id, count(*) AS {p}_b FROM {p}g JOIN qg USING (g) GROUP BY 1, 2)"
    for p, x in (("t", "tn"), ("c", "cn"), ("e", "every")))
RANKED = f"""{TOPICS}, {SOURCES},
c_words AS (SELECT DISTINCT doc_id, unnest({tok('content')}) AS word FROM src),
h_words AS (SELECT DISTINCT doc_id, unnest({tok('title')}) AS word FROM src),
c_hits AS (SELECT query_id, doc_id, count(*) AS content_hits FROM c_words JOIN focus USING (word) GROUP BY 1, 2),
h_hits AS (SELECT query_id, doc_id, count(*) AS title_hits FROM h_words JOIN focus USING (word) GROUP BY 1, 2),
pairs AS (SELECT query_id, doc_id, coalesce(title_hits, 0) / n_focus::DOUBLE AS t, coalesce(content_hits, 0) / n_focus::DOUBLE AS c
          FROM c_hits FULL JOIN h_hits USING (query_id, doc_id) JOIN n_focus USING (query_id)),
asked AS MATERIALIZED (SELECT query_id, qw, array_to_string(qw, ' ') AS qs, qc, [x.w for x in list_sort([{{'n': -length(w), 'w': w}} for w in qw if not list_contains({_FILLER}, w)])[1:3]] AS a, [w for w in qw if not list_contains({_IGNORED}, w)] AS k
          FROM (SELECT item_id AS query_id, list_sort(list_distinct({content(tok('text'))})) AS qw, {concepts('text')} AS qc FROM benchmark)),
phrases AS (SELECT query_id, [p for p in list_concat([array_to_string(k[i:i + 2], ' ') for i in range(1, greatest(len(k) - 2, 0) + 1)], [array_to_string(k[i:i + 1], ' ') for i in range(1, greatest(len(k) - 1, 0) + 1)]) if not regexp_matches(p, '^[0-9 ]+$')][1:6] AS p FROM asked),
fset AS (SELECT query_id, list(word) AS fw FROM focus GROUP BY 1),
{GRAPH},
told AS MATERIALIZED (SELECT doc_id, content, list_distinct({tok('title')}) AS tw, {tok('content')} AS ct, {DEFINITIONAL} AS definitional, {DEPTH} AS depth, {concepts('content')} AS cc, lower(trim(regexp_replace(concat_ws(' ', title, content), '\\s+', ' ', 'g'))) AS every,
   lower({norm('title')}) AS tn, lower({norm('content')}) AS cn, round(0.48::DOUBLE + CASE WHEN len({usable('content')}) >= 4 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len({tok('title')}) >= 2 THEN 0.03::DOUBLE ELSE 0 END, 4) AS authority FROM src WHERE content IS NOT NULL),
spam AS ({spam('src')}),
qg AS MATERIALIZED (SELECT DISTINCT query_id, unnest([substring(qs, i, 4) for i in range(1, greatest(length(qs) - 3, 0) + 1)]) AS g FROM asked), qn AS (SELECT query_id, count(*) AS n_qg FROM qg GROUP BY 1),
{_GRAM_TABLES},
tc AS (SELECT doc_id, count(*) AS both_n FROM tg JOIN cg USING (doc_id, g) GROUP BY 1),
docs AS MATERIALIZED (SELECT d.*, list_distinct(ct) AS cw, {words_of('every')} AS ew, spam_risk, coalesce(t_n, 0) AS t_n, coalesce(c_n, 0) AS c_n, coalesce(e_n, 0) AS e_n,
   round(CASE WHEN tn = '' OR cn = '' THEN 0.0::DOUBLE WHEN tn = cn THEN 1.0::DOUBLE WHEN len(tw) = 0 OR len(ct) = 0 THEN 0.0::DOUBLE ELSE ({_jaccard('tw', 'list_distinct(ct)')}) * 0.55::DOUBLE
     + CASE WHEN coalesce(t_n, 0) = 0 OR coalesce(c_n, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(both_n, 0) / (t_n + c_n - coalesce(both_n, 0))::DOUBLE END * 0.45::DOUBLE END, 6) AS two
   FROM told d JOIN spam USING (doc_id) LEFT JOIN tn USING (doc_id) LEFT JOIN cn USING (doc_id) LEFT JOIN en USING (doc_id) LEFT JOIN tc USING (doc_id)),
joined AS MATERIALIZED (SELECT f.query_id, f.doc_id, t, c, tw, cw, definitional, depth, authority, spam_risk, qw, a, two, tn, cn, {_INFORMATIVE} AS informative, coalesce(gw, []) AS gw,
   {like('every', 'ew', 'e_n', 'coalesce(e_b, 0)')} AS alike, {like('tn', 'tw', 't_n', 'coalesce(t_b, 0)')} AS q_title, {like('cn', 'cw', 'c_n', 'coalesce(c_b, 0)')} AS q_content,
   len([x for x in p if contains(d.every, x)]) AS hits
   FROM pairs f JOIN docs d USING (doc_id) JOIN asked USING (query_id) JOIN phrases USING (query_id) JOIN fset USING (query_id) LEFT JOIN qn USING (query_id) LEFT JOIN gset USING (query_id)
   LEFT JOIN tb USING (query_id, doc_id) LEFT JOIN cb USING (query_id, doc_id) LEFT JOIN eb USING (query_id, doc_id)),
rel AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, o + CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE
     CASE WHEN {_soft('a[1]', 'tw')} THEN 0.42::DOUBLE WHEN {_soft('a[1]', 'cw')} THEN 0.28::DOUBLE WHEN len(qw) > 3 AND o > 0 AND alike < 0.28 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END
     + CASE WHEN len(a) > 1 THEN {_share('tw')} * 0.18::DOUBLE + {_share('cw')} * 0.10::DOUBLE ELSE 0.0::DOUBLE END END
   + alike * 0.18::DOUBLE + (least(hits * 0.16::DOUBLE, 0.32::DOUBLE) + CASE WHEN hits > 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END) * 0.34::DOUBLE)), 12) AS r
   FROM (SELECT *, t * 0.46::DOUBLE + c * 0.30::DOUBLE + (len(list_intersect(tw, gw)) * 0.55::DOUBLE + len(list_intersect(cw, gw)) * 0.45::DOUBLE) / greatest(len(gw), 1)::DOUBLE * 0.24::DOUBLE AS o,
     round(round(least(1.0::DOUBLE, CASE WHEN tn <> '' AND cn <> '' THEN (q_title + q_content) / 2 WHEN tn <> '' THEN q_title WHEN cn <> '' THEN q_content ELSE 0.0::DOUBLE END * 0.45::DOUBLE + two * 0.40::DOUBLE), 12), 6) AS aligned FROM joined)),
whole AS (SELECT *, round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN len(tw) > 0 AND len(cw) > 0 THEN len(tw) / len(cw)::DOUBLE WHEN len(tw) > 0 OR len(cw) > 0 THEN 0.48::DOUBLE ELSE 0.0::DOUBLE END * 0.32::DOUBLE
   + (t + c) / 4 * 0.20::DOUBLE + r * 0.18::DOUBLE + aligned * 0.30::DOUBLE)), 12), 6) AS coherence FROM rel),
scored AS (SELECT *, round(round(greatest(r * 0.27::DOUBLE + t * 0.16::DOUBLE + c * 0.08::DOUBLE + definitional * 0.16::DOUBLE + authority * 0.13::DOUBLE + informative * 0.06::DOUBLE + depth * 0.12::DOUBLE + coherence * 0.10::DOUBLE - spam_risk * 0.18::DOUBLE, 0.0::DOUBLE), 12), 6) AS score FROM whole),
ranked AS MATERIALIZED (SELECT query_id, doc_id, round(r, 6) AS relevance, score, authority, informative, spam_risk AS spam, coherence, rank FROM
           (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {frontier.FRONTIER})"""
#: A mean over whole millionths, rounded half up: no order of summation shows.
_mean = lambda x: f"(2 * CAST(sum(CAST(round({x} * 1000000) AS BIGINT)) FILTER (rank <= 6) AS BIGINT) + count(*) FILTER (rank <= 6)) // (2 * count(*) FILTER (rank <= 6)) / 1000000::DOUBLE"
QUALITY = f"""{RANKED},
top AS (SELECT * FROM ranked WHERE rank <= {frontier.QUALITY_ROWS}),
hits AS (SELECT query_id, count(DISTINCT word) AS covered FROM top JOIN c_words USING (doc_id) JOIN focus USING (query_id, word) GROUP BY 1),
means AS (SELECT query_id, count(*) AS real_count, {_mean('score')} AS s, {_mean('relevance')} AS r FROM ranked GROUP BY 1),
quality AS (SELECT b.item_id AS query_id, coalesce(real_count, 0) AS real_count, coalesce(s, 0.0::DOUBLE) AS avg_frontier_score, coalesce(r, 0.0::DOUBLE) AS avg_relevance,
   round(CASE WHEN n_focus IS NULL THEN CASE WHEN real_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE coalesce(covered, 0) / n_focus::DOUBLE END, 6) AS coverage_ratio
   FROM benchmark b LEFT JOIN n_focus n ON b.item_id = n.query_id LEFT JOIN means m ON b.item_id = m.query_id LEFT JOIN hits h ON b.item_id = h.query_id)"""
GATE = """SELECT *, CAST(CASE WHEN use_fallback THEN least(10, greatest(0, 8 - real_count, CASE WHEN severe OR shallow OR weak THEN 6 ELSE 0 END, CASE WHEN s < 0.35 OR c < 0.25 THEN 8 ELSE 0 END)) ELSE 0 END AS BIGINT) AS desired_count FROM (
 SELECT *, NOT (real_count >= 6 AND s >= 0.40 AND r >= 0.72 AND c >= 0.55) AND (severe OR shallow OR weak OR r < 0.36 OR (real_count < 6 AND (s < 0.54 OR c < 0.50 OR r < 0.52))) AS use_fallback FROM (
  SELECT *, real_count < 3 AS severe, s < 0.40 AND (r < 0.68 OR c < 0.48) AS shallow, c < 0.35 AS weak FROM (
   SELECT *, avg_frontier_score AS s, avg_relevance AS r, coverage_ratio AS c FROM quality)))"""

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_INTERNAL = "(" + " OR ".join(f"h = '{s}' OR h LIKE '%.{s}'" for s in web.SEARCH_HOSTS) + ")"


def unescape(x: str) -> str:
    for entity, plain in web.ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(plain)})"
    return x


TITLE = norm(f"regexp_replace({unescape(chr(40) + 'regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1))')}, '<[^>]*>', '', 'g')")
_CLEAN = "coalesce(html, '')"
for _tag in ("script", "style", "noscript", "svg"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
READABLE = norm(unescape(unescape(f"regexp_replace(regexp_replace({_CLEAN}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', '', 'g')")))

_TAGS = "[" + ", ".join(q(t) for t in feedback.TAG_DELTAS) + "]"
RECORDS = f"""
ev AS (SELECT user_id AS record_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' END AS signal,
  CASE WHEN event_type IN ('click', 'view') THEN {_TAGS}[CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(feedback.TAG_DELTAS)} + 1] END AS tag FROM events),
recs AS (SELECT record_id, arg_max(signal, (ts, event_id)) FILTER (signal IS NOT NULL) AS signal, max(ts) AS updated_at FROM ev GROUP BY 1),
tags AS (SELECT DISTINCT record_id, tag FROM ev WHERE tag IS NOT NULL)"""
_DELTAS = ", ".join(f"({q(k)}, {q(w)}, {round(d * 100)})" for k, ds in [*feedback.TAG_DELTAS.items(), ("+", feedback.POSITIVE_DELTAS), ("-", feedback.NEGATIVE_DELTAS)] for w, d in ds.items())
PROFILE = f"""WITH {RECORDS},
marks AS (SELECT tag FROM tags UNION ALL SELECT '+' FROM recs WHERE signal = 'positive' UNION ALL SELECT '-' FROM recs WHERE signal = 'negative'),
deltas(tag, weight, d) AS (VALUES {_DELTAS}),
sums AS (SELECT weight, sum(d) AS h FROM marks JOIN deltas USING (tag) GROUP BY 1)
SELECT w.weight, round(greatest({feedback.LOW}::DOUBLE, least({feedback.HIGH}::DOUBLE, 1 + coalesce(h, 0) / 100::DOUBLE)), 3) AS value
FROM (VALUES {', '.join(f"({q(w)})" for w in feedback.WEIGHTS)}) w(weight) LEFT JOIN sums USING (weight)"""
DOMINANT = f"""WITH {RECORDS}, n AS (SELECT tag, count(*) AS n FROM tags GROUP BY 1)
SELECT * FROM (SELECT tag, n, CAST(row_number() OVER (ORDER BY n DESC, tag IN ({', '.join(q(t) for t in feedback.POSITIVE_TAGS)}), tag) AS INT) AS place FROM n) WHERE place <= 3"""


def _has(term: str) -> str:
    return f"contains(t, {q(term)})" if " " in term else f"list_contains(w, {q(term)})"


def _align(name: str) -> str:
    p = lexicon.PROFILES[name]
    count = lambda terms: "(" + " + ".join([f"CASE WHEN {_has(x)} THEN 1 ELSE 0 END" for x in terms] or ["0"]) + ")"
    met = "(" + " + ".join(f"CASE WHEN {' OR '.join(_has(x) for x in g)} THEN 1 ELSE 0 END" for g in p["groups"]) + ")"
    score = f"least({count(p['positive'])} * 0.08::DOUBLE, 0.32::DOUBLE) + {met} * 0.28::DOUBLE - least({count(p['negative'])} * 0.22::DOUBLE, 0.66::DOUBLE) - ({len(p['groups'])} - {met}) * 0.26::DOUBLE - CASE WHEN {met} = 0 THEN 0.24::DOUBLE ELSE 0 END"
    return f"SELECT doc_id, {q(name)} AS profile, CASE WHEN t = '' THEN -1.0::DOUBLE ELSE round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {score})), 6) END AS score FROM d"


ALIGNMENT = (
    f"WITH d AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t, regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), {q(T.TOKEN)}) AS w FROM documents) "
    + " UNION ALL ".join(_align(n) for n in lexicon.PROFILES))


# ---------------------------------------------------------------- learning from feedback

_list = lambda items: "[" + ", ".join(q(x) for x in items) + "]"
PATCHES = f"""
raw AS (SELECT user_id AS record_id, ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
patch AS (SELECT record_id, ts, event_id, CASE WHEN k >= {learning.BOOK_BELOW} THEN k % {learning.CHAPTERS} END AS chapter, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' END AS signal,
  CASE WHEN event_type = 'click' THEN {_list(feedback.TAG_DELTAS)}[k % {len(feedback.TAG_DELTAS)} + 1] END AS issue_tag, CASE WHEN event_type = 'view' THEN {_list(learning.FREE_TAGS)}[k % {len(learning.FREE_TAGS)} + 1] END AS custom_tag FROM raw)"""
_last = lambda c: f"arg_max({c}, (ts, event_id)) FILTER (chapter IS NULL AND {c} IS NOT NULL) AS {c}"
MERGED = f"""{PATCHES},
book AS (SELECT record_id, {', '.join(_last(c) for c in learning.FIELDS)}, max(ts) AS updated_at FROM patch GROUP BY 1),
entry AS (SELECT record_id, chapter, signal, issue_tag, custom_tag FROM (SELECT *, row_number() OVER (PARTITION BY record_id, chapter ORDER BY ts DESC, event_id DESC) AS n FROM patch WHERE chapter IS NOT NULL) WHERE n = 1)"""
_clean = lambda c: f"substring(regexp_replace(trim({c}), '\\s+', ' ', 'g'), 1, 48)"
_thousandths = lambda table: ", ".join(f"({q(k)}, {q(w)}, {round(1000 * d)})" for k, ds in table for w, d in ds.items())
_SIGNAL_DELTAS = [("+", feedback.POSITIVE_DELTAS), ("-", feedback.NEGATIVE_DELTAS), ("c+", learning.CHAPTER_POSITIVE), ("c-", learning.CHAPTER_NEGATIVE)]
LEARNED = f"""WITH {MERGED},
said AS (SELECT record_id, NULL AS chapter, signal, issue_tag, custom_tag FROM book UNION ALL SELECT record_id, chapter, signal, issue_tag, custom_tag FROM entry),
issue AS (SELECT DISTINCT record_id, issue_tag AS tag FROM said WHERE issue_tag IS NOT NULL),
custom AS (SELECT DISTINCT record_id, {_clean('custom_tag')} AS tag FROM said WHERE custom_tag IS NOT NULL),
counted AS (SELECT record_id FROM said WHERE signal IS NOT NULL OR issue_tag IS NOT NULL OR custom_tag IS NOT NULL GROUP BY 1),
marks AS (SELECT tag AS mark FROM issue UNION ALL SELECT CASE WHEN chapter IS NULL THEN '' ELSE 'c' END || CASE signal WHEN 'positive' THEN '+' ELSE '-' END FROM said WHERE signal IS NOT NULL),
deltas(mark, weight, d) AS (VALUES {_thousandths([*feedback.TAG_DELTAS.items(), *_SIGNAL_DELTAS])}),
rule(pattern, weight, d) AS (VALUES {_thousandths([(p, {w: n / 100 for w, n in ds.items()}) for p, ds in rules.TAG_RULES])}),
sums AS (SELECT weight, sum(d) AS d FROM (SELECT weight, d FROM marks JOIN deltas USING (mark) UNION ALL SELECT weight, d FROM custom JOIN rule ON regexp_matches(lower(tag), pattern)) GROUP BY 1)
SELECT (SELECT count(*) FROM counted) AS sample_size, (SELECT count(*) FROM said WHERE signal = 'positive') AS positive_signals, (SELECT count(*) FROM said WHERE signal = 'negative') AS negative_signals,
 (SELECT string_agg(tag, ',' ORDER BY n DESC, praise, tag) FROM (SELECT tag, count(*) AS n, tag IN ({', '.join(q(t) for t in feedback.POSITIVE_TAGS)}) AS praise FROM issue GROUP BY tag ORDER BY n DESC, praise, tag LIMIT {learning.DOMINANT_ISSUES})) AS dominant_issues,
 (SELECT string_agg(tag, ',' ORDER BY n DESC, lower(tag)) FROM (SELECT min(tag) AS tag, count(*) AS n FROM custom GROUP BY lower(tag) ORDER BY n DESC, lower(min(tag)) LIMIT {learning.DOMINANT_TAGS})) AS dominant_tags,
 {', '.join(f"round(greatest({feedback.LOW}::DOUBLE, least({feedback.HIGH}::DOUBLE, 1 + coalesce((SELECT d FROM sums WHERE weight = {q(w)}), 0) / 1000::DOUBLE)), 3) AS {w}" for w in feedback.WEIGHTS)},
 (SELECT max(updated_at) FROM book JOIN counted USING (record_id)) AS updated_at"""
_before = lambda c: f"last_value(CASE WHEN chapter IS NULL THEN {c} END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_{c}, lag({c}) OVER (PARTITION BY record_id, chapter ORDER BY ts, event_id) AS e_{c}"
CHANGES = f"""steps AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY record_id, chapter ORDER BY ts, event_id) AS m, {', '.join(_before(c) for c in learning.FIELDS)} FROM patch),
changed AS (SELECT record_id, event_id FROM steps WHERE n = 1 OR (chapter IS NULL AND ({' OR '.join(f'({c} IS NOT NULL AND {c} IS DISTINCT FROM b_{c})' for c in learning.FIELDS)}))
  OR (chapter IS NOT NULL AND (m = 1 OR {' OR '.join(f'{c} IS DISTINCT FROM e_{c}' for c in learning.FIELDS)})))"""
