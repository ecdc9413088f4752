"""Similarity and topics of small groups of texts in a latent space, for all groups at once.

The texts of a group become rows of TF-IDF weights (words and pairs of neighbours, without stop
words), a sparse table made by joins and aggregates. A group's inner products follow from a join of
the table with itself on (group, term); from their eigenvectors come the coordinates that a truncated
singular value decomposition of the weights would give, since the two share them. Topics are the
parts of a non-negative factorisation, fitted by multiplicative updates from a start that the data
fixes, so that reruns agree. A group is a list of sources of bounded length (a frontier), so one
task holds one group's numbers; its terms are bounded by `most_terms`.

Defined results: null and blank texts are left out; a group of fewer than three texts has no latent
similarity (0); one with fewer than two texts or terms has no topics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import clamp, lexical_sets, sets_similarity
from ..functions.text import STOP_WORDS, TOKEN
from .staging import dealt

COMPONENTS, MOST_TERMS, MOST_TOPICS, TOPIC_WORDS = 3, 2000, 6, 6
UPDATES, SETTLED = 400, 1e-4


def flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def terms(text: Column) -> Column:
    """Words that are no stop words, and pairs of those that then are neighbours, each as often as it occurs."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in STOP_WORDS]), w))
    follow = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    pairs = F.filter(F.zip_with(words, follow, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(words, pairs)


def weights(texts: DataFrame, most_terms: int | None = None) -> DataFrame:
    """group, pos, term, w of texts(group, pos, text), rows of length one: (1 + ln count) times
    ln((1 + texts) / (1 + texts with the term)) + 1. most_terms: the most frequent of each group, ties by term."""
    texts = texts.select("group", "pos", flat(F.col("text")).alias("text")).where("text <> ''")
    counts = texts.select("group", "pos", F.explode(terms(F.col("text"))).alias("term")).groupBy("group", "pos", "term").agg(F.count(F.lit(1)).alias("n"))
    of_term = counts.groupBy("group", "term").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("all"))
    if most_terms is not None:
        w = Window.partitionBy("group").orderBy(F.desc("all"), "term")
        of_term = of_term.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_terms).drop("k")
    sizes = texts.groupBy("group").agg(F.count(F.lit(1)).alias("texts"))
    rows = counts.join(of_term, ["group", "term"]).join(sizes, "group")
    raw = (1 + F.log("n")) * (F.log((1 + F.col("texts")) / (1 + F.col("held"))) + 1)
    rows = rows.withColumn("raw", raw)
    return rows.select("group", "pos", "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("group", "pos")))).alias("w"))


def products(weighted: DataFrame) -> DataFrame:
    """group, a, b, product of each two texts (a <= b) that share a term."""
    x, y = weighted.alias("x"), weighted.alias("y")
    on = (F.col("x.group") == F.col("y.group")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.pos") <= F.col("y.pos"))
    return x.join(y, on).groupBy(F.col("x.group").alias("group"), F.col("x.pos").alias("a"), F.col("y.pos").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("product"))


def coordinates(gram: np.ndarray, components: int) -> np.ndarray:
    """Rows in the space of the largest singular values, from their inner products."""
    values, vectors = np.linalg.eigh(gram)
    keep = np.argsort(-values, kind="stable")[:components]
    return vectors[:, keep] * np.sqrt(np.maximum(values[keep], 0.0))


def mean_cosine(points: np.ndarray) -> float:
    """Of each two rows; a row of zeros is like none."""
    size = np.linalg.norm(points, axis=1, keepdims=True)
    unit = np.divide(points, size, out=np.zeros_like(points), where=size > 1e-12)
    a, b = np.triu_indices(len(points), 1)
    return float((unit @ unit.T)[a, b].mean())


def group_similarity(texts: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """group, latent: the mean cosine of each two texts of a group after the reduction, from 0 to 1."""
    weighted = weights(texts)
    sizes = weighted.groupBy("group").agg(F.countDistinct("term").alias("n_terms"))
    rows = products(weighted).join(sizes, "group")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        places = {p: i for i, p in enumerate(sorted({*group["a"], *group["b"]}))}
        gram = np.zeros((len(places), len(places)))
        i, j = group["a"].map(places).to_numpy(), group["b"].map(places).to_numpy()
        gram[i, j] = gram[j, i] = group["product"].to_numpy()
        k = min(len(places) - 1, int(group["n_terms"].iloc[0]) - 1, components)
        score = mean_cosine(coordinates(gram, k)) if len(places) >= 3 and k >= 1 else 0.0
        return pd.DataFrame({"group": group["group"].iloc[:1], "latent": [round(min(1.0, max(0.0, score)), 6)]})

    return dealt(rows, "group").groupBy("group").applyInPandas(run, f"group {dict(rows.dtypes)['group']}, latent double")


def coherence(queries: DataFrame, sections: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """group, to_query, to_each_other, latent, coherence of sections(group, pos, text) and
    queries(group, query): .45 of the mean likeness to the query, .40 of that of each two sections and
    .15 of the latent similarity of all. Groups without sections are 0."""
    rows = sections.select("group", "pos", flat(F.col("text")).alias("text")).where("text <> ''").withColumn("sets", lexical_sets(F.col("text")))
    asked = queries.select("group", flat(F.col("query")).alias("query")).withColumn("asked", lexical_sets(F.col("query")))
    told = rows.join(asked.where("query <> ''"), "group").groupBy("group").agg(F.avg(F.round(sets_similarity(F.col("query"), F.col("text"), F.col("asked"), F.col("sets")), 6)).alias("to_query"))
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.pos") < F.col("y.pos")))
    both = both.groupBy(F.col("x.group").alias("group")).agg(F.avg(F.round(sets_similarity(F.col("x.text"), F.col("y.text"), F.col("x.sets"), F.col("y.sets")), 6)).alias("to_each_other"))
    held = rows.select("group").distinct()
    every = rows.select("group", "pos", "text").unionByName(asked.where("query <> ''").join(held, "group", "left_semi").select("group", F.lit(-1).cast(dict(rows.dtypes)["pos"]).alias("pos"), F.col("query").alias("text")))
    asks = every.where("pos = -1").select("group").distinct()
    latent = group_similarity(every.join(asks, "group", "left_semi"), components)
    out = queries.select("group").distinct().join(told, "group", "left").join(both, "group", "left").join(latent, "group", "left")
    zero = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6) for c in ("to_query", "to_each_other", "latent")}
    exact = clamp(F.coalesce("to_query", F.lit(0.0)) * 0.45 + F.coalesce("to_each_other", F.lit(0.0)) * 0.40 + F.coalesce("latent", F.lit(0.0)) * 0.15)
    return out.select("group", *[v.alias(k) for k, v in zero.items()], F.round(F.round(exact, 12), 6).alias("coherence"))


# ---------------------------------------------------------------- topics


def start(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors from the singular vectors: of each pair its larger-signed half, the first
    pair whole; zeros become the mean, so that updates can move them."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((len(x), k)), np.zeros((k, x.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(v[0])
    for j in range(1, k):
        halves = [(np.maximum(sign * u[:, j], 0), np.maximum(sign * v[j], 0)) for sign in (1, -1)]
        sizes = [(np.linalg.norm(a), np.linalg.norm(b)) for a, b in halves]
        # At equal size, the half whose largest term comes first: singular vectors have no sign of their own.
        best = max((0, 1), key=lambda i: (round(sizes[i][0] * sizes[i][1], 9), -int(halves[i][1].argmax())))
        (a, b), (na, nb) = halves[best], sizes[best]
        if na * nb > 0:
            w[:, j], h[j] = np.sqrt(s[j] * na * nb) * a / na, np.sqrt(s[j] * na * nb) * b / nb
    mean = x.mean()
    return np.where(w < 1e-6, mean, w), np.where(h < 1e-6, mean, h)


def factors(x: np.ndarray, k: int, updates: int = UPDATES, settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """w and h >= 0 with w @ h near x, by multiplicative updates."""
    w, h = start(x, k)
    first = last = np.linalg.norm(x - w @ h)
    for n in range(1, updates + 1):
        w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        h *= (w.T @ x) / np.maximum((w.T @ w) @ h, 1e-12)
        if n % 10 == 0:
            now = np.linalg.norm(x - w @ h)
            if last - now <= settled * first:
                break
            last = now
    return w, h


def branches(points: np.ndarray, k: int) -> list[int]:
    """Groups of rows: those two join next whose joint spread grows least, until k are left."""
    groups = [[i] for i in range(len(points))]
    while len(groups) > k:
        def cost(pair: tuple[int, int]) -> float:
            a, b = (points[groups[i]] for i in pair)
            return len(a) * len(b) / (len(a) + len(b)) * float(((a.mean(0) - b.mean(0)) ** 2).sum())

        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (cost(p), p))
        groups[a] += groups.pop(b)
    return [next(g for g, rows in enumerate(groups) if i in rows) for i in range(len(points))]


def keywords(component: np.ndarray, names: list[str], asked: frozenset[str], most: int = TOPIC_WORDS) -> list[str]:
    """The words of a topic's strongest terms that add to the query, each once."""
    out: list[str] = []
    for i in np.argsort(-np.round(component, 9), kind="stable"):
        words = [w for w in names[i].split(" ") if w not in out]
        if not words or (len(asked) > 1 and 1 - len(asked.intersection(words)) / len(set(words)) < 0.15):
            continue
        out += dict.fromkeys(words)
        if len(out) >= most:
            return out[:most]
    return out


TOPICS = "branch int, place int, label string, keywords array<string>, pos long, score double, divergence double"


def subtopics(queries: DataFrame, texts: DataFrame, most: int = MOST_TOPICS, most_terms: int = MOST_TERMS) -> DataFrame:
    """group, place, label, keywords, branch, pos (of the text that shows the topic best; -1 the query),
    score and divergence (the share of keywords that the query lacks) of the topics of texts(group,
    pos, text) and queries(group, query); those furthest from the query first."""
    texts = texts.select("group", F.col("pos").cast("long").alias("pos"), "text")
    every = texts.unionByName(queries.select("group", F.lit(-1).cast("long").alias("pos"), F.col("query").alias("text")))
    asked = queries.select("group", F.array_distinct(F.regexp_extract_all(flat(F.col("query")), F.lit(TOKEN), F.lit(0))).alias("asked"))
    rows = weights(every, most_terms).join(asked, "group")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, places = sorted(group["term"].unique()), sorted(group["pos"].unique())
        x = np.zeros((len(places), len(names)))
        x[np.searchsorted(places, group["pos"]), np.searchsorted(np.array(names, object), group["term"].to_numpy(object))] = group["w"].to_numpy()
        k = min(most, len(places) - 1, len(names) - 1)
        if k < 2:
            return pd.DataFrame(columns=["group", *(c.split()[0] for c in TOPICS.split(", "))], dtype=object)
        w, h = factors(x, k)
        own = w[1:] if places[0] == -1 else w
        asks = frozenset(group["asked"].iloc[0])
        found = []
        for j in range(k):
            words = keywords(h[j], names, asks)
            if words:
                best = int(np.argmax(np.round(own[:, j], 9)))
                found.append((round(1 - len(asks.intersection(words)) / len(words), 6), round(float(own[best, j]), 6), " ".join(t.capitalize() for t in words[:3]), words, int(places[best + (places[0] == -1)]), j))
        found.sort(key=lambda t: (-t[0], -t[1], t[2]))
        found = list({t[2].lower(): t for t in reversed(found)}.values())[::-1]
        found.sort(key=lambda t: (-t[0], -t[1], t[2]))
        branch = branches(h[[t[5] for t in found]], max(2, len(found) // 2)) if len(found) >= 3 else [0] * len(found)
        cut = found[:most]
        return pd.DataFrame({"group": [group["group"].iloc[0]] * len(cut), "branch": branch[: len(cut)], "place": range(1, len(cut) + 1), "label": [t[2] for t in cut], "keywords": [t[3] for t in cut], "pos": [t[4] for t in cut], "score": [t[1] for t in cut], "divergence": [t[0] for t in cut]})

    return dealt(rows, "group").groupBy("group").applyInPandas(run, f"group {dict(rows.dtypes)['group']}, {TOPICS}")
