"""Deduplication and merging of source rows.

Rows carry `pos`, their place in the result list of a query; it breaks every tie.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import comparable, comparable_tokens
from ..functions.text import let
from ..functions.web import key_url
from .staging import stage


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; candidates combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*[F.col(c) if c in keys else F.col("x").getField(c).alias(c) for c in rows.columns])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 in each group. Rows are dealt by range of group and order, numbered in
    each range and moved by the sizes of the ranges before it, so a large group is spread over tasks."""
    dealt = stage(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return dealt.withColumn("_own", own).join(moved, same).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).select(*rows.columns, name)


def interleave(rows: DataFrame, group: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Round robin over the groups: round and place of each row. A row's place follows from its round and
    the sizes of the groups (of null ones too): all rows of earlier rounds, and the groups before its own that reach its round."""
    rows = numbered(rows, [*(by or []), group], order, "round")
    if not by:
        return rows
    sizes = rows.groupBy(*by, group).agg(F.max("round").alias("_n"))
    lists = sizes.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col("_n").alias("n")))).alias("_sizes"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    rows = rows.join(lists, same)
    earlier = F.aggregate("_sizes", F.lit(0), lambda a, x: a + F.least(x["n"], F.col("round") - 1))
    first = lambda x: F.when(x["g"].isNull(), F.col(group).isNotNull()).otherwise(F.coalesce(x["g"] < F.col(group), F.lit(False)))
    ahead = F.size(F.filter("_sizes", lambda x: (x["n"] >= F.col("round")) & first(x)))
    return rows.withColumn("place", (earlier + ahead + 1).cast("int")).drop("_sizes", *[f"_{c}" for c in by])


def source_key(url: Column, title: Column, content: Column) -> Column:
    """The URL without fragment and trailing slash, or title and beginning of the content."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.coalesce(url, F.lit("")) != "", key_url(url)).otherwise(F.concat(low(title), F.lit("::"), F.substring(low(content), 1, 180)))


def first_by(rows: Column, field: str, most: int | None = None) -> Column:
    """The first row of each value of a field, whatever its case, of an array of structs."""
    once = let(F.transform(rows, lambda x: F.lower(F.trim(x[field]))), lambda keys: F.filter(rows, lambda x, i: F.array_position(keys, F.lower(F.trim(x[field]))) == i + 1))
    return once if most is None else F.slice(once, 1, most)


def merge_by_key(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: longest title and content (ties: first), all providers, best scores, and, of
    rows that have them, all definitions and subtopics, each term and title once. A plain hash aggregate,
    summed before the shuffle."""
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("pos"))).alias(c)
    lists = {c: f for c, f in (("definitions", "term"), ("subtopics", "title")) if c in rows.columns}
    in_order = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c]))
    out = rows.groupBy(key).agg(
        longest("title"), longest("content"), F.sort_array(F.collect_set("provider")).alias("providers"), F.count(F.lit(1)).alias("n_merged"),
        F.max("informative_score").alias("informative_score"), F.max("authority_score").alias("authority_score"), *[in_order(c).alias(c) for c in lists])
    return out.withColumns({c: first_by(F.col(c), f) for c, f in lists.items()})


#: Definitions and subtopics of a merged row.
MOST = {"definitions": ("term", 6), "subtopics": ("title", 4)}
FOLDED = (
    "query_id long, pos long, url string, title string, content string, providers array<string>, n_merged long, informative_score double, authority_score double, "
    "definitions array<struct<term:string,description:string>>, subtopics array<struct<title:string,summary:string>>")


def ordered_fold(rows: DataFrame) -> DataFrame:
    """Rows of a query in order: each joins the kept row that registered its URL, else its title
    (URLs and titles share one register), else is kept and registers both. A joining row registers
    nothing; it gives its provider, its longer content, its better scores, and the definitions and
    subtopics that are new. The outcome depends on what was kept before, so a query's list is folded
    in one group; lists are frontiers of bounded length."""
    given = {"informative_score": F.lit(0.0), "authority_score": F.lit(0.0)} | {c: F.array().cast(FOLDED.split(f"{c} ")[1].split(", ")[0]) for c in MOST}
    rows = rows.withColumns({c: v for c, v in given.items() if c not in rows.columns})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        register: dict[str, int] = {}
        kept: list[dict] = []
        for row in group.sort_values("pos").itertuples():
            keys = (row.url.lower(), row.title.lower())
            at = next((register[k] for k in keys if k in register), None)
            told = {c: [dict(x) if isinstance(x, dict) else x.asDict() for x in getattr(row, c)] for c in MOST}
            if at is None:
                for k in keys:
                    register.setdefault(k, len(kept))
                at = len(kept)
                kept.append({"query_id": row.query_id, "pos": row.pos, "url": row.url, "title": row.title, "content": row.content, "providers": [], "n_merged": 0,
                             "informative_score": row.informative_score, "authority_score": row.authority_score, "definitions": [], "subtopics": []})
            old = kept[at]
            old["n_merged"] += 1
            if row.provider not in old["providers"]:
                old["providers"].append(row.provider)
            if len(row.content) > len(old["content"]):
                old["content"] = row.content
            for c in ("informative_score", "authority_score"):
                old[c] = max(old[c], getattr(row, c))
            for c, (name, most) in MOST.items():
                old[c] = _first(old[c] + told[c], name)[:most]
        return pd.DataFrame(kept)

    return rows.groupBy("query_id").applyInPandas(fold, FOLDED)


def _first(rows: list[dict], name: str) -> list[dict]:
    """The first row of each name, whatever its case."""
    seen: dict[str, dict] = {}
    for x in rows:
        seen.setdefault(x[name].lower(), x)
    return list(seen.values())


def _alike(a: tuple[str, frozenset], b: tuple[str, frozenset]) -> float:
    """Likeness of two comparable texts with their words: 1 if equal, .96 if one of 28 characters or more is in the other, else the share of common words."""
    if not a[0] or not b[0]:
        return 0.0
    if a[0] == b[0]:
        return 1.0
    short, long = sorted((a[0], b[0]), key=len)
    if len(short) >= 28 and short in long:
        return 0.96
    return len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] and b[1] else 0.0


def near_fold(rows: DataFrame, titles: float = 0.96, contents: float = 0.95) -> DataFrame:
    """Rows of a query in order, without those without URL and those whose URL, title or content is
    that of, or too like that of, a row kept before."""
    prepared = rows.select("query_id", "pos", "url", *[x for c in ("title", "content") for x in (comparable(F.col(c)).alias(f"{c}_text"), comparable_tokens(F.col(c)).alias(f"{c}_words"))])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        ordered = group.sort_values("pos").reset_index(drop=True)
        sides = [[(t, frozenset(w)) for t, w in zip(ordered[f"{c}_text"], ordered[f"{c}_words"], strict=True)] for c in ("title", "content")]
        urls = ordered["url"]
        for i, url in enumerate(urls):
            if url and not any(urls[k] == url or _alike(sides[0][k], sides[0][i]) >= titles or _alike(sides[1][k], sides[1][i]) >= contents for k in kept):
                kept.append(i)
        return ordered.loc[kept, ["query_id", "pos", "url"]]

    return prepared.groupBy("query_id").applyInPandas(fold, "query_id long, pos long, url string")
