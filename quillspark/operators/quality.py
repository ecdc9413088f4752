"""How good the chosen sources and books of many queries are, and how such measures are distributed.

Defined results: a query without focus words is covered; fewer than two sources or chapters share nothing
(redundancy 0, distinctness 1); groups without values have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import jaccard
from ..functions.text import signature, tokenize

METRICS = ("average_relevance", "focus_coverage", "redundancy", "chapter_distinctness", "average_authority")


def mean_overlap(rows: DataFrame, by: str, order: str, words: str) -> DataFrame:
    """by, overlap: the mean Jaccard of the words of each two rows of a group, which is a short list."""
    x, y = rows.select(by, order, words).alias("x"), rows.select(by, order, words).alias("y")
    pairs = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col(f"x.{order}") < F.col(f"y.{order}")))
    return pairs.groupBy(F.col(f"x.{by}").alias(by)).agg(F.avg(jaccard(F.col(f"x.{words}"), F.col(f"y.{words}"))).alias("overlap"))


def measures(sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """query_id, n_sources, n_chapters and METRICS of chosen sources(query_id, place, title, content,
    relevance, authority, focus) and the chapters(query_id, chapter, title, content) of their books."""
    words = lambda *c: F.array_distinct(tokenize(F.concat_ws(" ", *c)))
    rows = sources.select("query_id", "place", "relevance", "authority", "focus", words("title", "content").alias("said"), signature(F.col("content")).alias("words"))
    own = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.avg("relevance").alias("average_relevance"), F.avg("authority").alias("average_authority"), F.first("focus").alias("focus"),
        F.array_distinct(F.flatten(F.collect_list(F.array_intersect("said", "focus")))).alias("covered"))
    told = chapters.select("query_id", "chapter", words("title", "content").alias("words"))
    sizes = told.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    out = own.join(mean_overlap(rows, "query_id", "place", "words").withColumnRenamed("overlap", "redundancy"), "query_id", "left")
    out = out.join(mean_overlap(told, "query_id", "chapter", "words"), "query_id", "left").join(sizes, "query_id", "left")
    coverage = F.when(F.size("focus") > 0, F.size("covered") / F.size("focus")).otherwise(1.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {"average_relevance": F.col("average_relevance"), "focus_coverage": coverage, "redundancy": zero("redundancy"), "chapter_distinctness": 1 - zero("overlap"), "average_authority": F.col("average_authority")}
    return out.select("query_id", "n_sources", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), *[F.round(v, 6).alias(k) for k, v in values.items()])


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, median, stdev, lowest, highest, p25, p75 of a column, interpolated between neighbours.
    Quantiles come from counts by value and their running sums, so no task holds the values of a group."""
    r = lambda c: F.round(c, 6)
    rows = rows.select(*by, F.col(value).alias("x")).where("x is not null")
    counts = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("x")), "all": F.sum("n").over(group)})

    def quantile(p: float) -> Column:
        at = (F.col("all") - 1) * p
        at_place = lambda i: F.min(F.when(F.col("upto") > i, F.col("x")))
        return at_place(F.floor(at)) + (at_place(F.ceil(at)) - at_place(F.floor(at))) * F.max(at - F.floor(at))

    quantiles = counts.groupBy(*by).agg(r(quantile(0.5)).alias("median"), r(quantile(0.25)).alias("p25"), r(quantile(0.75)).alias("p75"))
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("stdev"), F.min("x").alias("lowest"), F.max("x").alias("highest"))
    return means.join(quantiles, by).select(*by, "n", "mean", "median", "stdev", "lowest", "highest", "p25", "p75")


def packs(cases: DataFrame, tag: str) -> DataFrame:
    """Each case in the pack of its tag and in the pack `all`."""
    return cases.withColumn("pack", F.explode(F.array(F.lit("all"), F.coalesce(tag, F.lit("")))))


def suite(measured: DataFrame, tag: str) -> DataFrame:
    """pack, metric and the distribution of each metric over the cases of a pack."""
    long = packs(measured, tag).select("pack", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("v")).select("pack", "v.metric", "v.x")
    return distribution(long, ["pack", "metric"], "x")
