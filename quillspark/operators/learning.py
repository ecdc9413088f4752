"""Feedback records with chapters and free tags, merged field by field, and what they teach.

A patch is one act of feedback: it names a record, perhaps a chapter of it, and what it sets (a signal,
an issue tag, a free tag); what it leaves null stays as it was. Patches are ordered by time and event id. A book's
fields are the latest set ones each; a chapter's entry is its latest patch as a whole.

Defined results: a patch that sets nothing changes no book field; unknown issue tags are left out; a record
without any signal or tag does not count; rows that repeat an event change nothing; empty logs teach nothing (all weights 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .feedback import HIGH, LOW, NEGATIVE_DELTAS, POSITIVE_DELTAS, POSITIVE_TAGS, TAG_DELTAS, WEIGHTS

# Fixed values that results depend on.
CHAPTER_NEGATIVE, CHAPTER_POSITIVE = {"antiRedundancy": 0.025, "diversity": 0.02}, {"coherence": 0.015}
MOST_CUSTOM_TAGS, DOMINANT_ISSUES, DOMINANT_TAGS = 12, 3, 4
#: Stand-ins: events of the tables carry a number k; it names a chapter, an issue tag or one of these free tags.
FREE_TAGS = ["too shallow", "Duplicate  parts", "missing citation", "weak headings", "outline unclear", "needs comparison", "more nuance"]
CHAPTERS, BOOK_BELOW = 10, 50
ORDER = ["ts", "event_id"]


def patches(events: DataFrame) -> DataFrame:
    """record_id, ts, event_id, chapter (null: the book), signal, issue_tag, custom_tag of an event log."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    pick = lambda items: F.get(F.array(*[F.lit(t) for t in items]), F.pmod(F.col("k"), F.lit(len(items))).cast("int"))
    kind = F.col("event_type")
    rows = events.select(F.col("user_id").alias("record_id"), "ts", "event_id", "event_type", k.alias("k"))
    return rows.select(
        "record_id", "ts", "event_id", F.when(F.col("k") >= BOOK_BELOW, F.pmod(F.col("k"), F.lit(CHAPTERS)).cast("int")).alias("chapter"),
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").alias("signal"), F.when(kind == "click", pick(list(TAG_DELTAS))).alias("issue_tag"), F.when(kind == "view", pick(FREE_TAGS)).alias("custom_tag"))


FIELDS = ("signal", "issue_tag", "custom_tag")


def merged(log: DataFrame) -> DataFrame:
    """record_id, signal, issue_tag, custom_tag of the book, chapters (by number: chapter, signal, issue_tag,
    custom_tag) and updated_at of each record. Aggregates alone, so they combine before the shuffle."""
    stamp = F.struct(*ORDER)
    last = lambda c: F.max_by(c, F.when(F.col("chapter").isNull() & F.col(c).isNotNull(), stamp)).alias(c)
    books = log.groupBy("record_id").agg(*[last(c) for c in FIELDS], F.max("ts").alias("updated_at"))
    entries = log.where("chapter is not null").groupBy("record_id", "chapter").agg(F.max_by(F.struct("chapter", *FIELDS), stamp).alias("x"))
    lists = entries.groupBy("record_id").agg(F.sort_array(F.collect_list("x")).alias("chapters"))
    none = F.array().cast(lists.schema["chapters"].dataType)
    return books.join(lists, "record_id", "left").withColumn("chapters", F.coalesce("chapters", none))


def _marks(records: DataFrame) -> DataFrame:
    """record_id, signals, issues (known, each once) and customs (each once whatever its case) of records that say anything."""
    every = lambda c: F.filter(F.concat(F.array(c), F.transform("chapters", lambda x: x[c])), lambda v: v.isNotNull())
    known = F.array(*[F.lit(t) for t in TAG_DELTAS])
    rows = records.select("record_id", "updated_at", F.col("signal").alias("book"), F.transform("chapters", lambda x: x["signal"]).alias("of_chapters"), every("signal").alias("signals"),
                          F.array_intersect(every("issue_tag"), known).alias("issues"), rules.custom_tags(every("custom_tag"), MOST_CUSTOM_TAGS).alias("customs"))
    return rows.where((F.size("signals") > 0) | (F.size("issues") > 0) | (F.size("customs") > 0))


def _count(items: Column, value: str) -> Column:
    return F.size(F.filter(items, lambda v: F.coalesce(v == value, F.lit(False))))


def profile(records: DataFrame) -> DataFrame:
    """One row: sample_size, positive_signals, negative_signals, dominant_issues (three; of equals no praise
    first, then by name), dominant_tags (four, ties by name), the nine weights and updated_at. Tags are counted
    before what they are worth meets them; sums are whole thousandths."""
    spark, said = records.sparkSession, _marks(records)
    free = said.select(F.explode("customs").alias("tag")).groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n"))
    issues = said.select(F.explode("issues").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    worth = spark.createDataFrame([(t, w, round(1000 * d)) for t, ds in TAG_DELTAS.items() for w, d in ds.items()], "tag string, weight string, d long")
    impact = rules.tag_impact(F.col("tag"))
    by_free = free.select("n", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), (d.cast("long") * 10).alias("d")) for w, d in impact.items()])).alias("x")).select("n", "x.weight", "x.d")
    both = {"+": POSITIVE_DELTAS, "-": NEGATIVE_DELTAS, "c+": CHAPTER_POSITIVE, "c-": CHAPTER_NEGATIVE}
    totals = said.agg(*[F.sum(e).alias(k) for k, e in {"+": F.when(F.col("book") == "positive", 1).otherwise(0), "-": F.when(F.col("book") == "negative", 1).otherwise(0), "c+": _count(F.col("of_chapters"), "positive"), "c-": _count(F.col("of_chapters"), "negative")}.items()])
    signals = totals.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), (F.coalesce(f"`{k}`", F.lit(0)) * round(1000 * d)).alias("d")) for k, ds in both.items() for w, d in ds.items()])).alias("x")).select(F.lit(1).cast("long").alias("n"), "x.weight", "x.d")
    sums = issues.join(F.broadcast(worth), "tag").select("n", "weight", "d").unionByName(by_free).unionByName(signals).groupBy("weight").agg(F.sum(F.col("n") * F.col("d")).alias("d"))
    value = lambda w: F.round(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 1 + F.coalesce(F.max(F.when(F.col("weight") == w, F.col("d"))), F.lit(0)) / 1000)), 3).alias(w)
    weights = sums.agg(*[value(w) for w in WEIGHTS])
    top = lambda rows, order, most: F.slice(F.transform(F.sort_array(F.collect_list(F.struct(*order, "tag"))), lambda x: x["tag"]), 1, most)
    best_issues = issues.agg(top(issues, [(-F.col("n")).alias("a"), F.col("tag").isin(POSITIVE_TAGS).alias("b")], DOMINANT_ISSUES).alias("dominant_issues"))
    best_free = free.agg(top(free, [(-F.col("n")).alias("a"), F.col("key").alias("b")], DOMINANT_TAGS).alias("dominant_tags"))  # tags in use: one row for each distinct free tag
    head = said.agg(F.count(F.lit(1)).alias("sample_size"), F.coalesce(F.sum(_count(F.col("signals"), "positive")), F.lit(0)).alias("positive_signals"), F.coalesce(F.sum(_count(F.col("signals"), "negative")), F.lit(0)).alias("negative_signals"), F.max("updated_at").alias("updated_at"))
    return reduce(lambda a, b: a.join(b, "one"), [t.withColumn("one", F.lit(1)) for t in (head, best_issues, best_free, weights)]).drop("one")  # one row each


def appended(log: DataFrame) -> DataFrame:
    """record_id, event_id of the patches that change what their record says: the event log gets these alone."""
    book = Window.partitionBy("record_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    entry = Window.partitionBy("record_id", "chapter").orderBy(*ORDER)
    first = F.row_number().over(Window.partitionBy("record_id").orderBy(*ORDER)) == 1
    before = lambda c: F.last(F.when(F.col("chapter").isNull(), F.col(c)), ignorenulls=True).over(book)
    sets = [F.col("chapter").isNull() & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(before(c)) for c in FIELDS]
    new = [F.col("chapter").isNotNull() & ((F.row_number().over(entry) == 1) | ~F.col(c).eqNullSafe(F.lag(c).over(entry))) for c in FIELDS]
    test = first
    for part in (*sets, *new):
        test = test | part
    return log.dropDuplicates(["event_id"]).withColumn("changes", test).where("changes").select("record_id", "event_id")
