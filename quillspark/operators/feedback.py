"""Learning reward weights from feedback records, in DataFrame operations.

A feedback record is one user of the event log: purchases and sign-ups are positive signals,
errors negative ones, clicks and views carry an issue tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that results depend on: what each issue tag adds to the reward weights.
WEIGHTS = "relevance coverage authority evidenceDensity diversity structure coherence titleSpecificity antiRedundancy".split()
TAG_DELTAS = {
    "too_generic": {"relevance": 0.08, "coverage": 0.04, "titleSpecificity": 0.10},
    "repetitive": {"diversity": 0.12, "antiRedundancy": 0.12, "coherence": 0.03},
    "weak_evidence": {"authority": 0.10, "evidenceDensity": 0.12, "structure": 0.04},
    "unclear_titles": {"titleSpecificity": 0.14, "relevance": 0.05},
    "wrong_structure": {"structure": 0.12, "coherence": 0.08},
    "clear_structure": {"structure": 0.05, "coherence": 0.05},
    "strong_evidence": {"authority": 0.05, "evidenceDensity": 0.06},
    "insightful_synthesis": {"coherence": 0.08, "diversity": 0.04, "relevance": 0.03},
}
POSITIVE_TAGS = ["clear_structure", "strong_evidence", "insightful_synthesis"]
POSITIVE_DELTAS, NEGATIVE_DELTAS = {"coherence": 0.03, "evidenceDensity": 0.02}, {"relevance": 0.04, "structure": 0.04, "titleSpecificity": 0.03}
LOW, HIGH = 0.82, 1.35


def records(events: DataFrame) -> DataFrame:
    """record_id, signal, tags of each user; the latest signal counts."""
    tag = F.element_at(F.array(*[F.lit(t) for t in TAG_DELTAS]), (F.pmod(F.get_json_object("props", "$.k").try_cast("long"), F.lit(len(TAG_DELTAS))) + 1).cast("int"))
    signal = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative")
    rows = events.select(F.col("user_id").alias("record_id"), "ts", "event_id", signal.alias("signal"), F.when(F.col("event_type").isin("click", "view"), tag).alias("tag"))
    order = F.when(F.col("signal").isNotNull(), F.struct("ts", "event_id"))
    return rows.groupBy("record_id").agg(F.max_by("signal", order).alias("signal"), F.sort_array(F.collect_set("tag")).alias("tags"), F.max("ts").alias("updated_at"))


def _deltas(spark) -> DataFrame:
    rows = [(k, w, d) for k, ds in TAG_DELTAS.items() for w, d in ds.items()] + [(s, w, d) for s, ds in (("+", POSITIVE_DELTAS), ("-", NEGATIVE_DELTAS)) for w, d in ds.items()]
    return spark.createDataFrame(rows, "tag string, weight string, delta double")


def reward_profile(recs: DataFrame) -> DataFrame:
    """weight, value: one plus what all records add, clamped. Tags are counted before the deltas
    join, so one row for each tag meets them."""
    spark = recs.sparkSession
    marks = F.concat("tags", F.when(F.col("signal") == "positive", F.array(F.lit("+"))).when(F.col("signal") == "negative", F.array(F.lit("-"))).otherwise(F.array().cast("array<string>")))
    counts = recs.select(F.explode(marks).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(F.broadcast(_deltas(spark)), "tag").groupBy("weight").agg(F.sum(F.round(F.col("n") * F.col("delta") * 100).cast("long")).alias("hundredths"))
    names = spark.createDataFrame([(w,) for w in WEIGHTS], "weight string")
    value = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 1 + F.coalesce("hundredths", F.lit(0)) / 100))
    return names.join(sums, "weight", "left").select("weight", F.round(value, 3).alias("value"))


def dominant_issues(recs: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent issue tags; of equal ones those that are no praise first."""
    counts = recs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), F.col("tag").isin(POSITIVE_TAGS).cast("int"), "tag")  # one row for each of the fixed tags
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert: the latest version of each key; versions combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*").select(*rows.columns)


def new_events(log: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """Append that ignores known ids: what of incoming the log lacks."""
    return incoming.dropDuplicates([key]).join(log.select(key), key, "left_anti")
