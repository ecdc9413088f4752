"""The feedback log as a stream: append with ignored duplicates, the latest state of each record, and the
profile rebuilt after each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import learning


def append_once(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Writes each event id once. State holds the ids of the last `late` of event time alone."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A set field has the stamp (time in microseconds, event id) of the patch that set it.
_SET = "struct<value:string,us:bigint,event_id:bigint>"
STATE = f"signal {_SET}, issue_tag {_SET}, custom_tag {_SET}, chapters array<struct<chapter:int,us:bigint,event_id:bigint,signal:string,issue_tag:string,custom_tag:string>>, us long"
OUT = "record_id long, signal string, issue_tag string, custom_tag string, chapters array<struct<chapter:int,signal:string,issue_tag:string,custom_tag:string>>, us long"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Puts the patches of one record into its state; an older patch that comes late changes no newer field."""
    none = lambda v: None if v is None or v != v else v
    fields, chapters, latest = dict.fromkeys(learning.FIELDS), {}, 0
    if state.exists:
        *held, rows, latest = state.get
        fields = dict(zip(learning.FIELDS, (tuple(x) if x is not None else None for x in held), strict=True))
        chapters = {r[0]: tuple(r) for r in rows}
    for frame in frames:
        for r in frame.itertuples(index=False):
            stamp, latest = (int(r.us), int(r.event_id)), max(latest, int(r.us))
            if none(r.chapter) is None:
                for c in learning.FIELDS:
                    value = none(getattr(r, c))
                    if value is not None and (fields[c] is None or fields[c][1:] < stamp):
                        fields[c] = (value, *stamp)
            elif int(r.chapter) not in chapters or chapters[int(r.chapter)][1:3] < stamp:
                chapters[int(r.chapter)] = (int(r.chapter), *stamp, *(none(getattr(r, c)) for c in learning.FIELDS))
    rows = [chapters[k] for k in sorted(chapters)]
    state.update((*(fields[c] for c in learning.FIELDS), rows, latest))
    shown = [{"chapter": r[0], **dict(zip(learning.FIELDS, r[3:], strict=True))} for r in rows]
    yield pd.DataFrame({"record_id": [key[0]], **{c: [fields[c][0] if fields[c] else None] for c in learning.FIELDS}, "chapters": [shown], "us": [latest]})


def records_of(events: DataFrame) -> DataFrame:
    """The state of each record that a batch of the event stream touches."""
    log = learning.patches(events).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return log.groupBy("record_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest_records(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each record; a batch that ran twice has replaced its own folder."""
    rows = spark.read.parquet(f"{path}/records")
    best = rows.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "record_id"]), "batch").alias("x")).select("record_id", "x.*")
    return best.withColumn("updated_at", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us", "batch")


def learn(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps records under {path}/records and, after each batch, the profile of all of them under
    {path}/profile. Both are written by batch number, so a batch that runs again replaces itself."""
    def batch(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/records/part={n}")
        learning.profile(latest_records(rows.sparkSession, path)).write.mode("overwrite").parquet(f"{path}/profile/part={n}")

    return records_of(events).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile after the last batch."""
    rows = spark.read.parquet(f"{path}/profile")
    return rows.join(rows.agg(F.max("part").alias("part")), "part").drop("part")
