"""Feedback records, what they teach, and the stream that keeps them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import learning
from quillspark.operators.feedback import TAG_DELTAS
from quillspark.streaming import feedback as stream

LOG = "record_id long, ts timestamp_ntz, event_id long, chapter int, signal string, issue_tag string, custom_tag string"
T = datetime(2024, 1, 1)


def _at(n):
    return T + timedelta(seconds=n)


def _log(spark, rows):
    return spark.createDataFrame([(r, _at(t), e, *rest) for r, t, e, *rest in rows], LOG)


def test_fields_merge_one_by_one(spark):
    rows = [
        (1, 1, 1, None, "positive", None, None), (1, 2, 2, None, None, "repetitive", None), (1, 3, 3, None, "negative", None, None), (1, 3, 4, None, None, None, "too vague"),
        (1, 4, 5, 2, "positive", "too_generic", None), (1, 5, 6, 2, None, None, "weak headings"), (1, 0, 7, 1, "negative", None, None), (2, 9, 8, None, None, None, None)]
    got = {r["record_id"]: r for r in learning.merged(_log(spark, rows)).collect()}
    assert (got[1]["signal"], got[1]["issue_tag"], got[1]["custom_tag"], got[1]["updated_at"]) == ("negative", "repetitive", "too vague", _at(5))
    # A chapter's entry is its latest patch as a whole.
    assert [tuple(c) for c in got[1]["chapters"]] == [(1, "negative", None, None), (2, None, None, "weak headings")]
    assert tuple(got[2])[1:4] == (None, None, None) and got[2]["chapters"] == []


def test_profile_of_literal_records(spark):
    rows = [
        (1, 1, 1, None, "positive", "too_generic", "Weak  headings"), (1, 2, 2, 0, "negative", "too_generic", "weak HEADINGS"), (1, 3, 3, 1, "negative", "no_such_tag", None),
        (2, 4, 4, None, "negative", "clear_structure", None), (2, 5, 5, 3, "positive", None, None), (3, 6, 6, None, None, None, None)]
    p = learning.profile(learning.merged(_log(spark, rows))).collect()
    assert len(p) == 1 and (p[0]["sample_size"], p[0]["positive_signals"], p[0]["negative_signals"]) == (2, 2, 3)
    assert p[0]["dominant_issues"] == ["too_generic", "clear_structure"] and [t.lower() for t in p[0]["dominant_tags"]] == ["weak headings"]
    want = {  # tags once for each record, the signals of the books, two negative chapters and a positive one
        "relevance": 1 + 0.08 + 0.04 + 0.04, "coverage": 1.04, "authority": 1.0, "evidenceDensity": 1.02, "diversity": 1.04, "structure": 1 + 0.05 + 0.04, "coherence": 1 + 0.05 + 0.03 + 0.015,
        "titleSpecificity": 1 + 0.10 + 0.14 + 0.03, "antiRedundancy": 1.05}
    assert {w: p[0][w] for w in want} == {w: pytest.approx(v, abs=1e-9) for w, v in want.items()} and p[0]["updated_at"] == _at(5)


def test_an_empty_log_teaches_nothing(spark):
    p = learning.profile(learning.merged(_log(spark, []))).collect()
    assert len(p) == 1 and p[0]["sample_size"] == 0 and p[0]["relevance"] == p[0]["antiRedundancy"] == 1.0 and p[0]["dominant_issues"] == []


def test_weights_stay_in_their_range(spark):
    p = learning.profile(learning.merged(_log(spark, [(i, i, i, None, "negative", "repetitive", None) for i in range(9)]))).first()
    assert p["antiRedundancy"] == 1.35 and p["authority"] == 1.0


def test_appended_events_are_those_that_change_a_record(spark):
    rows = [(1, 1, 1, None, "positive", None, None), (1, 2, 2, None, "positive", None, None), (1, 3, 3, None, None, None, None), (1, 4, 4, 5, None, None, None), (1, 5, 5, 5, None, None, None),
            (1, 6, 6, 5, "negative", None, None), (1, 7, 7, None, "negative", None, None), (1, 7, 7, None, "negative", None, None), (2, 1, 8, None, None, None, None)]
    assert {r["event_id"] for r in learning.appended(_log(spark, rows)).collect()} == {1, 4, 6, 7, 8}


def _events(seed, n):
    rng = random.Random(seed)
    return [(i, _at(rng.randrange(5000)), rng.randrange(6), rng.choice(["purchase", "signup", "error", "click", "view"]), 0.0, '{"k": %d}' % rng.randrange(100)) for i in range(n)]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _same(a, b):
    shown = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert shown(a.collect()) == shown(b.select(*a.columns).collect())


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Batches in any order of time, a stop in between, and a batch that runs again."""
    source, path = tmp_path / "log", str(tmp_path / "out")
    every = _events(3, 240)
    for k in range(3):
        spark.createDataFrame(every[k * 80 : (k + 1) * 80], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.learn(events, path, f"{path}/checkpoint").awaitTermination()
        want = learning.merged(learning.patches(spark.createDataFrame(every[: (k + 1) * 80], EVENTS)))
        _same(want, stream.latest_records(spark, path))
        _same(learning.profile(want), stream.last_profile(spark, path))
    assert want.count() == 6 and want.where(F.size("chapters") > 3).count() == 6
    assert {t for r in want.collect() for t in [r["issue_tag"]] if t} <= set(TAG_DELTAS)


def test_append_once_ignores_known_ids(spark, tmp_path):
    source, path = tmp_path / "log", str(tmp_path / "out")
    rows = _events(4, 40)
    for part in (rows, rows[20:]):
        spark.createDataFrame(part, EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(EVENTS.replace("timestamp_ntz", "timestamp")).parquet(str(source))
        stream.append_once(events, path, str(tmp_path / "checkpoint"), "2 hours").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == list(range(40))
