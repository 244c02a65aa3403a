"""Streams with keyed state: status, delivery, and event ids over several jobs."""

import random
from datetime import datetime, timedelta

from leadsmith.operators import logs as LG
from leadsmith.operators.delivery import deliver, failure_log
from leadsmith.sources.fixtures import rule_transport, scripted_transport
from leadsmith.streaming import twins as TW

UPDATES = "job_id string, ts timestamp_ntz, log_id long, status string, progress string, message string"


def updates(seed, n):
    rng = random.Random(seed)
    at = datetime(2024, 1, 1)
    return [(f"j{rng.randrange(4)}", at + timedelta(seconds=rng.randrange(50)), seed * n + k, rng.choice([None, "a", "b"]),
             rng.choice([None, "10", "9"]), rng.choice([None, f"m{k}", ""])) for k in range(n)]


def test_status_state_equals_status_merge_after_restarts(spark, tmp_path):
    """Three runs over growing input: nothing but one checkpoint is kept, and the state is the batch result."""
    src, state, rows = str(tmp_path / "src"), str(tmp_path / "state"), []
    fields = ["status", "progress", "message"]
    for run in range(3):
        new = updates(run, 40) + ([(None, datetime(2024, 1, 1), 999, "x", None, None), ("quiet", datetime(2024, 1, 1), 1, None, None, None)] if run else [])
        rows += new
        spark.createDataFrame(new, UPDATES).coalesce(1).write.mode("append").parquet(src)
        got = TW.stream_status(spark, src, lambda df: df, fields, state)
        want = LG.status_merge(spark.createDataFrame(rows, UPDATES), fields)
        assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["checkpoint"]


def stream(spark, src):
    return spark.readStream.schema("record_number long, payload string").parquet(src)


def test_two_jobs_share_a_results_folder(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    spark.createDataFrame([(i, "{}") for i in (0, 1, 1, 2)], "record_number long, payload string").write.parquet(src)
    for job in ("a", "b/c"):
        out = TW.stream_delivery(spark, stream(spark, src), job, rule_transport(0, 0), 1000.0, lambda s: None, state).collect()
        assert sorted((r["job_id"], r["record_number"]) for r in out) == [(job, 0), (job, 1), (job, 2)]


def test_a_batch_without_results_is_sent_again_and_one_with_results_is_not(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    spark.createDataFrame([(i, "{}") for i in range(4)], "record_number long, payload string").write.parquet(src)

    def broken():
        raise RuntimeError("receiver away")

    try:
        TW.stream_delivery(spark, stream(spark, src), "j", broken, 1000.0, lambda s: None, state)
        raise AssertionError("the first run should fail")
    except Exception as e:  # noqa: BLE001
        assert "receiver away" in str(e)
    for _ in range(2):
        out = TW.stream_delivery(spark, stream(spark, src), "j", rule_transport(0, 0), 1000.0, lambda s: None, state).collect()
        assert sorted(r["record_number"] for r in out) == [0, 1, 2, 3]
    finished = {r["finished"] for r in out}
    again = TW.stream_delivery(spark, stream(spark, src), "j", rule_transport(0, 0), 1000.0, lambda s: None, state).collect()
    assert {r["finished"] for r in again} == finished


def test_events_of_two_jobs_have_ids_of_their_own(spark, tmp_path):
    store = str(tmp_path / "store")
    pay = spark.createDataFrame([(i, "{}") for i in (1, 2)], "record_number long, payload string")
    for job in ("a", "b"):
        failed = failure_log(deliver(pay, job, scripted_transport({1: [500], 2: [500]}), rate=10, partitions=1, sleep=lambda s: None))
        failed.write.mode("append").parquet(store)
    logs = spark.read.parquet(store)
    assert logs.select("event_id").distinct().count() == 4 and logs.select("log_id").distinct().count() == 2
    found = TW.stream_dedup_events(spark, store, lambda df: df, key="event_id").collect()
    assert sorted((r["job_id"], r["record_number"]) for r in found) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
