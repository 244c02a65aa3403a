"""Per-record delivery sink with retries and a shared rate budget.

Delivery is network I/O, so this is the one place with per-row Python: an
explicit number of senders, no larger than the tasks that run at one time,
share the job's rate, and each sends its records in order through an injected
transport inside ``mapInPandas``. Throttle state (3 x 429 since the last 200 ->
slower rate, sticky) lives per sender; the throttled rate is shared out like
the full one. Results are log events as well (``ts``, ``log_id``), so the
failure log and the status updates are appended to the log store and read by
the log and status operators.

Delivery is at least once: a task that is run again sends its records again.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    DELIVERY_429_PAUSE_S, DELIVERY_BACKOFF_BASE_S, DELIVERY_DEFAULT_RATE, DELIVERY_JITTER,
    DELIVERY_MAX_ATTEMPTS, DELIVERY_RESPONSE_TEXT_CHARS, DELIVERY_THROTTLE_AFTER_429,
    DELIVERY_THROTTLED_RATE, ETA_MIN_SAMPLES, ETA_WINDOW, LOG_EXCEPTION_MESSAGE, LOG_FAILURE_MESSAGE,
    PROGRESS_BASE, PROGRESS_SPAN, STATUS_SENDING_MESSAGE,
)
from ..session import ship

RESULT_SCHEMA = ("job_id string, record_number long, ok boolean, status_code int, attempts int, "
                 "error_type string, response_text string, exception_type string, throttled boolean, "
                 "duration double, finished double")
RESULT_COLUMNS = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]

# transport(payload_json, record_number, attempt) -> (status_code, response_text)
Transport = Callable[[str, int, int], "tuple[int, str]"]


def http_transport(url: str, timeout: float = 30.0) -> Transport:
    """POST application/json; any HTTP status is returned, network errors raise."""
    def send(payload: str, record_number: int, attempt: int):
        req = urllib.request.Request(url, data=payload.encode("utf-8"), method="POST",
                                     headers={"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(req, timeout=timeout) as resp:  # noqa: S310
                return resp.status, resp.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
    return send


class _Sender:
    def __init__(self, transport: Transport, rate: float, max_attempts: int,
                 sleep: Callable[[float], None], rng: random.Random,
                 throttled_rate: float = DELIVERY_THROTTLED_RATE):
        self.transport, self.rate, self.max_attempts = transport, rate, max_attempts
        self.throttled_rate = throttled_rate
        self.sleep, self.rng = sleep, rng
        self.n429 = 0
        self.throttled = False

    def send(self, payload: str, rn: int):
        status, text, err, exc = None, None, None, None
        for attempt in range(self.max_attempts):
            last = attempt == self.max_attempts - 1
            try:
                status, text = self.transport(payload, rn, attempt)
                if status == 200:
                    self.n429 = 0
                    return True, status, attempt + 1, None, None, None
                if status == 429:
                    self.n429 += 1
                    if self.n429 >= DELIVERY_THROTTLE_AFTER_429 and not self.throttled:
                        self.throttled = True
                        self.rate = min(self.rate, self.throttled_rate)
                    err = "HTTP_429"
                    if not last:
                        self.sleep(DELIVERY_429_PAUSE_S)
                        continue
                    return False, status, attempt + 1, err, None, None
                err, exc = f"HTTP_{status}", None
            except Exception as e:  # noqa: BLE001 — transport failure is a result, not a crash
                status, text, err, exc = None, str(e), "EXCEPTION", type(e).__name__
            if not last:
                self.sleep((2 ** attempt) * DELIVERY_BACKOFF_BASE_S * self.rng.uniform(*DELIVERY_JITTER))
        if exc is None:
            text = (text or "")[:DELIVERY_RESPONSE_TEXT_CHARS] or None
        return False, status, self.max_attempts, err, text, exc


def deliver(payloads: DataFrame, job_id: str, transport_factory: Callable[[], Transport],
            rate: float = DELIVERY_DEFAULT_RATE, partitions: int | None = None,
            max_attempts: int = DELIVERY_MAX_ATTEMPTS, sleep: Callable[[float], None] | None = None,
            seed: int = 0, clock: Callable[[], float] | None = None) -> DataFrame:
    """Send every payload; returns one result row per record.

    ``payloads`` has (record_number, payload). ``partitions`` senders share
    ``rate`` (req/s); by default, and at most, as many as tasks run together,
    so that the budget is neither exceeded nor left unused. Sending happens
    when the result is evaluated: write or checkpoint it once (as
    ``plans.pipeline.deliver_job`` does) instead of evaluating it twice.
    """
    cores = payloads.sparkSession.sparkContext.defaultParallelism
    senders = max(1, min(int(partitions or cores), cores))
    src = payloads.select("record_number", "payload").repartition(senders, "record_number")
    own_rate, own_throttled = float(rate) / senders, float(DELIVERY_THROTTLED_RATE) / senders
    do_sleep = sleep if sleep is not None else time.sleep
    now = clock if clock is not None else time.time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        sender = _Sender(transport_factory(), own_rate, max_attempts, do_sleep, random.Random(seed + pid), own_throttled)
        for pdf in batches:
            out = []
            for rn, body in zip(pdf["record_number"].tolist(), pdf["payload"].tolist()):
                t0 = time.perf_counter()
                ok, status, attempts, err, text, exc = sender.send(body, int(rn))
                took = time.perf_counter() - t0  # send + retries, not the rate pause
                out.append((job_id, int(rn), ok, status, attempts, err, text, exc, sender.throttled, took, now()))
                do_sleep(1.0 / sender.rate if sender.rate > 0 else 0.0)
            yield pd.DataFrame(out, columns=RESULT_COLUMNS)

    ship(src.sparkSession)
    return src.sortWithinPartitions("record_number").mapInPandas(run, RESULT_SCHEMA)


def _event_time(ts=None):
    """UTC wall-clock time at which the record was done, as the log store keeps it."""
    if ts is not None:
        return F.lit(ts).cast("timestamp_ntz")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("finished").cast("decimal(18,6)"))


def failure_log(results: DataFrame, url: str = "", max_attempts: int = DELIVERY_MAX_ATTEMPTS,
                ts=None) -> DataFrame:
    """One ERROR log event per record whose final attempt failed (429 exhaustion is not logged).

    The rows have the log store's columns (``operators.logs.write_logs`` takes them as they are). ``log_id`` orders the
    events of a job; ``event_id`` is one event's alone in a store of many jobs and attempts.
    """
    failed = results.where(~F.col("ok") & (F.coalesce(F.col("status_code"), F.lit(0)) != 429))
    is_exc = F.col("error_type") == "EXCEPTION"
    msg = F.when(is_exc, F.format_string(LOG_EXCEPTION_MESSAGE, "record_number", F.lit(max_attempts), "response_text")) \
        .otherwise(F.format_string(LOG_FAILURE_MESSAGE, "record_number", F.lit(max_attempts), "status_code"))
    http = F.create_map(F.lit("status_code"), F.col("status_code").cast("string"),
                        F.lit("response_text"), F.col("response_text"), F.lit("webhook_url"), F.lit(url))
    raised = F.create_map(F.lit("exception_type"), F.col("exception_type"),
                          F.lit("exception_message"), F.col("response_text"), F.lit("webhook_url"), F.lit(url))
    at = _event_time(ts)
    event = F.sha2(F.concat_ws("\x1f", "job_id", F.col("record_number").cast("string"), at.cast("string")), 256)
    return failed.select(event.alias("event_id"), F.col("record_number").alias("log_id"), at.alias("ts"), "record_number", "job_id",
                         F.lit("ERROR").alias("level"), "error_type", "status_code", msg.alias("message"), "duration",
                         F.to_json(F.when(is_exc, raised).otherwise(http), {"ignoreNullFields": "false"}).alias("metadata"))


def delivery_status(results: DataFrame, rate: float = DELIVERY_DEFAULT_RATE, ts=None) -> DataFrame:
    """Per-record job-status updates from delivery results (W3 ETA, W4 progress, sent/total).

    The record number is the number of records sent, so no row needs a place
    among all of its job's; the last durations come from windows over blocks
    of record numbers (see ``operators.logs.recent``). The updates carry ``ts``
    and ``log_id``: ``operators.logs.status_merge`` folds them.
    """
    from .logs import recent

    totals = results.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    x = recent(results, "record_number", "duration", ETA_WINDOW).join(totals, "job_id")
    sent, total = F.col("record_number"), F.col("total")
    remaining = total - sent
    eta = F.when(sent >= ETA_MIN_SAMPLES, remaining * F.col("recent_mean")).otherwise(remaining / F.lit(float(rate)))
    progress = (F.lit(PROGRESS_BASE) + F.floor(sent / total * PROGRESS_SPAN)).cast("bigint")
    message = F.format_string(STATUS_SENDING_MESSAGE, sent, total)
    return x.select("job_id", "record_number", F.col("record_number").alias("log_id"), _event_time(ts).alias("ts"),
                    F.lit("processing").alias("status"), progress.alias("progress"), message.alias("message"),
                    eta.alias("estimated_seconds_remaining"), sent.cast("long").alias("webhooks_sent"),
                    total.cast("long").alias("webhooks_total"))
