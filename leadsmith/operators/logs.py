"""Structured logs and job status as ordinary tables.

Log events: (log_id, ts, record_number, job_id, level, error_type, status_code,
message, duration, metadata).

One job may hold most events, so no window takes a job's events as its
partition. What runs along a job is folded in two steps: each hour of a job
first becomes one row that says what it does to any state before it (its count,
its 429s before and after a 200, its first and last run), and windows along the job go over these rows only. Throttle events and stuck
jobs read their input once and never join it back; numbering and ETA join the
hours' rows to the events. Values along record numbers work on blocks of
``BLOCK`` numbers, whose last rows are copied to the next block (``recent``).
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    DELIVERY_DEFAULT_RATE, ETA_MIN_SAMPLES, ETA_WINDOW, LOG_DEFAULT_LIMIT,
    LOG_RETENTION_DAYS, PROGRESS_BASE, PROGRESS_SPAN, STUCK_ALERT_S,
    STUCK_MIN_POLLS, STUCK_WARN_S,
)

ORDER = ["ts", "log_id"]


def _ts(s) -> Column:
    return F.lit(s).cast("timestamp_ntz") if isinstance(s, str) else F.lit(s)


# F10 ------------------------------------------------------------------------

def resolve_start(spec: str | None, as_of: datetime) -> datetime:
    """Relative start bound: today, yesterday, Nd, Nh, ISO text; default 7 days back."""
    if not spec:
        return as_of - timedelta(days=LOG_RETENTION_DAYS)
    if spec == "today":
        return as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if spec == "yesterday":
        return (as_of - timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
    m = re.fullmatch(r"(-?\d+)([dh])", spec)
    if m:
        n = int(m.group(1))
        return as_of - (timedelta(days=n) if m.group(2) == "d" else timedelta(hours=n))
    return datetime.fromisoformat(spec.replace("Z", "+00:00")).replace(tzinfo=None)


# F9 -------------------------------------------------------------------------

def write_logs(events: DataFrame, path: str) -> str:
    """S13 store: append log events as parquet partitioned by event date.

    Expects the log columns (``ts`` is the event time); ``level`` is upper-cased
    on the way in. Queries with a time range then prune whole date partitions.
    """
    out = events.withColumn("level", F.upper("level")).withColumn("date", F.to_date("ts"))
    out.write.mode("append").partitionBy("date").parquet(path)
    return path


def read_logs(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _log_filter(logs: DataFrame, start, end, job_id=None, level=None, error_type=None) -> Column:
    cond = F.col("ts").between(_ts(start), _ts(end))
    if "date" in logs.columns:  # date-partitioned store: prune partitions outside the range
        cond &= F.col("date").between(F.to_date(_ts(start)), F.to_date(_ts(end)))
    if job_id is not None:
        cond &= F.col("job_id") == job_id
    if level is not None:
        cond &= F.col("level") == level.upper()
    if error_type is not None:
        cond &= F.col("error_type") == error_type
    return cond


def query_logs(logs: DataFrame, start=None, end=None, job_id=None, level=None, error_type=None,
               limit: int | None = LOG_DEFAULT_LIMIT, as_of: datetime | None = None) -> DataFrame:
    """Inclusive time range, all given filters ANDed, newest first, top ``limit``."""
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    end = end or as_of
    start = start or (end - timedelta(days=LOG_RETENTION_DAYS))
    out = logs.where(_log_filter(logs, start, end, job_id, level, error_type))
    if limit is not None:
        out = out.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(int(limit))
    return out


def stored_dates(spark, path: str) -> list[date]:
    """Dates that a log store has a partition of, oldest first: one listing of the store's folder, no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(date.fromisoformat(n[5:]) for n in names if re.fullmatch(r"date=\d{4}-\d\d-\d\d", n))


def newest_logs(spark, path: str, start=None, end=None, job_id=None, level=None, error_type=None,
                limit: int = LOG_DEFAULT_LIMIT, as_of: datetime | None = None) -> DataFrame:
    """L2 over a date-partitioned store of any age: the rows of ``query_logs``, from as few dates as hold them.

    Of the dates in the range, the newest 1, 2, 4, ... are counted, each up to ``limit`` rows, until they hold that many;
    only these are sorted. Every row of a later date is newer than all of an earlier one, so no other date can add a row.
    """
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    end = end or as_of
    start = start or (end - timedelta(days=LOG_RETENTION_DAYS))
    logs = read_logs(spark, path)
    matching = logs.where(_log_filter(logs, start, end, job_id, level, error_type))
    bound = lambda t: datetime.fromisoformat(t).date() if isinstance(t, str) else t.date()
    dates = [d for d in stored_dates(spark, path) if bound(start) <= d <= bound(end)]
    taken, found = 0, matching.where(F.lit(False))
    while taken < len(dates):
        taken = min(max(2 * taken, 1), len(dates))
        found = matching.where(F.col("date") >= F.lit(dates[-taken]))
        if taken < len(dates) and found.limit(int(limit)).count() >= limit:
            break
    return found.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(int(limit))


def retained(logs: DataFrame, as_of, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    """entries no older than the retention period."""
    return logs.where(F.col("ts") >= _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def older_than(df: DataFrame, ts_col: str, as_of, hours: float) -> DataFrame:
    """rows whose timestamp is older than as_of - hours."""
    return df.where(F.col(ts_col) < _ts(as_of) - F.make_dt_interval(secs=F.lit(float(hours) * 3600)))


# A9 / A12 / A14 -------------------------------------------------------------

def error_summary(logs: DataFrame) -> DataFrame:
    """Count of ERROR events by error_type (null -> UNKNOWN) plus a TOTAL row (rollup)."""
    err = logs.where(F.col("level") == "ERROR").select(F.coalesce("error_type", F.lit("UNKNOWN")).alias("error_type"))
    r = err.rollup("error_type").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("error_type", F.lit("TOTAL")).alias("error_type"), F.col("n").cast("bigint").alias("n"))


def delivery_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("job_id").agg(
        F.count_if(F.col("status_code") == 200).cast("bigint").alias("success"),
        F.count_if(F.col("status_code") != 200).cast("bigint").alias("failed"),
    )


def daily_errors(logs: DataFrame) -> DataFrame:
    """Batch twin of the streaming rolling error count: per day and error_type."""
    err = logs.where(F.col("level") == "ERROR")
    return err.groupBy(F.to_date("ts").alias("day"), F.coalesce("error_type", F.lit("UNKNOWN")).alias("error_type")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# W2-W4 ----------------------------------------------------------------------

BLOCK = 10_000


HOUR = "__hour"


def _hourly(logs: DataFrame) -> DataFrame:
    return logs.withColumn(HOUR, F.date_trunc("hour", "ts"))


def _within_hour() -> Window:
    return Window.partitionBy("job_id", HOUR).orderBy(*ORDER)


def _along_job(last: int = -1, first: int = Window.unboundedPreceding) -> Window:
    """A window over a job's hours (one row each), by default all before this one."""
    return Window.partitionBy("job_id").orderBy(HOUR).rowsBetween(first, last)


def with_job_sequence(logs: DataFrame) -> DataFrame:
    """1-based record number per job, plus the job's total."""
    x = _hourly(logs)
    hours = x.groupBy("job_id", HOUR).agg(F.count(F.lit(1)).alias("__n"))
    off = hours.withColumn("__before", F.sum("__n").over(_along_job())) \
        .withColumn("total", F.sum("__n").over(Window.partitionBy("job_id")))
    x = x.join(off.select("job_id", HOUR, "__before", "total"), ["job_id", HOUR])
    seq = F.row_number().over(_within_hour())
    return x.withColumn("seq", seq + F.coalesce("__before", F.lit(0))).drop(HOUR, "__before")


def _block(seq: str = "seq"):
    return F.floor((F.col(seq) - 1) / BLOCK)


def _overlapping(df: DataFrame, rows: int, seq: str) -> DataFrame:
    """Every row in its block, and the last ``rows`` of each block once more, as ``__copy``, in the next one."""
    last = (F.col(seq) - 1) % BLOCK >= BLOCK - rows
    copies = F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = df.withColumn("__ahead", F.explode(copies))
    return x.withColumn("__block", _block(seq) + F.col("__ahead")).withColumn("__copy", F.col("__ahead") == 1).drop("__ahead")


def recent(df: DataFrame, seq: str, value: str, n: int, unit: int | None = None) -> DataFrame:
    """``recent_mean``: the mean of ``value`` over the job's last ``n`` rows up to this one.

    ``unit`` sums whole units (hundredths for 100), which makes the mean independent of the order of addition.
    """
    w = Window.partitionBy("job_id", "__block").orderBy(seq).rowsBetween(-(n - 1), 0)
    x = _overlapping(df, n - 1, seq)
    if unit is None:
        mean = F.avg(value).over(w)
    else:
        mean = F.sum(F.round(F.col(value) * unit).cast("bigint")).over(w) / F.count(F.lit(1)).over(w) / F.lit(float(unit))
    return x.withColumn("recent_mean", mean).where(~F.col("__copy")).drop("__block", "__copy")


def delivery_eta(seq: DataFrame, rate: float = DELIVERY_DEFAULT_RATE) -> DataFrame:
    """Mean of the last 10 durations x remaining (>= 3 samples), else remaining / rate."""
    remaining = F.col("total") - F.col("seq")
    x = _overlapping(seq, ETA_WINDOW - 1, "seq")
    w = Window.partitionBy("job_id", "__block").orderBy("seq").rowsBetween(-(ETA_WINDOW - 1), 0)
    # mean in integer hundredths (durations carry two decimals), so the value is exact and order-free
    cents = F.sum(F.round(F.col("duration") * 100).cast("bigint")).over(w)
    x = x.withColumn("__cents", cents).withColumn("__k", F.count(F.lit(1)).over(w)).where(~F.col("__copy"))
    mean_x_remaining = remaining * F.col("__cents") / F.col("__k") / F.lit(100.0)
    eta = F.when(F.col("seq") >= ETA_MIN_SAMPLES, mean_x_remaining).otherwise(remaining / F.lit(float(rate)))
    return x.select("job_id", "log_id", "seq", eta.alias("eta_seconds"))


def delivery_progress(seq: DataFrame) -> DataFrame:
    """80 + int(sent / total * 20)."""
    p = F.lit(PROGRESS_BASE) + F.floor(F.col("seq") / F.col("total") * PROGRESS_SPAN)
    return seq.select("job_id", "log_id", "seq", p.cast("bigint").alias("progress"))


# W5 / J5 --------------------------------------------------------------------

STATUS_FIELDS = ["status", "progress", "message"]


def status_merge(updates: DataFrame, fields=STATUS_FIELDS) -> DataFrame:
    """Per job, each field's latest non-null value (last write wins, absent fields persist)."""
    order = F.struct("ts", "log_id")
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return updates.groupBy("job_id").agg(*aggs, F.max("ts").alias("updated_at"),
                                         F.min("ts").alias("created_at"))


def status_lookup(status: DataFrame, job_id: str) -> DataFrame:
    return status.where(F.col("job_id") == job_id)


def recent_jobs(status: DataFrame, n: int = 20) -> DataFrame:
    """L3: most recent jobs by created_at (top-k)."""
    return status.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(n)


# W6 -------------------------------------------------------------------------

def _seconds(c: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def stuck_jobs(updates: DataFrame, min_polls: int = STUCK_MIN_POLLS,
               warn_s: int = STUCK_WARN_S, alert_s: int = STUCK_ALERT_S) -> DataFrame:
    """Runs of unchanged progress (< 100) seen again more than min_polls times; warn/alert by duration.

    Runs are cut within hours. Only an hour's first run can go on with the run before it and only its last can go on
    after it, so those two, and the runs that are stuck by themselves, are all that is looked at along the job.
    """
    changed = F.when(F.lag("progress").over(_within_hour()) == F.col("progress"), 0).otherwise(1)
    x = _hourly(updates).select("job_id", HOUR, *ORDER, "progress", changed.alias("__new"))
    x = x.withColumn("__run", F.sum("__new").over(_within_hour().rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("job_id", HOUR, "__run").agg(
        F.min("progress").alias("progress"), F.count(F.lit(1)).alias("__n"), F.min("ts").alias("since"), F.max("ts").alias("until"))
    last = F.max("__run").over(Window.partitionBy("job_id", HOUR))
    stuck = (F.col("progress") < 100) & (F.col("__n") - 1 > min_polls) & (_seconds("until") - _seconds("since") > warn_s)
    runs = runs.withColumn("__last", last).where((F.col("__run") == 1) | (F.col("__run") == F.col("__last")) | stuck)
    along = Window.partitionBy("job_id").orderBy(HOUR, "__run")
    goes_on = (F.col("__run") == 1) & (F.lag("progress").over(along) == F.col("progress"))
    runs = runs.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    runs = runs.withColumn("island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("job_id", "island").agg(
        F.min("progress").alias("progress"), (F.sum("__n") - 1).alias("polls"), F.min("since").alias("since"), F.max("until").alias("until"))
    secs = _seconds("until") - _seconds("since")
    runs = runs.where((F.col("progress") < 100) & (F.col("polls") > min_polls)).withColumn("stuck_seconds", secs)
    sev = F.when(F.col("stuck_seconds") > alert_s, "alert").when(F.col("stuck_seconds") > warn_s, "warn")
    return runs.select("job_id", "progress", F.col("polls").cast("bigint").alias("polls"),
                       F.col("stuck_seconds").cast("bigint").alias("stuck_seconds"), sev.alias("severity")) \
        .where(F.col("severity").isNotNull())


# W7 -------------------------------------------------------------------------

def throttle_events(logs: DataFrame, after: int = 3) -> DataFrame:
    """First event per job where >= `after` 429s occurred since the last 200 (sticky).

    Each hour says where it gets there by itself behind a 200 (``__n_hit``), where it does so if 1, 2, ... more 429s are needed
    while no 200 came yet (``__n_need``), and how many 429s it leaves; along the job, only hours are added up.
    """
    here = _within_hour().rowsBetween(Window.unboundedPreceding, 0)
    x = _hourly(logs).select("job_id", HOUR, *ORDER, "status_code")
    x = x.withColumn("__count", F.sum(F.when(F.col("status_code") == 429, 1).otherwise(0)).over(here))
    # the 429s counted when the last 200 came in: counts only grow, so that is the largest one at a 200
    x = x.withColumn("__at200", F.max(F.when(F.col("status_code") == 200, F.col("__count"))).over(here))
    since = F.col("__count") - F.coalesce("__at200", F.lit(0))
    place, fresh = F.struct(*ORDER), F.col("__at200").isNull()
    needs = [F.min(F.when(fresh & (since >= k), place)) for k in range(1, after + 1)]
    hours = x.groupBy("job_id", HOUR).agg(
        F.min(F.when(~fresh & (since >= after), place)).alias("__n_hit"), F.array(*needs).alias("__n_need"),
        F.max_by(since, place).alias("__n_left"), F.max(~fresh).alias("__n_reset"))
    # 429s since the last 200, up to the hour's start: all that were left before, less those left before the last reset
    hours = hours.withColumn("__n_all", F.coalesce(F.sum("__n_left").over(_along_job()), F.lit(0)))
    hours = hours.withColumn("__n_mark", F.when(F.col("__n_reset"), F.col("__n_all")))
    hours = hours.withColumn("__n_carry", F.col("__n_all") - F.coalesce(F.max("__n_mark").over(_along_job()), F.lit(0)))
    need = F.get("__n_need", (F.lit(after - 1) - F.col("__n_carry")).cast("int"))  # null once the carry is enough: an earlier hour hit
    hit = hours.select("job_id", F.least(F.when(F.col("__n_carry") < after, need), "__n_hit").alias("hit")).where("hit is not null")
    first = hit.groupBy("job_id").agg(F.min("hit").alias("hit"))
    return first.select("job_id", F.col("hit.log_id").alias("first_throttled_log_id"), F.col("hit.ts").alias("throttled_at"))


# X19 ------------------------------------------------------------------------

def iso_and_unix(ts: Column) -> tuple[Column, Column]:
    """UTC ISO text (Python isoformat, microseconds only when non-zero) and epoch seconds.

    ``ts`` is a UTC wall-clock TIMESTAMP_NTZ; nothing here depends on the session time zone.
    """
    frac = F.date_format(ts, "SSSSSS")
    iso = F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return iso, epoch


def global_index(df: DataFrame, order_cols: list[str], name: str = "record_number") -> DataFrame:
    """1-based position in a global order without a single-task window.

    Range-partition + sort within partitions, count rows per partition (a
    partitions-sized table), prefix-sum the counts, then add the offset.
    """
    from ..sources.csv_scan import with_partition_offsets

    srt = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return with_partition_offsets(srt, name)
