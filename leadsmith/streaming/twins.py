"""Structured Streaming twins of the batch operators.

Each twin reuses the batch transforms. Stateful merges are associative, so a
micro-batch only has to fold its partial aggregate into the keyed state:

* T1 lead ingest: row-local cleaning in the stream; per micro-batch the dedup
  partials are appended to a partial table keyed by batch id (idempotent on
  replay); the final table folds all partials.
* T2 rolling error counts: event-time watermark + 1-day tumbling windows, in
  update mode to files, so that closed windows leave the state.
* T3 job status: the (ts, id, value) of each job's and field's last update is
  keyed state, and the status is read from there.
* T4 delivery: ``foreachBatch`` runs the delivery sink on records that the
  keyed state has not seen; a replayed batch with results does nothing.
* T5 exactly-once log identity: ``dropDuplicatesWithinWatermark``.

Checkpoints and state live under ``spark.checkpoint.dir`` (shared storage on a
cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dedup as D
from ..operators.delivery import RESULT_SCHEMA, deliver
from ..operators.enrich import enrich
from ..operators.standardize import standardize
from ..session import ensure_checkpoint_dir
from ..sources.csv_scan import read_listed_files


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file stream over one table file or folder (a file is watched through its folder)."""
    schema = spark.read.parquet(path).schema
    folder, _, leaf = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if leaf.endswith(".parquet"):
        return reader.option("pathGlobFilter", leaf).parquet(folder)
    return reader.parquet(path)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# T1 -------------------------------------------------------------------------

def merge_partials(partials: DataFrame, cols: list[str]) -> DataFrame:
    """Fold appended partials (any number of batches) into final merged records."""
    return D.merged_rows(partials.groupBy(D.KEY).agg(*D.fold_aggs(cols)), cols)


#: What the stream of a folder's files gives; their content is not read there.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _file_ordinals(spark: SparkSession, path: str, arrival: int, names: list[str]) -> DataFrame:
    """(__path, __file_ord) of the files named: numbers that no other arrival's files have, by file name.

    They are kept in ``path`` by arrival once the batch is folded, so that a replayed batch takes the place of its first run.
    """
    base = 0
    if _exists(spark, path):
        given = spark.read.schema("__path string, __file_ord bigint, arrival bigint").parquet(path)
        last = given.where(F.col("arrival") != arrival).agg(F.max("__file_ord")).first()[0]
        base = 0 if last is None else last + 1
    files = sorted(names, key=lambda p: (p.rsplit("/", 1)[-1], p))
    return spark.createDataFrame([(p, base + i) for i, p in enumerate(files)], "__path string, __file_ord bigint")


def stream_clean_csv(spark: SparkSession, inputs: list[tuple[str, list[str]]], spec, table_type: str,
                     state_dir: str | None = None) -> tuple[str, list[str]]:
    """Clean CSV files as they arrive; returns (partials path, output columns).

    The streams bring the names and lengths of the files; each micro-batch reads its files as the CSV source does, the large
    ones by many tasks.

    ``inputs`` lists (folder, file name pattern) by header: (path pattern, headers). Each header has a stream of its own
    (a stream has one schema); all of them append partials to one table, over the union of the columns. Call
    ``read_stream_result`` on the partials path for the result.

    Rows are numbered per file, as the CSV source numbers them: the file's ordinal in the high bits, the position in the low
    ones. Files get their ordinals in the order in which they come, those of one micro-batch by name; ordinals given are kept
    in the state folder.
    """
    state_dir = state_dir or run_dir(spark, "stream-ingest")
    columns = list(dict.fromkeys(h for _, headers in inputs for h in headers if h != "Source"))
    partial_path = f"{state_dir}/partials"

    def clean(rows: DataFrame) -> DataFrame:
        return enrich(standardize(rows, spec, table_type))

    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "Source"]]))
    out_cols = clean(empty.withColumn(D.ROW, F.lit(0).cast("bigint"))).columns
    out_cols.remove(D.ROW)

    def start(number: int, pattern: str, headers: list[str]):
        folder, _, leaf = pattern.rpartition("/")
        files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", leaf).load(folder)
                 .select("path", "length"))

        def fold(batch: DataFrame, batch_id: int):
            arrival = int(batch_id) * len(inputs) + number
            # file listing: metadata, one row per file; a stream may name a file more than once in a batch
            listing = [(r["path"], r["length"]) for r in batch.groupBy("path").agg(F.max("length").alias("length")).collect()]
            if not listing:
                return
            ords = _file_ordinals(spark, f"{state_dir}/files", arrival, [path for path, _ in listing])
            rows = read_listed_files(spark, listing, headers, columns, F.broadcast(ords))
            part = D.with_key(clean(rows), table_type).groupBy(D.KEY).agg(*D.partial_aggs(out_cols))
            part.write.mode("overwrite").parquet(f"{partial_path}/batch_id={arrival}")
            ords.coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/files/arrival={arrival}")

        return (files.writeStream.foreachBatch(fold).trigger(availableNow=True)
                .option("checkpointLocation", f"{state_dir}/checkpoint-{number}").start())

    for number, (pattern, headers) in enumerate(inputs):
        start(number, pattern, headers).awaitTermination()
    return partial_path, out_cols


def read_stream_result(spark: SparkSession, partial_path: str, cols: list[str]) -> DataFrame:
    from ..operators.enrich import clean_domains

    parts = spark.read.parquet(partial_path)
    return clean_domains(merge_partials(parts, cols))


# T2 -------------------------------------------------------------------------

def stream_error_counts(spark: SparkSession, events_path: str, logs_transform, watermark: str = "7 days",
                        state_dir: str | None = None) -> DataFrame:
    """1-day tumbling error counts by error_type with a 7-day watermark."""
    state_dir = state_dir or run_dir(spark, "stream-errors")
    ev = file_stream(spark, events_path)
    lg = logs_transform(ev).withColumn("event_time", F.col("ts").cast("timestamp"))
    err = lg.where(F.col("level") == "ERROR").withWatermark("event_time", watermark)
    agg = err.groupBy(F.window("event_time", "1 day").alias("w"),
                      F.coalesce("error_type", F.lit("UNKNOWN")).alias("error_type")).count()
    path = f"{state_dir}/counts"

    def keep(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")

    q = (agg.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    # update mode: a window's last count stands in the last batch that touched it
    last = spark.read.parquet(path).groupBy("w", "error_type").agg(F.max_by("count", "batch_id").alias("n"))
    return last.select(F.to_date(F.col("w.start")).alias("day"), "error_type", F.col("n").cast("bigint").alias("n"))


# T3 -------------------------------------------------------------------------

#: Keyed state lives in RocksDB, on disk, with small files; its provider takes part in every checkpoint.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
}


@contextmanager
def keyed_state(spark: SparkSession):
    """The session's settings for queries with keyed state, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in KEYED_STATE}
    try:
        for k, v in KEYED_STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_status(spark: SparkSession, events_path: str, updates_transform, fields,
                  state_dir: str | None = None) -> DataFrame:
    """Partial status updates folded into the current status per job.

    The state holds, by job and field, the (ts, id, value) of the field's last update, and nothing else is written: it has
    one row per job and field however many updates and batches there were. The status is read from the state.
    """
    state_dir = state_dir or run_dir(spark, "stream-status")
    upd = updates_transform(file_stream(spark, events_path))
    at = [F.col("ts").alias("ts"), F.col("log_id").alias("id")]
    cells = [F.struct(F.lit(f).alias("field"), F.struct(*at, F.col(f).cast("string").alias("v")).alias("last")) for f in fields]
    # the field without a name stands for the update itself: its first and last time are the job's
    cells.append(F.struct(F.lit("").alias("field"), F.struct(*at, F.lit("").alias("v")).alias("last")))
    rows = upd.select("job_id", F.explode(F.array(*cells)).alias("c")).where(F.col("c")["last"]["v"].isNotNull())
    folded = rows.groupBy("job_id", F.col("c.field").alias("field")).agg(F.max("c.last").alias("last"), F.min("c.last.ts").alias("first"))
    with keyed_state(spark):
        q = (folded.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
             .option("checkpointLocation", f"{state_dir}/checkpoint").start())
        q.awaitTermination()
    return status_from_state(spark, f"{state_dir}/checkpoint", fields)


def status_from_state(spark: SparkSession, checkpoint: str, fields) -> DataFrame:
    """The status per job as the state of ``stream_status`` has it."""
    state = spark.read.format("statestore").load(checkpoint)
    key, value = (state.schema[c].dataType.fieldNames() for c in ("key", "value"))
    flat = state.select(F.col("key")[key[0]].alias("job_id"), F.col("key")[key[1]].alias("field"),
                        F.col("value")[value[0]].alias("last"), F.col("value")[value[1]].alias("first"))
    parts = [F.max(F.when(F.col("field") == f, F.col("last")["v"])).alias(f) for f in fields]
    whole = F.col("field") == ""
    return flat.groupBy("job_id").agg(*parts, F.min(F.when(whole, F.col("first"))).alias("created_at"),
                                      F.max(F.when(whole, F.col("last")["ts"])).alias("updated_at")).select(
        "job_id", *fields, "created_at", "updated_at")


# T4 -------------------------------------------------------------------------

def stream_delivery(spark: SparkSession, payload_stream: DataFrame, job_id: str, transport_factory,
                    rate: float, sleep=None, state_dir: str | None = None) -> DataFrame:
    """T4: deliver each micro-batch; results keyed by (job_id, record_number), one folder per batch.

    Record numbers that came before are known from the stream's keyed state, in the checkpoint of this job, so no batch
    reads the results of others. A batch that is played again sends nothing if its results are written; if they are not, it
    sends all its records again (at least once).
    """
    state_dir = state_dir or run_dir(spark, "stream-delivery")
    path = f"{state_dir}/job={quote(job_id, safe='')}"

    def send(batch: DataFrame, batch_id: int):
        folder = f"{path}/results/batch_id={int(batch_id)}"
        if not _exists(spark, f"{folder}/_SUCCESS"):
            deliver(batch, job_id, transport_factory, rate=rate, sleep=sleep).write.mode("overwrite").parquet(folder)

    with keyed_state(spark):
        q = (payload_stream.dropDuplicates(["record_number"]).writeStream.foreachBatch(send).trigger(availableNow=True)
             .option("checkpointLocation", f"{path}/checkpoint").start())
        q.awaitTermination()
    return spark.read.schema(f"{RESULT_SCHEMA}, batch_id int").parquet(f"{path}/results")


# T5 -------------------------------------------------------------------------

def stream_dedup_events(spark: SparkSession, events_path: str, logs_transform, key: str = "log_id",
                        watermark: str = "1 hour", state_dir: str | None = None) -> DataFrame:
    """T5: one row per event id within the watermark (late replays are dropped).

    A store that several jobs write to needs a key over all of them: the failure log's is ``event_id``.
    """
    state_dir = state_dir or run_dir(spark, "stream-dedup")
    ev = file_stream(spark, events_path)
    lg = logs_transform(ev).withColumn("event_time", F.col("ts").cast("timestamp"))
    once = lg.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])
    path = f"{state_dir}/events"
    q = (once.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)
