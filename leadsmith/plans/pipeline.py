"""End-to-end cleaning plan: merged table -> standard, enriched, deduplicated leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.dedup import KEY, deduplicate
from ..operators.enrich import clean_domains, enrich
from ..operators.standardize import ROW, standardize


def clean_leads(merged: DataFrame, spec, table_type: str, record_limit: int | None = None,
                keep_internal: bool = False) -> DataFrame:
    """Phase 2 + Phase 3 as one lazy plan with one shuffle, on the dedup key.

    ``merged`` carries ``Source`` and a ``_row`` identity (see sources.csv_scan).
    The result is in dedup-key order only when a ``record_limit`` is requested
    (top-N by key, planned as TakeOrderedAndProject); otherwise order is free.
    """
    if table_type not in ("people", "company"):
        raise ValueError(f"table_type must be 'people' or 'company', got {table_type!r}")
    std = standardize(merged, spec, table_type)
    enriched = enrich(std)
    deduped = deduplicate(enriched, table_type, normalized=True)
    final = clean_domains(deduped)
    if record_limit is not None:
        final = final.orderBy(KEY).limit(int(record_limit))
    if not keep_internal:
        final = final.drop(ROW, "_n")
    return final


def output_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW, KEY, "_n") and not c.startswith("__")]


def display(df: DataFrame) -> DataFrame:
    """Drop internal columns (order key, row identity)."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in output_columns(df)])


# ---------------------------------------------------------------------------
# Files in -> processed CSV out (the process-and-download lifecycle)
# ---------------------------------------------------------------------------

class HeaderMapper:
    """Pluggable header mapper (U3): profile table -> mapping spec.

    The profile is metadata-sized (sources x columns); an external service can
    implement ``map_headers`` by sending it the kept columns and samples.
    """

    def map_headers(self, profile: DataFrame, table_type: str) -> dict:  # pragma: no cover - protocol
        raise NotImplementedError


class AliasHeaderMapper(HeaderMapper):
    """Deterministic default: alias dictionary match on the kept profile columns."""

    def map_headers(self, profile: DataFrame, table_type: str) -> dict:
        from ..operators.profile import alias_matches, mapped_spec_rows, spec_from_rows

        rows = mapped_spec_rows(alias_matches(profile, table_type)).collect()  # <= files x 17 x 3 rows
        if not rows:
            raise ValueError("no header could be mapped to the standard schema")
        return spec_from_rows(rows)


def process_files(spark, paths, table_type: str, output_dir: str, job_id: str = "job",
                  mapper: HeaderMapper | None = None, record_limit: int | None = None) -> dict:
    """Read CSV exports, map, clean, dedupe and write ``processed_<job_id>`` as CSV.

    Returns the output path, the mapping spec used and the written record count
    (counted by the write itself).
    """
    from ..operators.profile import column_profile
    from ..sources.csv_scan import file_headers, read_csv_files, write_csv

    if table_type not in ("people", "company"):
        raise ValueError(f"table_type must be 'people' or 'company', got {table_type!r}")
    merged = read_csv_files(spark, paths)
    profile = column_profile(merged, headers=file_headers(spark, paths))
    spec = (mapper or AliasHeaderMapper()).map_headers(profile, table_type)
    seen = Observation()
    final = clean_leads(merged, spec, table_type, record_limit=record_limit, keep_internal=True)
    final = final.observe(seen, F.count(F.lit(1)).alias("records"))
    out = f"{output_dir.rstrip('/')}/processed_{job_id}"
    write_csv(final, out)
    return {"path": out, "spec": spec, "records": seen.get["records"]}


def deliver_job(merged: DataFrame, spec, table_type: str, job_id: str, transport_factory,
                rate: float = 10.0, partitions: int | None = None, timestamp: int | None = None, sleep=None,
                log_path: str | None = None, status_path: str | None = None):
    """Process-and-deliver: clean, number, build payloads, send, and derive logs/status.

    Returns (results, failure_log, status_updates) DataFrames. Record numbers
    follow the dedup-key order of the cleaned table. With ``log_path`` the
    failures are appended to that log store, with ``status_path`` the status
    updates to that table. Sends are at least once: results are written when
    they are first evaluated and read from there, but a task that is run again
    sends again.
    """
    import time as _time

    from ..operators.delivery import deliver, delivery_status, failure_log
    from ..operators.logs import global_index, write_logs
    from ..operators.payload import number_emails, payloads

    final = clean_leads(merged, spec, table_type, keep_internal=True)
    if table_type == "company":
        final = number_emails(final)
    numbered = global_index(final, [KEY])
    pay = payloads(numbered, table_type, int(timestamp if timestamp is not None else _time.time()))
    results = deliver(pay, job_id, transport_factory, rate=rate, partitions=partitions, sleep=sleep)
    results = results.checkpoint(eager=True)
    failures, status = failure_log(results), delivery_status(results, rate)
    if log_path:
        write_logs(failures, log_path)
    if status_path:
        status.write.mode("append").parquet(status_path)
    return results, failures, status
