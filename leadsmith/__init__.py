"""leadsmith: lead-data cleaning and merging expressed as Spark plans.

Main entry points (imported lazily):

* ``read_csv_files(spark, paths)`` -- many CSV exports -> one all-string table
* ``clean_leads(merged, spec, table_type)`` -- standardise, enrich, deduplicate
* ``process_files(spark, paths, table_type, output_dir)`` -- files in, processed CSV out
* ``deliver_job(merged, spec, table_type, job_id, transport_factory)`` -- payloads to a receiver
* ``column_profile(merged)`` / ``AliasHeaderMapper`` -- header sample and default mapper
* ``register_sql_functions(spark)`` -- the cleaners as SQL functions
"""

__version__ = "0.1.0"

_EXPORTS = {
    "read_csv_files": "leadsmith.sources.csv_scan",
    "write_csv": "leadsmith.sources.csv_scan",
    "clean_leads": "leadsmith.plans.pipeline",
    "process_files": "leadsmith.plans.pipeline",
    "deliver_job": "leadsmith.plans.pipeline",
    "AliasHeaderMapper": "leadsmith.plans.pipeline",
    "HeaderMapper": "leadsmith.plans.pipeline",
    "column_profile": "leadsmith.operators.profile",
    "register_sql_functions": "leadsmith.functions.sql",
    "build_session": "leadsmith.session",
}


def __getattr__(name):
    if name in _EXPORTS:
        import importlib

        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)


__all__ = sorted(_EXPORTS)
