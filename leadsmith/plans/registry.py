"""Registered queries (Spark) and their DuckDB oracles, keyed by check name.

Every query reads the driver tables (or fixtures Spark derives from them), so
its work grows with the data. ``ORACLE`` holds the DuckDB twin of each
SQL-expressible query; the rest are checked rows-only plus unit tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.columns import C
from ..operators import dedup, enrich as E, standardize as S
from ..sources import fixtures as FX
from . import oracle as O
from .pipeline import clean_leads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

P_COLS = ["row_idx", "source", "person_key", "full_name", "first_name", "last_name", "job_title", "linkedin",
          "work_email", "personal_email", "email_2", "company_name", "website", "employees", "founded", "city"]
C_COLS = ["row_idx", "source", "company_name", "domain_url", "linkedin_account", "emails", "employee_count",
          "founded", "hq"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _out(df: DataFrame, extra=()) -> DataFrame:
    keep = [c for c in df.columns if c not in ("_row", "_key", "_n") and not c.startswith("__")]
    return df.select(*[C(c) for c in keep], *extra)


# ---------------------------------------------------------------------------
# Whole pipeline
# ---------------------------------------------------------------------------

def _people_clean(spark, sf):
    return clean_leads(FX.people_raw(spark, sf), FX.PEOPLE_SPEC, "people", keep_internal=True)


def _company_clean(spark, sf):
    return clean_leads(FX.company_raw(spark, sf), FX.COMPANY_SPEC, "company", keep_internal=True)


def _final_sql(fixture, cols, spec, tt, tail="select * exclude (_row, _n) from {prev}"):
    return O.clean_leads_sql(fixture, cols, spec, tt, tail)


@register("dedup_merge_people", _final_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people"))
def q_dedup_merge_people(spark, sf):
    return _out(_people_clean(spark, sf), [F.col("_key")])


@register("dedup_merge_company", _final_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company"))
def q_dedup_merge_company(spark, sf):
    return _out(_company_clean(spark, sf), [F.col("_key")])


# ---------------------------------------------------------------------------
# Phase 2
# ---------------------------------------------------------------------------

def _std_sql(fixture, cols, spec, tt, consolidate=True):
    ch = O.raw_chain(fixture, cols)
    O.standardize_step(ch, spec, tt, consolidate)
    return ch.sql("select * from {prev}")


@register("standardize_people", _std_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people"))
def q_standardize_people(spark, sf):
    return S.standardize(FX.people_raw(spark, sf), FX.PEOPLE_SPEC, "people")


@register("standardize_company", _std_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company"))
def q_standardize_company(spark, sf):
    return S.standardize(FX.company_raw(spark, sf), FX.COMPANY_SPEC, "company")


# ---------------------------------------------------------------------------
# Scalar functions on driver tables
# ---------------------------------------------------------------------------

@register("clean_domain", f"select page_id, url, {O.clean_domain('url')} as domain from pages")
def q_clean_domain(spark, sf):
    p = FX.table(spark, sf, "pages")
    return p.select("page_id", "url", X.clean_domain(F.col("url")).alias("domain"))


@register("company_name_gen",
          f"select page_id, {O.company_name_from_domain(O.clean_domain('url'))} as company_name from pages")
def q_company_name_gen(spark, sf):
    p = FX.table(spark, sf, "pages")
    return p.select("page_id", X.company_name_from_domain(X.clean_domain(F.col("url"))).alias("company_name"))



# ---------------------------------------------------------------------------
# Phase 2 / 3 single operators on fixture P and C
# ---------------------------------------------------------------------------

from ..functions.constants import NA_TOKENS, PERSONAL_RANKS  # noqa: E402
from ..operators import payload as PL  # noqa: E402


def _p_std(spark, sf):
    return S.standardize(FX.people_raw(spark, sf), FX.PEOPLE_SPEC, "people")


def _c_std(spark, sf):
    return S.standardize(FX.company_raw(spark, sf), FX.COMPANY_SPEC, "company")


def _chain_sql(fixture, cols, spec, tt, steps, final):
    ch = O.raw_chain(fixture, cols)
    O.standardize_step(ch, spec, tt)
    for st in steps:
        st(ch)
    return ch.sql(final)


def _p_chain(steps, final):
    return _chain_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people", steps, final)


def _c_chain(steps, final):
    return _chain_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company", steps, final)


_P_RAW = f"(select {', '.join(f'cast({O.q(c)} as varchar) as {O.q(c)}' for c in P_COLS[2:])}, source, row_idx from ({FX.PEOPLE_SQL}))"
_C_RAW = f"(select {', '.join(f'cast({O.q(c)} as varchar) as {O.q(c)}' for c in C_COLS[2:])}, source, row_idx from ({FX.COMPANY_SQL}))"


@register("na_tokens", "select row_idx as _row, " + ", ".join(
    f"case when {O.q(c)} in {O.inlist(NA_TOKENS)} then null else {O.q(c)} end as {O.q(c)}" for c in P_COLS[2:])
    + f" from {_P_RAW}")
def q_na_tokens(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row", *[X.na_token_to_null(C(c), NA_TOKENS).alias(c) for c in P_COLS[2:]])


_UB_B = ["full_name", "work_email", "city", "job_title"]


@register("union_by_name",
          "select row_idx as _row, source as \"Source\", " + ", ".join(O.q(c) for c in P_COLS[2:])
          + f" from {_P_RAW} where source = 'crm_a.csv' union all select row_idx, source, "
          + ", ".join(O.q(c) if c in _UB_B else "null" for c in P_COLS[2:])
          + f" from {_P_RAW} where source = 'crm_b.csv'")
def q_union_by_name(spark, sf):
    p = FX.people_raw(spark, sf)
    a = p.where(C("Source") == "crm_a.csv").select("_row", "Source", *P_COLS[2:])
    b = p.where(C("Source") == "crm_b.csv").select("_row", "Source", *reversed(_UB_B))
    return a.unionByName(b, allowMissingColumns=True)


@register("priority_coalesce", _p_chain([], 'select _row, "Work Email" from {prev}'))
def q_priority_coalesce(spark, sf):
    p = FX.people_raw(spark, sf)
    m = S.plan_mappings(FX.PEOPLE_SPEC)
    return p.select("_row", S.priority_coalesce(p.columns, m["Work Email"]).alias("Work Email"))


_UNMAPPED_SPEC = {"mapped_files": [{"filename": "crm_a.csv", "mapped_headers": {
    k: v for k, v in FX.PEOPLE_SPEC["mapped_files"][0]["mapped_headers"].items() if k != "Person Location"}}]}
_P_RENAMED_SQL = ("select " + ", ".join(O.q(c) if c != "city" else 'city as "Company Location"' for c in P_COLS)
                  + f" from ({FX.PEOPLE_SQL})")
_P_RENAMED_COLS = [c if c != "city" else "Company Location" for c in P_COLS]


@register("unmapped_preserve", _chain_sql(_P_RENAMED_SQL, _P_RENAMED_COLS, _UNMAPPED_SPEC, "people", [],
                                          "select * from {prev}"))
def q_unmapped_preserve(spark, sf):
    p = FX.people_raw(spark, sf).withColumnRenamed("city", "Company Location")
    return S.standardize(p, _UNMAPPED_SPEC, "people")


_LI_SPEC = {"mapped_files": [{"filename": "crm_a.csv", "mapped_headers": {
    k: v for k, v in FX.PEOPLE_SPEC["mapped_files"][0]["mapped_headers"].items() if k != "LinkedIn Profile"}}]}
_P_LI_SQL = ("select " + ", ".join(O.q(c) if c != "linkedin" else 'linkedin as "Linkedin URL"' for c in P_COLS)
             + f" from ({FX.PEOPLE_SQL})")
_P_LI_COLS = [c if c != "linkedin" else "Linkedin URL" for c in P_COLS]


@register("consolidate_people", _chain_sql(_P_LI_SQL, _P_LI_COLS, _LI_SPEC, "people", [], "select * from {prev}"))
def q_consolidate_people(spark, sf):
    p = FX.people_raw(spark, sf).withColumnRenamed("linkedin", "Linkedin URL")
    return S.consolidate_variants(S.standardize(p, _LI_SPEC, "people", consolidate=False), "people")


@register("consolidate_company", _c_chain([], "select * from {prev}"))
def q_consolidate_company(spark, sf):
    c = FX.company_raw(spark, sf)
    return S.consolidate_variants(S.standardize(c, FX.COMPANY_SPEC, "company", consolidate=False), "company")


@register("split_names", _p_chain([O.split_step], 'select _row, "Full Name", "First Name", "Last Name" from {prev}'))
def q_split_names(spark, sf):
    return E.split_names(_p_std(spark, sf)).select("_row", "Full Name", "First Name", "Last Name")


@register("enrich_emails", _p_chain([O.split_step, O.emails_step],
                                    'select _row, "Work Email", "Personal Email" from {prev}'))
def q_enrich_emails(spark, sf):
    return E.enrich_emails(E.split_names(_p_std(spark, sf))).select("_row", "Work Email", "Personal Email")


@register("best_email", _c_chain([O.emails_step], 'select _row, "Work Email", "Personal Email", emails from {prev}'))
def q_best_email(spark, sf):
    return E.enrich_emails(_c_std(spark, sf)).select("_row", "Work Email", "Personal Email", "emails")


@register("domain_from_email", _p_chain([O.split_step, O.emails_step, O.domain_step],
                                        'select _row, "Work Email", "Company Domain" from {prev}'))
def q_domain_from_email(spark, sf):
    d = E.enrich_company_domain(E.enrich_emails(E.split_names(_p_std(spark, sf))))
    return d.select("_row", "Work Email", "Company Domain")


_UPTO_NAME = [O.split_step, O.emails_step, O.domain_step, O.clean_domains_step, O.cname_step]


@register("company_name_people", _p_chain(_UPTO_NAME, 'select _row, "Company Domain", "Company Name" from {prev}'))
def q_company_name_people(spark, sf):
    d = E.enrich_company_name(E.clean_domains(E.enrich_company_domain(E.enrich_emails(E.split_names(_p_std(spark, sf))))))
    return d.select("_row", "Company Domain", "Company Name")


@register("clean_domain_company", _c_chain([O.emails_step, O.domain_step, O.clean_domains_step],
                                           'select _row, "Company Domain" from {prev}'))
def q_clean_domain_company(spark, sf):
    d = E.clean_domains(E.enrich_company_domain(E.enrich_emails(_c_std(spark, sf))))
    return d.select("_row", "Company Domain")


@register("normalize_ws", _p_chain(_UPTO_NAME + [O.normalize_step], "select * from {prev}"))
def q_normalize_ws(spark, sf):
    return E.enrich(_p_std(spark, sf))


@register("title_case", "select page_id, " + O.title_case("regexp_replace(url, '[/.:?#=&]', ' ', 'g')")
          + " as title from pages")
def q_title_case(spark, sf):
    p = FX.table(spark, sf, "pages")
    return p.select("page_id", X.title_case(F.regexp_replace("url", r"[/.:?#=&]", " ")).alias("title"))


@register("title_case_names", f"select row_idx as _row, {O.title_name(O.normalize_text('full_name'))} as full_name, "
          f"{O.title_name(O.normalize_text('job_title'))} as job_title from {_P_RAW}")
def q_title_case_names(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row", X.title_name(X.normalize_text(C("full_name"))).alias("full_name"),
                    X.title_name(X.normalize_text(C("job_title"))).alias("job_title"))


@register("clean_integer", f"select row_idx as _row, {O.clean_integer('employees')} as employees, "
          f"{O.clean_integer('founded')} as founded from {_P_RAW}")
def q_clean_integer(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row", X.clean_integer(C("employees")).alias("employees"),
                    X.clean_integer(C("founded")).alias("founded"))


@register("clean_integer_acctbal", "select c_custkey, " + O.clean_integer("cast(c_acctbal as varchar)")
          + " as acctbal_int from customer")
def q_clean_integer_acctbal(spark, sf):
    c = FX.table(spark, sf, "customer")
    return c.select("c_custkey", X.clean_integer(F.col("c_acctbal").cast("string")).alias("acctbal_int"))


@register("email_domain", f"select row_idx as _row, {O.email_domain('work_email')} as domain from {_P_RAW}")
def q_email_domain(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row", X.email_domain(C("work_email")).alias("domain"))


@register("personal_rank", f"select row_idx as _row, {O.personal_rank(f'lower({O.strip(O.q('personal_email'))})')} as rank_personal, "
          f"{O.personal_rank(f'lower({O.strip(O.q('work_email'))})')} as rank_work from {_P_RAW}")
def q_personal_rank(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row", X.personal_rank(F.lower(X.strip(C("personal_email")))).alias("rank_personal"),
                    X.personal_rank(F.lower(X.strip(C("work_email")))).alias("rank_work"))


@register("personal_email", f"select row_idx as _row, coalesce({O.is_personal('lower(trim(work_email))')}, false) as work_is_personal, "
          f"coalesce({O.is_personal('lower(trim(email_2))')}, false) as email2_is_personal from {_P_RAW}")
def q_personal_email(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.select("_row",
                    F.coalesce(X.is_personal_email(F.lower(F.trim(C("work_email")))), F.lit(False)).alias("work_is_personal"),
                    F.coalesce(X.is_personal_email(F.lower(F.trim(C("email_2")))), F.lit(False)).alias("email2_is_personal"))


@register("free_provider_filter", f"select row_idx as _row, {O.domain_from_email('work_email')} as domain from {_P_RAW} "
          f"where contains(work_email, '@') and {O.domain_from_email('work_email')} not in {O.inlist(__import__('leadsmith').functions.constants.FREE_PROVIDERS)}")
def q_free_provider_filter(spark, sf):
    p = FX.people_raw(spark, sf)
    d = X.domain_from_email(C("work_email"))
    return p.where(C("work_email").contains("@") & ~X.is_free_provider(d)).select("_row", d.alias("domain"))


@register("split_emails", f"select row_idx as _row, array_to_string({O.split_multi_emails('emails')}, '|') as emails_split, "
          f"len({O.split_multi_emails('emails')}) as n from {_C_RAW}")
def q_split_emails(spark, sf):
    c = FX.company_raw(spark, sf)
    arr = X.split_multi_emails(C("emails"))
    return c.select("_row", F.array_join(arr, "|").alias("emails_split"), F.size(arr).cast("bigint").alias("n"))


_DISTINCT_EMAILS = f"list_filter({O.split_multi_emails('emails')}, lambda x, i: list_position({O.split_multi_emails('emails')}, x) = i)"


@register("company_emails", _c_chain([], f"select _row, array_to_string({_DISTINCT_EMAILS}, '|') as emails, "
                                      f"len({_DISTINCT_EMAILS}) as n from {{prev}}"))
def q_company_emails(spark, sf):
    c = _c_std(spark, sf)
    arr = PL.record_emails(c)
    return c.select("_row", F.array_join(arr, "|").alias("emails"), F.size(arr).cast("bigint").alias("n"))




# ---------------------------------------------------------------------------
# Logs and job status (view L over events)
# ---------------------------------------------------------------------------

from datetime import datetime, timedelta  # noqa: E402

from ..operators import logs as LG  # noqa: E402

AS_OF = datetime.fromisoformat(FX.LOGS_AS_OF)
_L = f"with L as ({FX.LOGS_SQL}) "


def _lit_ts(d: datetime) -> str:
    return f"timestamp '{d.strftime('%Y-%m-%d %H:%M:%S')}'"


def _logs(spark, sf):
    return FX.logs(spark, sf)


_WEEK = AS_OF - timedelta(days=7)


@register("log_query", _L + "select log_id, cast(ts as varchar) as ts, job_id, level, error_type, message from L "
          f"where ts between {_lit_ts(_WEEK)} and {_lit_ts(AS_OF)} and level = 'ERROR' and error_type = 'HTTP_401' "
          "order by ts desc, log_id desc limit 1000")
def q_log_query(spark, sf):
    r = LG.query_logs(_logs(spark, sf), start=_WEEK, end=AS_OF, level="error", error_type="HTTP_401", as_of=AS_OF)
    return r.select("log_id", F.col("ts").cast("string").alias("ts"), "job_id", "level", "error_type", "message")


# Relative bounds, and where each starts as seen from AS_OF (2024-01-31 00:00): written out for the oracle.
_RANGE_SPECS = {"today": "2024-01-31 00:00:00", "yesterday": "2024-01-30 00:00:00", "2d": "2024-01-29 00:00:00",
                "24h": "2024-01-30 00:00:00", "2024-01-20T12:00:00Z": "2024-01-20 12:00:00"}


def _range_name(spec):
    return "n_" + "".join(ch if ch.isalnum() else "_" for ch in spec.lower())


@register("log_range", _L + "select " + ", ".join(
    f"count_if(ts between timestamp '{start}' and {_lit_ts(AS_OF)}) as {_range_name(sp)}"
    for sp, start in _RANGE_SPECS.items()) + " from L")
def q_log_range(spark, sf):
    lg = _logs(spark, sf)
    return lg.agg(*[F.count_if(F.col("ts").between(LG._ts(LG.resolve_start(sp, AS_OF)), LG._ts(AS_OF)))
                    .alias(_range_name(sp)) for sp in _RANGE_SPECS])


@register("retention_filter", _L + f"select log_id, job_id from L where ts < {_lit_ts(AS_OF - timedelta(hours=240))}")
def q_retention_filter(spark, sf):
    return LG.older_than(_logs(spark, sf), "ts", AS_OF, 240).select("log_id", "job_id")


@register("log_retention", _L + f"select log_id, job_id from L where ts >= {_lit_ts(_WEEK)}")
def q_log_retention(spark, sf):
    return LG.retained(_logs(spark, sf), AS_OF).select("log_id", "job_id")


@register("error_summary", _L + "select coalesce(error_type, 'TOTAL') as error_type, n from (select error_type, "
          "count(*) as n from (select coalesce(error_type, 'UNKNOWN') as error_type from L where level = 'ERROR' "
          f"and ts between {_lit_ts(_WEEK)} and {_lit_ts(AS_OF)}) group by rollup (error_type))")
def q_error_summary(spark, sf):
    lg = LG.query_logs(_logs(spark, sf), start=_WEEK, end=AS_OF, level="ERROR", limit=None)
    return LG.error_summary(lg)


@register("daily_errors", _L + "select cast(cast(ts as date) as varchar) as day, coalesce(error_type, 'UNKNOWN') "
          "as error_type, count(*) as n from L where level = 'ERROR' group by all")
def q_daily_errors(spark, sf):
    d = LG.daily_errors(_logs(spark, sf))
    return d.select(F.col("day").cast("string").alias("day"), "error_type", "n")


@register("delivery_counts", _L + "select job_id, count_if(status_code = 200) as success, "
          "count_if(status_code <> 200) as failed from L group by job_id")
def q_delivery_counts(spark, sf):
    return LG.delivery_counts(_logs(spark, sf))


@register("job_count", _L + "select count(distinct job_id) as jobs from L")
def q_job_count(spark, sf):
    return _logs(spark, sf).agg(F.count_distinct("job_id").cast("bigint").alias("jobs"))


_SEQ = ("(select *, row_number() over (partition by job_id order by ts, log_id) as seq, "
        "count(*) over (partition by job_id) as total from L)")


@register("record_number", _L + f"select job_id, log_id, seq, total from {_SEQ}")
def q_record_number(spark, sf):
    return LG.with_job_sequence(_logs(spark, sf)).select("job_id", "log_id", F.col("seq").cast("bigint"),
                                                         F.col("total").cast("bigint"))


_W10 = "over (partition by job_id order by ts, log_id rows between 9 preceding and current row)"


@register("delivery_eta", _L + "select job_id, log_id, seq, case when seq >= 3 then (total - seq) * "
          f"sum(cast(round(duration * 100) as bigint)) {_W10} / count(*) {_W10} / 100.0 "
          f"else (total - seq) / 10.0 end as eta_seconds from {_SEQ}")
def q_delivery_eta(spark, sf):
    e = LG.delivery_eta(LG.with_job_sequence(_logs(spark, sf)))
    return e.select("job_id", "log_id", F.col("seq").cast("bigint"), "eta_seconds")


@register("delivery_progress", _L + f"select job_id, log_id, seq, cast(80 + floor(seq / total * 20) as bigint) "
          f"as progress from {_SEQ}")
def q_delivery_progress(spark, sf):
    p = LG.delivery_progress(LG.with_job_sequence(_logs(spark, sf)))
    return p.select("job_id", "log_id", F.col("seq").cast("bigint"), "progress")


_UPD = (f"(select job_id, ts, log_id, case when level = 'ERROR' then 'failed' when level = 'WARNING' then "
        f"'processing' end as status, cast(least(100, floor(seq / 15) * 10) as bigint) as progress, "
        f"case when level <> 'INFO' then message end as message from {_SEQ})")
_STATUS = (f"(select job_id, " + ", ".join(
    f"first({f} order by ts desc, log_id desc) filter (where {f} is not null) as {f}"
    for f in LG.STATUS_FIELDS) + f", max(ts) as updated_at, min(ts) as created_at from {_UPD} group by job_id)")


def _status(spark, sf):
    return LG.status_merge(FX.status_updates(_logs(spark, sf)))


def _status_out(df):
    return df.select("job_id", *LG.STATUS_FIELDS, F.col("updated_at").cast("string").alias("updated_at"),
                     F.col("created_at").cast("string").alias("created_at"))


@register("status_merge", _L + "select job_id, status, progress, message, cast(updated_at as varchar) as updated_at, "
          f"cast(created_at as varchar) as created_at from {_STATUS}")
def q_status_merge(spark, sf):
    return _status_out(_status(spark, sf))


@register("status_lookup", _L + "select job_id, status, progress, message, cast(updated_at as varchar) as updated_at, "
          f"cast(created_at as varchar) as created_at from {_STATUS} where job_id = 'job_7'")
def q_status_lookup(spark, sf):
    return _status_out(LG.status_lookup(_status(spark, sf), "job_7"))


@register("recent_jobs", _L + "select job_id, status, progress, message, cast(updated_at as varchar) as updated_at, "
          f"cast(created_at as varchar) as created_at from {_STATUS} order by created_at desc, job_id desc limit 20")
def q_recent_jobs(spark, sf):
    return _status_out(LG.recent_jobs(_status(spark, sf)))


@register("stuck_jobs", _L + "select job_id, progress, polls, stuck_seconds, case when stuck_seconds > 300 then 'alert' "
          "when stuck_seconds > 120 then 'warn' end as severity from (select job_id, any_value(progress) as progress, "
          "count(*) - 1 as polls, cast(floor(epoch(max(ts))) as bigint) - cast(floor(epoch(min(ts))) as bigint) as stuck_seconds from "
          "(select *, sum(chg) over (partition by job_id order by ts, log_id) as island from (select *, case when "
          "lag(progress) over (partition by job_id order by ts, log_id) = progress then 0 else 1 end as chg from "
          f"{_UPD})) group by job_id, island) where progress < 100 and polls > 10 and stuck_seconds > 120")
def q_stuck_jobs(spark, sf):
    return LG.stuck_jobs(FX.status_updates(_logs(spark, sf)))


@register("throttle_events", _L + "select job_id, first(log_id order by ts, log_id) as first_throttled_log_id, "
          "cast(min(ts) as varchar) as throttled_at from (select *, sum(case when status_code = 429 then 1 else 0 end) "
          "over (partition by job_id, epoch order by ts, log_id rows between unbounded preceding and current row) as n429 "
          "from (select *, sum(case when status_code = 200 then 1 else 0 end) over (partition by job_id order by ts, "
          "log_id rows between unbounded preceding and current row) as epoch from L)) where n429 >= 3 group by job_id")
def q_throttle_events(spark, sf):
    t = LG.throttle_events(_logs(spark, sf))
    return t.select("job_id", "first_throttled_log_id", F.col("throttled_at").cast("string").alias("throttled_at"))


@register("log_newest", _L + f"select log_id, job_id, level from L where ts between {_lit_ts(_WEEK)} and "
          f"{_lit_ts(AS_OF)} order by ts desc, log_id desc limit 1000")
def q_log_newest(spark, sf):
    return LG.query_logs(_logs(spark, sf), start=_WEEK, end=AS_OF, as_of=AS_OF).select("log_id", "job_id", "level")


@register("log_newest_store", ORACLE["log_newest"])
def q_log_newest_store(spark, sf):
    """L2 over the date-partitioned log store: newest dates first, until they hold the limit."""
    path = LG.write_logs(_logs(spark, sf), _run_dir(spark, "logs") + "/events")
    return LG.newest_logs(spark, path, start=_WEEK, end=AS_OF, as_of=AS_OF).select("log_id", "job_id", "level")


@register("log_times", _L + "select log_id, case when microsecond(ts) % 1000000 = 0 then strftime(ts, "
          "'%Y-%m-%dT%H:%M:%S+00:00') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') end as timestamp_iso, "
          "cast(floor(epoch(ts)) as bigint) as timestamp_unix from L")
def q_log_times(spark, sf):
    lg = _logs(spark, sf)
    iso, unix = LG.iso_and_unix(F.col("ts"))
    return lg.select("log_id", iso.alias("timestamp_iso"), unix.cast("bigint").alias("timestamp_unix"))


@register("failure_log", _L + "select job_id, record_number, 'ERROR' as level, 'Webhook failed for record ' || "
          "record_number || ' after 3 attempts: HTTP ' || status_code as message, 'HTTP_' || status_code as error_type "
          "from L where status_code not in (200, 429)")
def q_failure_log(spark, sf):
    from ..operators.delivery import failure_log

    lg = _logs(spark, sf)
    results = lg.select("job_id", "record_number", (F.col("status_code") == 200).alias("ok"), "status_code",
                        F.lit(3).alias("attempts"), F.concat(F.lit("HTTP_"), F.col("status_code").cast("string"))
                        .alias("error_type"), F.col("message").alias("response_text"),
                        F.lit(None).cast("string").alias("exception_type"), "duration")
    fl = failure_log(results, ts=AS_OF)
    return fl.select("job_id", "record_number", "level", "message", "error_type")



# ---------------------------------------------------------------------------
# Dedup keys, stats, limits
# ---------------------------------------------------------------------------

_ALL_ENRICH = [O.split_step, O.emails_step, O.domain_step, O.clean_domains_step, O.cname_step, O.normalize_step]


def _p_enriched(spark, sf):
    return E.enrich(_p_std(spark, sf))


@register("dedup_key_people", _p_chain(_ALL_ENRICH, "select _row, " + O.key_expr(
    ["Work Email", "Personal Email", "LinkedIn Profile", "Full Name", "Company Name"], "people")
    + " as _key from {prev}"))
def q_dedup_key_people(spark, sf):
    return dedup.with_key(_p_enriched(spark, sf), "people").select("_row", "_key")


@register("dedup_key_company", _c_chain(_ALL_ENRICH, "select _row, " + O.key_expr(
    ["Company Name", "Company Domain", "Company LinkedIn"], "company") + " as _key from {prev}"))
def q_dedup_key_company(spark, sf):
    return dedup.with_key(E.enrich(_c_std(spark, sf)), "company").select("_row", "_key")


@register("source_concat", _final_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people",
                                      'select _key, "Source", _n from {prev}'))
def q_source_concat(spark, sf):
    return _people_clean(spark, sf).select("_key", "Source", F.col("_n").cast("bigint").alias("_n"))


@register("dedup_stats", _p_chain(_ALL_ENRICH, "select sum(n) as rows_in, count(*) as rows_out, sum(n) - count(*) "
          "as duplicates_removed from (select k, count(*) as n from (select " + O.key_expr(
              ["Work Email", "Personal Email", "LinkedIn Profile", "Full Name", "Company Name"], "people")
          + " as k from {prev}) group by k)"))
def q_dedup_stats(spark, sf):
    return dedup.dedup_stats(dedup.with_key(_p_enriched(spark, sf), "people"))


@register("record_limit", _final_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people",
                                     "select * exclude (_row, _n) from {prev} order by _key limit 100"))
def q_record_limit(spark, sf):
    df = clean_leads(FX.people_raw(spark, sf), FX.PEOPLE_SPEC, "people", record_limit=100, keep_internal=True)
    return _out(df, [F.col("_key")])


@register("merge_stats", f"select count(distinct source) as files_processed, count(*) as total_records, "
          f"cast({len(P_COLS) - 2} as bigint) as total_columns from {_P_RAW}")
def q_merge_stats(spark, sf):
    from ..sources.csv_scan import merge_stats

    return merge_stats(FX.people_raw(spark, sf))


def _fill_sql():
    """Cells that each priority fills, from the spec's entries: the first filled one of a header's columns counts."""
    slots: dict = {}
    for f in FX.PEOPLE_SPEC["mapped_files"]:
        for std, entry in f["mapped_headers"].items():
            for pr, c in entry.items():
                slots.setdefault(std, {}).setdefault(pr, {})[c] = None
    counts = {"primary": [], "secondary": [], "tertiary": []}
    for by_priority in slots.values():
        before: list[str] = []
        for pr in counts:
            for c in by_priority.get(pr, ()):
                filled = f"not {O.m1(O.q(c))}"
                counts[pr].append(f"case when {' and '.join(['not (' + x + ')' for x in before] + [filled])} then 1 else 0 end")
                before.append(filled)
    used = {c for by_priority in slots.values() for cs in by_priority.values() for c in cs}
    parts = [f"cast(coalesce(sum({' + '.join(v)}), 0) as bigint) as {p}_mappings" if v
             else f"cast(0 as bigint) as {p}_mappings" for p, v in counts.items()]
    unmapped = len([c for c in P_COLS[2:] if c not in used])
    return f"select {', '.join(parts)}, cast({unmapped} as bigint) as unmapped_headers from {_P_RAW}"


@register("mapping_stats", _fill_sql())
def q_mapping_stats(spark, sf):
    return S.mapping_fill_stats(FX.people_raw(spark, sf), FX.PEOPLE_SPEC, "people")


def _second_pass_sql():
    """Domain cells that the pass after the dedup changes."""
    ch = O.raw_chain(FX.PEOPLE_SQL, P_COLS)
    O.standardize_step(ch, FX.PEOPLE_SPEC, "people")
    O.enrich_steps(ch)
    O.dedup_step(ch, "people")
    changed = " + ".join(f"case when {O.q(c)} is null or {O.q(c)} <> {O.clean_domain(O.q(c))} then 1 else 0 end"
                         for c in ch.cols if "domain" in c.lower() or "website" in c.lower())
    return ch.sql(f"select cast(sum({changed}) as bigint) from {{prev}}")


def _enrich_stats_sql():
    ch = O.raw_chain(FX.PEOPLE_SQL, P_COLS)
    O.standardize_step(ch, FX.PEOPLE_SPEC, "people")
    q = O.q
    parts = f"regexp_split_to_array({O.strip(q('Full Name'))}, '{O.WSC}+')"
    split = (f"(not {O.m3(q('Full Name'))} and ({O.m3(q('First Name'))} or {O.m3(q('Last Name'))}) and "
             f"(len({parts}) >= 2 or (len({parts}) = 1 and {O.m3(q('First Name'))})))")
    ch.raw(f"select *, {split} as __names_split from {{prev}}", list(ch.cols), ch.extra + ["__names_split"])
    O.split_step(ch)
    ecols = [c for c in ch.cols if "email" in c.lower()]
    arr = "list_filter([" + ", ".join(f"case when not {O.m4(q(c))} then lower({O.strip(q(c))}) end"
                                       for c in ecols) + "]::varchar[], lambda e: e is not null)"
    ch.raw(f"select *, len(list_filter({arr}, lambda e: {O.is_personal('e')})) > 0 as __personal, "
           f"len(list_filter({arr}, lambda e: not {O.is_personal('e')})) > 0 as __work from {{prev}}",
           list(ch.cols), ch.extra + ["__personal", "__work"])
    O.emails_step(ch)
    we = q("Work Email")
    usable = (f"({we} is not null and {O.strip(we)} <> '' and contains({we}, '@') "
              f"and lower({we}) not in ('nan', 'none', 'null', ''))")
    dom = O.domain_from_email(we)
    from ..functions.constants import FREE_PROVIDERS as FP
    ch.raw(f"select *, ({O.m3(q('Company Domain'))} and {usable} and coalesce({dom} not in {O.inlist(FP)}, true)) "
           f"as __domain_enriched from {{prev}}", list(ch.cols), ch.extra + ["__domain_enriched"])
    O.domain_step(ch)
    dcols = [c for c in ch.cols if "domain" in c.lower() or "website" in c.lower()]
    changed = " + ".join(f"case when {q(c)} is null or {q(c)} <> {O.clean_domain(q(c))} then 1 else 0 end"
                         for c in dcols)
    ch.raw(f"select *, {changed} as __domains_cleaned from {{prev}}", list(ch.cols), ch.extra + ["__domains_cleaned"])
    O.clean_domains_step(ch)
    gen = O.company_name_from_domain(q("Company Domain"))
    ch.raw(f"select *, ({O.m3(q('Company Name'))} and not {O.m3(q('Company Domain'))} and {gen} is not null) "
           f"as __name_generated from {{prev}}", list(ch.cols), ch.extra + ["__name_generated"])
    O.cname_step(ch)
    return ch.sql("select count_if(__personal) as personal_emails_ranked, count_if(__work) as work_emails_identified, "
                  "count_if(__personal or __work) as emails_enriched, count_if(__names_split) as names_split, "
                  "count_if(__domain_enriched) as domains_enriched, cast(sum(__domains_cleaned) as bigint) + "
                  "(" + _second_pass_sql() + ") as domains_cleaned, count_if(__name_generated) as company_names_generated from {prev}")


@register("enrich_stats", _enrich_stats_sql())
def q_enrich_stats(spark, sf):
    return E.enrich_stats(E.enrich_with_stats(_p_std(spark, sf)), "people")


@register("missing_matrix", "select " + ", ".join(
    f"count_if({getattr(O, m)(O.q(c))}) as {m}_{c}" for m in ("m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8")
    for c in ("first_name", "last_name", "personal_email", "website")) + f" from {_P_RAW}")
def q_missing_matrix(spark, sf):
    p = FX.people_raw(spark, sf)
    return p.agg(*[F.count_if(X.MISSING[m](C(c))).cast("bigint").alias(f"{m}_{c}")
                   for m in ("m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8")
                   for c in ("first_name", "last_name", "personal_email", "website")])


@register("first_row", f"select * exclude (pos) from (select *, row_number() over (partition by source order by "
          f"row_idx) as pos from {_P_RAW}) where pos = 1")
def q_first_row(spark, sf):
    from ..operators.profile import head_per_group

    p = FX.people_raw(spark, sf)
    h = head_per_group(p, "Source", "_row", 1)
    return h.select(*P_COLS[2:], F.col("Source").alias("source"), F.col("_row").alias("row_idx"))


# ---------------------------------------------------------------------------
# Column profile, junk filter, alias mapper, header sets
# ---------------------------------------------------------------------------

from ..operators import profile as PR  # noqa: E402

_P_PROFILE_BASE = (f"select {', '.join(O.q(c) for c in P_COLS[2:])}, source as \"Source\", "
                   f"cast(row_idx as bigint) as _row from {_P_RAW}")
_C_PROFILE_BASE = (f"select {', '.join(O.q(c) for c in C_COLS[2:])}, source as \"Source\", "
                   f"cast(row_idx as bigint) as _row from {_C_RAW}")
_MT_TABLES = [("pages", "page_id", ["page_id", "url", "html"]),
              ("events", "event_id", ["event_id", "ts", "user_id", "event_type", "value", "props", "note"]),
              ("documents", "doc_id", ["doc_id", "text", "lang", "n_chars"])]
_MT_COLS = []
for _t, _id, _cs in _MT_TABLES:
    for _c in _cs:
        if _c not in _MT_COLS:
            _MT_COLS.append(_c)
_MT_BASE = " union all ".join(
    "select " + ", ".join("'  ' as note" if c == "note" and c in cs else f"cast({c} as varchar) as {O.q(c)}" if c in cs
                          else f"cast(null as varchar) as {O.q(c)}" for c in _MT_COLS) + f", '{t}.csv' as \"Source\", cast({i} as bigint) as _row from {t}"
    for t, i, cs in _MT_TABLES)


def _mt_frame(spark, sf):
    """Three driver tables as three 'exports' with differing headers, unioned by name."""
    out = None
    for t, i, cs in _MT_TABLES:
        df = FX.table(spark, sf, t)
        if "note" in cs:  # a column that is blank in every row
            df = df.withColumn("note", F.lit("  "))
        part = df.select(*[F.col(c).cast("string").alias(c) for c in cs], F.lit(f"{t}.csv").alias("Source"),
                         F.col(i).cast("bigint").alias("_row"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*[C(c) for c in _MT_COLS], "Source", "_row")


_MT_HEADERS = {f"{t}.csv": cs for t, _, cs in _MT_TABLES}
_MT_PROFILE = O.profile_sql(_MT_BASE, _MT_COLS, headers=_MT_HEADERS)


def _mt_profile(spark, sf):
    return PR.column_profile(_mt_frame(spark, sf), headers=[(cs, [f]) for f, cs in _MT_HEADERS.items()])


_PROFILE_COLS = ["Source", "ordinal", "column_name", "first_value", "is_empty", "is_junk", "sample_value",
                 "non_null_count", "kept"]


def _prof_out(df):
    return df.select(*_PROFILE_COLS)


@register("column_profile", O.profile_sql(_P_PROFILE_BASE, P_COLS[2:]))
def q_column_profile(spark, sf):
    return _prof_out(PR.column_profile(FX.people_raw(spark, sf)))


@register("column_profile_tables", _MT_PROFILE)
def q_column_profile_tables(spark, sf):
    return _prof_out(_mt_profile(spark, sf))


@register("junk_columns", "select \"Source\", column_name, first_value from (" + _MT_PROFILE
          + ") where is_junk")
def q_junk_columns(spark, sf):
    return _mt_profile(spark, sf).where("is_junk").select("Source", "column_name", "first_value")


@register("empty_columns", "select \"Source\", column_name from (" + _MT_PROFILE
          + ") where is_empty")
def q_empty_columns(spark, sf):
    return _mt_profile(spark, sf).where("is_empty").select("Source", "column_name")


@register("header_stats", "select count(*) as headers_before_filtering, count(distinct case when kept then column_name "
          "end) as headers_after_filtering, count(*) - count(distinct case when kept then column_name end) as "
          "headers_filtered_out, case when count(*) > 0 then round((count(*) - count(distinct case when kept then "
          "column_name end)) / count(*) * 100, 1) else 0.0 end as filtering_percentage from ("
          + _MT_PROFILE + ")")
def q_header_stats(spark, sf):
    return PR.header_stats(_mt_profile(spark, sf))


def _alias_sql(prof_sql, table_type):
    from ..functions.constants import ALIASES
    rows = ", ".join(f"({O.lit(a)}, {O.lit(std)}, {i}, {j})" for i, (std, al) in enumerate(ALIASES[table_type].items())
                     for j, a in enumerate(al))
    return (f"select \"Source\", ordinal, column_name, first(std order by std_ord, alias_ord) as std, min(std_ord) as std_ord, "
            f"first(alias_ord order by std_ord, alias_ord) as alias_ord from (select p.\"Source\", p.ordinal, p.column_name, a.* "
            f"from ({prof_sql}) p join (values {rows}) a(alias, std, std_ord, alias_ord) on "
            f"replace(lower({O.strip('p.column_name')}), '_', ' ') = replace(a.alias, '_', ' ') where p.kept) group by \"Source\", ordinal, column_name")


@register("alias_match", _alias_sql(O.profile_sql(_P_PROFILE_BASE, P_COLS[2:]), "people"))
def q_alias_match(spark, sf):
    return PR.alias_matches(PR.column_profile(FX.people_raw(spark, sf)), "people")


def _spec_rows_sql():
    a = _alias_sql(O.profile_sql(_P_PROFILE_BASE, P_COLS[2:]), "people")
    return (f"select \"Source\" as filename, std, std_ord, ['primary', 'secondary', 'tertiary'][rank] as priority, "
            f"column_name as source_col from (select *, row_number() over (partition by \"Source\", std order by "
            f"alias_ord, ordinal) as rank from ({a})) where rank <= 3")


@register("mapping_explode", _spec_rows_sql())
def q_mapping_explode(spark, sf):
    return PR.mapped_spec_rows(PR.alias_matches(PR.column_profile(FX.people_raw(spark, sf)), "people"))


def _spec_values():
    """The people spec's entries, written out by file, standard header and priority."""
    rows = []
    for i, f in enumerate(FX.PEOPLE_SPEC["mapped_files"]):
        for j, (std, slots) in enumerate(f["mapped_headers"].items()):
            rows += [(i, f["filename"], j, std, pr, slots[pr]) for pr in ("primary", "secondary", "tertiary") if pr in slots]
    return "(values " + ", ".join(f"({i}, {O.lit(f)}, {j}, {O.lit(std)}, {O.lit(pr)}, {O.lit(c)})"
                                  for i, f, j, std, pr, c in rows) + ") t(file_ord, filename, std_ord, std, priority, source_col)"


_SPEC_FILL = ("select m.filename, m.std, m.priority, m.source_col, count(p.row_idx) as rows_in_file from (select * from "
              + _spec_values() + f") m left join {_P_RAW} p on p.source = m.filename group by all")


@register("mapping_table", _SPEC_FILL)
def q_mapping_table(spark, sf):
    """The mapping spec as a table, joined to the rows of the file that each entry maps."""
    spec = S.mapping_table(spark, FX.PEOPLE_SPEC).select("filename", "std", "priority", "source_col")
    sizes = FX.people_raw(spark, sf).groupBy(C("Source").alias("filename")).agg(F.count(F.lit(1)).alias("rows_in_file"))
    return spec.join(sizes, "filename", "left").withColumn("rows_in_file", F.coalesce("rows_in_file", F.lit(0)).cast("bigint"))


def _spec_file(spark, spec):
    """A mapper's answer as a JSON file of the run's folder."""
    path = _run_dir(spark, "spec") + "/mapping"
    spark.createDataFrame([(json.dumps(spec, indent=1),)], "value string").coalesce(1).write.text(path)
    return path


@register("mapping_json", _SPEC_FILL)
def q_mapping_json(spark, sf):
    """The mapping spec read from its JSON file, joined to the rows of the file that each entry maps."""
    spec = S.read_mapping_spec(spark, _spec_file(spark, FX.PEOPLE_SPEC)).select("filename", "std", "priority", "source_col")
    sizes = FX.people_raw(spark, sf).groupBy(C("Source").alias("filename")).agg(F.count(F.lit(1)).alias("rows_in_file"))
    return spec.join(sizes, "filename", "left").withColumn("rows_in_file", F.coalesce("rows_in_file", F.lit(0)).cast("bigint"))


@register("standardize_company_json", ORACLE["standardize_company"])
def q_standardize_company_json(spark, sf):
    """P2-P4 planned from an array-wrapped JSON file, folded as a table."""
    return S.standardize(FX.company_raw(spark, sf), S.read_mapping_spec(spark, _spec_file(spark, FX.COMPANY_SPEC)), "company")


@register("mapping_merge", "select std, priority, source_col, min(file_ord) as first_file_ord, sum(rows_in_file)::bigint as "
          f"rows_mapped from ({_SPEC_FILL}) join (select distinct filename, file_ord from {_spec_values()}) using (filename) "
          "group by std, priority, source_col")
def q_mapping_merge(spark, sf):
    """The fold over all files' specs, one row per (standard header, priority, source column)."""
    table = S.mapping_table(spark, FX.PEOPLE_SPEC)
    merged = S.merged_mapping_table(table)
    sizes = FX.people_raw(spark, sf).groupBy(C("Source").alias("filename")).agg(F.count(F.lit(1)).alias("n"))
    rows = (table.join(sizes, "filename", "left").groupBy("std", "priority", "source_col")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_mapped")))
    return merged.select("std", "priority", "source_col", F.col("first_seen.file_ord").alias("first_file_ord")).join(
        rows, ["std", "priority", "source_col"])


@register("term_semi", "select distinct p.column_name, t.term from (" + _MT_PROFILE
          + ") p join (values " + ", ".join(f"({O.lit(t)})" for t in __import__("leadsmith").functions.constants.UNWANTED_TERMS)
          + ") t(term) on contains(lower(p.column_name), t.term)")
def q_term_semi(spark, sf):
    return PR.term_hits(_mt_profile(spark, sf))


# ---------------------------------------------------------------------------
# documents: per-source scans, counts, heads, ids
# ---------------------------------------------------------------------------

def _docs(spark, sf):
    return FX.table(spark, sf, "documents")


@register("source_tag", "select doc_id, 'documents.parquet' as \"Source\" from documents")
def q_source_tag(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("Source"))


@register("source_filter", "select doc_id, n_chars from documents where source = 'src3'")
def q_source_filter(spark, sf):
    return _docs(spark, sf).where(F.col("source") == "src3").select("doc_id", "n_chars")


@register("distinct_sources", "select distinct source from documents")
def q_distinct_sources(spark, sf):
    return _docs(spark, sf).select("source").distinct()


@register("count_records", "select coalesce(source, 'TOTAL') as source, n from (select source, count(*) as n "
          "from documents group by rollup (source))")
def q_count_records(spark, sf):
    r = _docs(spark, sf).rollup("source").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return r.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "n")


@register("head_per_source", "select doc_id, source, pos from (select doc_id, source, row_number() over (partition by "
          "source order by doc_id) as pos from documents) where pos <= 5")
def q_head_per_source(spark, sf):
    from ..operators.profile import head_per_group

    h = head_per_group(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 5, "pos")
    return h.select("doc_id", "source", F.col("pos").cast("bigint").alias("pos"))


@register("sample_scan", "select doc_id, source, n_chars from (select doc_id, source, n_chars, row_number() over "
          "(partition by source order by doc_id) as pos from documents) where pos <= 100")
def q_sample_scan(spark, sf):
    from ..operators.profile import head_per_group

    h = head_per_group(_docs(spark, sf).select("doc_id", "source", "n_chars"), "source", "doc_id", 100)
    return h.select("doc_id", "source", "n_chars")


_HASH = __import__("leadsmith").functions.constants.HASH_PATTERNS


def _o_hash(x):
    v = O.strip(x)
    return f"(length({v}) >= 10 and (" + " or ".join(f"regexp_matches({v}, {O.lit(p)})" for p in _HASH) + "))"


@register("hash_like", f"select doc_id, coalesce({_o_hash('md5(text)')}, false) as md5_hash_like, "
          f"coalesce({_o_hash('source')}, false) as source_hash_like, coalesce({_o_hash('text')}, false) as text_hash_like, "
          f"coalesce({_o_hash(chr(39) + 'doc-' + chr(39) + ' || lpad(cast(doc_id as varchar), 20, ' + chr(39) + 'x' + chr(39) + ')')}, false) as padded_hash_like from documents")
def q_hash_like(spark, sf):
    d = _docs(spark, sf)
    padded = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 20, "x"))
    return d.select("doc_id", F.coalesce(X.is_hash_like(F.md5("text")), F.lit(False)).alias("md5_hash_like"),
                    F.coalesce(X.is_hash_like(F.col("source")), F.lit(False)).alias("source_hash_like"),
                    F.coalesce(X.is_hash_like(F.col("text")), F.lit(False)).alias("text_hash_like"),
                    F.coalesce(X.is_hash_like(padded), F.lit(False)).alias("padded_hash_like"))


# ---------------------------------------------------------------------------
# Payloads (people nested, company flat, generic) and record JSON
# ---------------------------------------------------------------------------

from ..functions.constants import PAYLOAD_SOURCE_LABEL  # noqa: E402

PAYLOAD_TS = 1706659200  # fixed job clock for reproducible payloads (2024-01-31 00:00:00 UTC)


def _numbered(df):
    from ..operators.logs import global_index

    return global_index(df, ["_key"])


def _json_struct(fields):
    return "{" + ", ".join(f"{O.lit(k)}: {v}" for k, v in fields) + "}"


def _add_map(cols, std):
    extra = [c for c in cols if c not in std and not c.startswith("Company Email ")]
    if not extra:
        return "map([]::varchar[], []::varchar[])"
    entries = "[" + ", ".join(f"{{'k': {O.lit(c)}, 'v': cast({O.q(c)} as varchar)}}" for c in extra) + "]"
    return f"map_from_entries(list_filter({entries}, lambda e: e.v is not null and e.v <> ''))"


def _payload_sql(fixture, cols, spec, tt, kind):
    from ..functions.constants import COMPANY_FIELDS as CF, PAYLOAD_PERSON_FIELDS as PF
    ch = O.raw_chain(fixture, cols)
    O.standardize_step(ch, spec, tt)
    O.enrich_steps(ch)
    O.dedup_step(ch, tt)
    O.clean_domains_step(ch)
    names = [c.replace("Linked In", "LinkedIn") for c in ch.cols]
    std = set(PF) | set(CF) | {"Source"}
    add = _add_map(names, std)
    rn = "row_number() over (order by _key)"
    if kind == "company":
        top = [(c, O.q(c)) for c in names if c in set(CF) | {"Source"}]
        meta = _json_struct([("record_number", rn), ("timestamp", f"cast({PAYLOAD_TS} as bigint)"),
                             ("source", O.lit(PAYLOAD_SOURCE_LABEL)), ("total_additional_fields", f"cast(cardinality({add}) as integer)")])
        body = _json_struct(top + [("additional_fields", add), ("_metadata", meta)])
    elif kind == "people":
        meta = _json_struct([("record_number", rn), ("timestamp", f"cast({PAYLOAD_TS} as bigint)"),
                             ("source", O.lit(PAYLOAD_SOURCE_LABEL)), ("total_additional_fields", f"cast(cardinality({add}) as integer)")])
        person = _json_struct([(c, O.q(c)) for c in names if c in PF])
        comp = _json_struct([(c, O.q(c)) for c in names if c in CF])
        body = _json_struct([("person", person), ("company", comp), ("Source", O.q("Source")),
                             ("additional_fields", add), ("_metadata", meta)])
    else:
        meta = _json_struct([("record_number", rn), ("timestamp", f"cast({PAYLOAD_TS} as bigint)"),
                             ("source", O.lit(PAYLOAD_SOURCE_LABEL))])
        body = _json_struct([(c, O.q(c)) for c in names] + [("_metadata", meta)])
    return ch.sql(f"select {rn} as record_number, to_json({body}) as payload from {{prev}}")


@register("payload_people", _payload_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people", "people"))
def q_payload_people(spark, sf):
    return PL.payloads(_numbered(_people_clean(spark, sf)), "people", PAYLOAD_TS)


@register("payload_company", _payload_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company", "company"))
def q_payload_company(spark, sf):
    return PL.payloads(_numbered(_company_clean(spark, sf)), "company", PAYLOAD_TS)


def _payload_emails_sql():
    from ..functions.constants import COMPANY_FIELDS as CF, PAYLOAD_PERSON_FIELDS as PF
    ch = O.raw_chain(FX.COMPANY_SQL, C_COLS)
    O.standardize_step(ch, FX.COMPANY_SPEC, "company")
    names = [c.replace("Linked In", "LinkedIn") for c in ch.cols]
    add = _add_map(names, set(PF) | set(CF) | {"Source"})
    rn = "row_number() over (order by _row)"
    top = _json_struct([(c, O.q(c)) for c in names if c in set(CF) | {"Source"}])
    meta = _json_struct([("record_number", rn), ("timestamp", f"cast({PAYLOAD_TS} as bigint)"), ("source", O.lit(PAYLOAD_SOURCE_LABEL)),
                         ("total_additional_fields", f"cast(cardinality({add}) as integer)")])
    tail = _json_struct([("additional_fields", add), ("_metadata", meta)])
    inner = lambda j: f"substring(cast({j} as varchar), 2, length(cast({j} as varchar)) - 2)"
    keys = (f"array_to_string(list_transform({_DISTINCT_EMAILS}, lambda e, i: '\"Company Email ' || i || '\":' || "
            "cast(to_json(e) as varchar)), ',')")
    return ch.sql(f"select {rn} as record_number, chr(123) || concat_ws(',', {inner(f'to_json({top})')}, nullif({keys}, ''), "
                  f"{inner(f'to_json({tail})')}) || chr(125) as payload from {{prev}}")


@register("payload_company_emails", _payload_emails_sql())
def q_payload_company_emails(spark, sf):
    """P9 + P12: each record's own Company Email 1..n, from the e-mail columns before they are blanked."""
    from ..operators.logs import global_index

    numbered = global_index(PL.number_emails(_c_std(spark, sf)), ["_row"])
    return PL.payloads(numbered, "company", PAYLOAD_TS)


@register("payload_generic", _payload_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people", "generic"))
def q_payload_generic(spark, sf):
    return PL.payloads(_numbered(_people_clean(spark, sf)), "generic", PAYLOAD_TS)


def _additional_sql(fixture, cols, spec, tt):
    from ..functions.constants import COMPANY_FIELDS as CF, PAYLOAD_PERSON_FIELDS as PF
    ch = O.raw_chain(fixture, cols)
    O.standardize_step(ch, spec, tt)
    O.enrich_steps(ch)
    O.dedup_step(ch, tt)
    O.clean_domains_step(ch)
    add = _add_map(list(ch.cols), set(PF) | set(CF) | {"Source"})
    return ch.sql(f"select _key, cast(cardinality({add}) as bigint) as total_additional_fields, "
                  f"array_to_string(map_keys({add}), ',') as additional_keys, "
                  f"array_to_string(map_values({add}), ',') as additional_values from {{prev}}")


def _additional(df):
    m = PL.additional_map(PL.data_cols(df))
    return df.select("_key", F.size(m).cast("bigint").alias("total_additional_fields"),
                     F.array_join(F.map_keys(m), ",").alias("additional_keys"),
                     F.array_join(F.map_values(m), ",").alias("additional_values"))


@register("additional_fields", _additional_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company"))
def q_additional_fields(spark, sf):
    return _additional(_company_clean(spark, sf))


@register("additional_fields_people", _additional_sql(FX.PEOPLE_SQL, P_COLS, FX.PEOPLE_SPEC, "people"))
def q_additional_fields_people(spark, sf):
    return _additional(_people_clean(spark, sf))


def _record_json_sql():
    ch = O.raw_chain(FX.COMPANY_SQL, C_COLS)
    O.standardize_step(ch, FX.COMPANY_SPEC, "company")
    O.enrich_steps(ch)
    O.dedup_step(ch, "company")
    O.clean_domains_step(ch)
    body = _json_struct([(c, O.q(c)) for c in ch.cols])
    return ch.sql(f"select _key, to_json({body}) as record from {{prev}}")


@register("record_json", _record_json_sql())
def q_record_json(spark, sf):
    df = _company_clean(spark, sf)
    cols = PL.data_cols(df)
    return df.select("_key", F.to_json(F.struct(*[C(c).alias(c) for c in cols]),
                                       {"ignoreNullFields": "false"}).alias("record"))


_C_LI_SQL = ("select " + ", ".join(O.q(c) if c != "linkedin_account" else 'linkedin_account as "Linked In Account"'
                                   for c in C_COLS) + f" from ({FX.COMPANY_SQL})")


@register("header_repair", "select row_idx as _row, " + ", ".join(
    (O.q(c) if c != "linkedin_account" else '"Linked In Account" as "LinkedIn Account"') for c in C_COLS[2:])
    + f" from ({_C_LI_SQL})")
def q_header_repair(spark, sf):
    c = FX.company_raw(spark, sf).withColumnRenamed("linkedin_account", "Linked In Account").drop("Source")
    return PL.repair_headers(c).select("_row", *[x for x in PL.repair_headers(c).columns if x != "_row"])



# ---------------------------------------------------------------------------
# Rows-only checks: CSV source/sink, delivery sink, file inventory, streaming
# ---------------------------------------------------------------------------

def _run_dir(spark, name):
    from ..streaming.twins import run_dir

    return run_dir(spark, name)


_EXPORT_B = [*reversed(_UB_B), "person_key"]


def _write_exports(spark, sf):
    """Fixture P written as two CSV exports with different headers (crm_b: subset, reordered)."""
    from ..sources.csv_scan import write_csv

    base = _run_dir(spark, "exports")
    p = FX.people_raw(spark, sf)
    write_csv(p.where(C("Source") == "crm_a.csv").orderBy("_row").select(*P_COLS[2:]), f"{base}/crm_a.csv", single_file=True)
    write_csv(p.where(C("Source") == "crm_b.csv").orderBy("_row").select(*_EXPORT_B), f"{base}/crm_b.csv", single_file=True)
    return base


def _na(c):
    return f"case when {O.q(c)} in {O.inlist(NA_TOKENS)} or {O.q(c)} = '' then null else {O.q(c)} end"


_EXPORTS = ("(select " + ", ".join(f"{_na(c)} as {O.q(c)}" for c in P_COLS[2:])
            + f", source, row_idx from {_P_RAW} where source = 'crm_a.csv' union all select "
            + ", ".join(f"{_na(c) if c in _EXPORT_B else 'null'}" for c in P_COLS[2:])
            + f", source, row_idx from {_P_RAW} where source = 'crm_b.csv')")


@register("csv_scan", "select " + ", ".join(O.q(c) for c in P_COLS[2:]) + f", source as \"Source\" from {_EXPORTS}")
def q_csv_scan(spark, sf):
    from ..sources.csv_scan import read_csv_files

    return read_csv_files(spark, [_write_exports(spark, sf)]).drop("_row")


@register("csv_scan_split", "select " + ", ".join(O.q(c) for c in P_COLS[2:]) + ", source as \"Source\", "
          "row_number() over (partition by source order by row_idx) - 1 as position from " + _EXPORTS.replace(
              _na("job_title"), f"case when {_na('job_title')} is not null then concat({_na('job_title')}, chr(10), 'of \"', city, '\"') end"))
def q_csv_scan_split(spark, sf):
    """S1 by byte ranges: cells with quotes and line breaks, each file read by many tasks; ``position`` is the record's place in its file."""
    from ..sources.csv_scan import read_csv_files, write_csv

    base = _run_dir(spark, "split-exports")
    title = C("job_title")
    title = F.when(title.isNotNull(), F.concat(title, F.lit('\nof "'), C("city"), F.lit('"')))
    p = FX.people_raw(spark, sf).withColumn("job_title", title)
    write_csv(p.where(C("Source") == "crm_a.csv").orderBy("_row").select(*P_COLS[2:]), f"{base}/crm_a.csv", single_file=True)
    write_csv(p.where(C("Source") == "crm_b.csv").orderBy("_row").select(*_EXPORT_B), f"{base}/crm_b.csv", single_file=True)
    found = read_csv_files(spark, [base], split_bytes=1 << 16)
    return found.withColumn("position", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row")


@register("header_catalog", "select * from (values " + ", ".join(
    f"({k}, {O.lit(f)}, {i}, {O.lit(h)})" for k, (f, hs) in enumerate((("crm_a.csv", P_COLS[2:]), ("crm_b.csv", _EXPORT_B)))
    for i, h in enumerate(hs)) + ") t(file_ord, file_name, ordinal, header)")
def q_header_catalog(spark, sf):
    from ..sources.csv_scan import header_catalog, list_csv_files

    base = _write_exports(spark, sf)
    return header_catalog(spark, list_csv_files(spark, [base])).drop("path")


def _write_company_exports(spark, sf):
    from ..sources.csv_scan import write_csv

    base = _run_dir(spark, "company-exports")
    c = FX.company_raw(spark, sf)
    for k in range(3):
        write_csv(c.where(C("Source") == f"export_{k}.csv").orderBy("_row").select(*C_COLS[2:]), f"{base}/export_{k}.csv", single_file=True)
    return base


def _catalog(spark, *folders):
    from ..sources.csv_scan import header_catalog, list_csv_files

    return header_catalog(spark, list_csv_files(spark, list(folders)))


def _names_sql(names):
    return "(select * from (values " + ", ".join(f"({O.lit(c)})" for c in names) + ") h(column_name))"


@register("header_union", f"select column_name from {_names_sql(P_COLS[2:])} union select column_name from {_names_sql(C_COLS[2:])}")
def q_header_union(spark, sf):
    return PR.header_set(_catalog(spark, _write_exports(spark, sf), _write_company_exports(spark, sf)))


_KEPT_P = ("select \"Source\", column_name from (" + O.profile_sql(
    "select " + ", ".join(O.q(c) for c in P_COLS[2:]) + f", source as \"Source\", row_idx as _row "
    f"from {_EXPORTS}", P_COLS[2:], headers={"crm_a.csv": P_COLS[2:], "crm_b.csv": _EXPORT_B}) + ") where kept")


@register("header_intersect", _KEPT_P)
def q_header_intersect(spark, sf):
    """The kept columns of the profile that the file's own header holds."""
    from ..sources.csv_scan import file_headers, read_csv_files

    base = _write_exports(spark, sf)
    profile = PR.column_profile(read_csv_files(spark, [base]), headers=file_headers(spark, [base]))
    return PR.common_columns(profile, _catalog(spark, base))


_MAPPED_P = sorted({c for f in FX.PEOPLE_SPEC["mapped_files"] for m in f["mapped_headers"].values() for c in m.values()})


@register("header_except", f"select column_name from {_names_sql(P_COLS[2:])} except select column_name from {_names_sql(_MAPPED_P)}")
def q_header_except(spark, sf):
    return PR.unmapped_headers(_catalog(spark, _write_exports(spark, sf)), _MAPPED_P)


def _csv_sink_sql():
    ch = O.raw_chain(FX.PEOPLE_SQL, P_COLS)
    O.standardize_step(ch, FX.PEOPLE_SPEC, "people")
    O.enrich_steps(ch)
    O.dedup_step(ch, "people")
    O.clean_domains_step(ch)
    return ch.sql("select " + ", ".join(f"{_na(c)} as {O.q(c)}" for c in ch.cols if c != "Source")
                  + ", 'people.csv' as \"Source\" from {prev}")


@register("csv_sink", _csv_sink_sql())
def q_csv_sink(spark, sf):
    from ..sources.csv_scan import read_csv_files, write_csv

    out = f"{_run_dir(spark, 'processed')}/people.csv"
    return read_csv_files(spark, [write_csv(_people_clean(spark, sf), out, single_file=True)]).drop("_row")


def _final_count_sql():
    """Numbers 1..n of the n cleaned company records."""
    return ("(select unnest(range(1, n + 1)) as rn, n from (select count(*) as n from ("
            + _final_sql(FX.COMPANY_SQL, C_COLS, FX.COMPANY_SPEC, "company") + ")))")


_RESULTS = ("(select rn, n, rn % 11 <> 0 as ok, case when rn % 11 = 0 then 500 else 200 end as status_code, "
            "case when rn % 11 = 0 then 3 when rn % 7 = 0 then 2 else 1 end as attempts from " + _final_count_sql() + ")")


def _sent(spark, sf):
    from ..operators.delivery import deliver

    pay = PL.payloads(_numbered(_company_clean(spark, sf)), "company", PAYLOAD_TS)
    return deliver(pay, "job_company", FX.rule_transport(), rate=1000.0, partitions=4, sleep=lambda s: None)


@register("delivery_sink", "select 'job_company' as job_id, rn as record_number, ok, status_code, attempts, "
          "case when not ok then 'HTTP_500' end as error_type, case when not ok then 'server error' end as response_text, "
          f"cast(null as varchar) as exception_type, false as throttled from {_RESULTS}")
def q_delivery_sink(spark, sf):
    return _sent(spark, sf).drop("duration", "finished")


_FAILED = ("(select rn as record_number, 'ERROR' as level, 'HTTP_500' as error_type, 'Webhook failed for record ' || rn || "
           f"' after 3 attempts: HTTP 500' as message from {_RESULTS} where not ok)")


@register("delivery_results_summary", "select record_number as log_id, record_number, 'job_company' as job_id, level, error_type, "
          "message, '{\"status_code\":\"500\",\"response_text\":\"server error\",\"webhook_url\":"
          f"\"https://receiver.invalid/hook\"}}' as metadata from {_FAILED}")
def q_delivery_results_summary(spark, sf):
    from ..operators.delivery import failure_log

    log = failure_log(_sent(spark, sf), url="https://receiver.invalid/hook", ts=AS_OF)
    return log.select("log_id", "record_number", "job_id", "level", "error_type", "message", "metadata")


def _job(spark, sf):
    from .pipeline import deliver_job

    base = _run_dir(spark, "job")
    out = deliver_job(FX.company_raw(spark, sf), FX.COMPANY_SPEC, "company", "job_company", FX.rule_transport(),
                      rate=1000.0, partitions=4, timestamp=PAYLOAD_TS, sleep=lambda s: None,
                      log_path=f"{base}/logs", status_path=f"{base}/status")
    return base, out


@register("delivery_log_chain", "select coalesce(error_type, 'TOTAL') as error_type, n from (select error_type, count(*) as n "
          f"from {_FAILED} group by rollup(error_type))")
def q_delivery_log_chain(spark, sf):
    """Failures go to the log store, and the log operators read them there."""
    base, _ = _job(spark, sf)
    logs = LG.query_logs(LG.read_logs(spark, f"{base}/logs"), job_id="job_company", level="error", limit=None)
    return LG.error_summary(logs)


@register("delivery_status_folded", "select 'job_company' as job_id, 'processing' as status, cast(100 as bigint) as progress, "
          f"'Sent record ' || max(rn) || ' of ' || max(n) as message from {_RESULTS}")
def q_delivery_status_folded(spark, sf):
    """Status updates of a delivery, folded to the job's current status."""
    base, _ = _job(spark, sf)
    # records finish in any order over the senders: the record number tells how far the job has come
    updates = spark.read.parquet(f"{base}/status").withColumn("ts", F.lit(AS_OF).cast("timestamp_ntz"))
    return LG.status_merge(updates).select("job_id", *LG.STATUS_FIELDS)


_EXPORTS_FIXTURE = ("select row_idx, source, " + ", ".join(f"{_na(c)} as {O.q(c)}" for c in P_COLS[2:])
                    + f" from {_P_RAW} where source = 'crm_a.csv' union all select row_idx, source, "
                    + ", ".join(_na(c) if c in _EXPORT_B else "null" for c in P_COLS[2:])
                    + f" from {_P_RAW} where source = 'crm_b.csv'")


@register("stream_ingest", _final_sql(_EXPORTS_FIXTURE, P_COLS, FX.PEOPLE_SPEC, "people",
                                      "select * exclude (_row, _n, _key) from {prev}"))
def q_stream_ingest(spark, sf):
    from ..streaming.twins import read_stream_result, stream_clean_csv

    base = _write_exports(spark, sf)
    path, cols = stream_clean_csv(spark, [(f"{base}/crm_a.csv", P_COLS[2:]), (f"{base}/crm_b.csv", _EXPORT_B)],
                                  FX.PEOPLE_SPEC, "people")
    return read_stream_result(spark, path, cols).drop("_row", "_n", "_key")


@register("stream_errors", ORACLE["daily_errors"])
def q_stream_errors(spark, sf):
    from ..streaming.twins import stream_error_counts

    r = stream_error_counts(spark, f"{sf}/events.parquet", FX.logs_frame)
    return r.select(F.col("day").cast("string").alias("day"), "error_type", "n")


@register("stream_status", _L + "select job_id, first(status order by ts desc, log_id desc) filter (where status is not null) "
          "as status, first(message order by ts desc, log_id desc) filter (where message is not null) as message, "
          "cast(min(ts) as varchar) as created_at, cast(max(ts) as varchar) as updated_at from (select job_id, ts, log_id, "
          "case when level = 'ERROR' then 'failed' when level = 'WARNING' then 'processing' end as status, "
          "case when level <> 'INFO' then message end as message from L) group by job_id")
def q_stream_status(spark, sf):
    from ..streaming.twins import stream_status

    def updates(ev):
        lg = FX.logs_frame(ev)
        # stream-safe partial updates: no per-job sequence inside a micro-batch
        return lg.select("job_id", "ts", "log_id",
                         F.when(F.col("level") == "ERROR", F.lit("failed"))
                         .when(F.col("level") == "WARNING", F.lit("processing")).alias("status"),
                         F.when(F.col("level") != "INFO", F.col("message")).alias("message"))

    r = stream_status(spark, f"{sf}/events.parquet", updates, ["status", "message"])
    return r.select("job_id", "status", "message", F.col("created_at").cast("string").alias("created_at"),
                    F.col("updated_at").cast("string").alias("updated_at"))


@register("stream_delivery", "select s_suppkey as record_number, s_suppkey % 11 <> 0 as ok, case when s_suppkey % 11 = 0 then 500 "
          "else 200 end as status_code, case when s_suppkey % 11 = 0 then 3 when s_suppkey % 7 = 0 then 2 else 1 end as attempts "
          "from supplier join nation on s_nationkey = n_nationkey")
def q_stream_delivery(spark, sf):
    from ..streaming.twins import file_stream, stream_delivery

    sup = file_stream(spark, f"{sf}/supplier.parquet")
    nat = FX.table(spark, sf, "nation")
    rows = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
    pay = rows.select(F.col("s_suppkey").cast("bigint").alias("record_number"),
                      F.to_json(F.struct(F.concat(F.lit("the "), F.lower("n_name"), F.lit(" co "),
                                                  F.col("s_suppkey").cast("string")).alias("Company Name"),
                                         F.col("n_name").alias("Company Location"))).alias("payload"))
    out = stream_delivery(spark, pay, "job_stream", FX.rule_transport(), rate=1000.0, sleep=lambda s: None)
    return out.select("record_number", "ok", "status_code", "attempts")


@register("stream_dedup", _L + "select log_id, job_id, level from L")
def q_stream_dedup(spark, sf):
    from ..streaming.twins import stream_dedup_events

    r = stream_dedup_events(spark, f"{sf}/events.parquet", FX.logs_frame)
    return r.select("log_id", "job_id", "level")



# ---------------------------------------------------------------------------
# Dictionary lookups as joins
# ---------------------------------------------------------------------------

def _email_long(spark, sf):
    """(row, column, email) for the three e-mail columns of P, stripped and lower-cased."""
    p = FX.people_raw(spark, sf)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(X.strip(C(c))).alias("email"))
                                for c in ("work_email", "personal_email", "email_2")])).alias("e")
    return p.select("_row", cells).select("_row", "e.column", "e.email").where(F.col("email").contains("@"))


_E_LONG = ("(select _row, x.c as \"column\", x.e as email from (select row_idx as _row, unnest(["
           + ", ".join(f"{{'c': '{c}', 'e': lower({O.strip(c)})}}" for c in ("work_email", "personal_email", "email_2"))
           + "]) as x from " + _P_RAW + ") where contains(x.e, '@'))")
_RANKS_VALUES = "(values " + ", ".join(f"({O.lit(k)}, {v})" for k, v in PERSONAL_RANKS.items()) + ") r(domain, rank)"


@register("rank_join", f"select e._row, e.\"column\", e.email, r.rank from {_E_LONG} e left join {_RANKS_VALUES} "
          f"on string_split(e.email, '@')[-1] = r.domain")
def q_rank_join(spark, sf):
    ranks = spark.createDataFrame(list(PERSONAL_RANKS.items()), "domain string, rank int")
    e = _email_long(spark, sf)
    # the dimension is the fixed 26-domain dictionary: a proven size bound for broadcasting
    j = e.join(F.broadcast(ranks), X.email_domain(e.email) == ranks.domain, "left")
    return j.select("_row", "column", "email", "rank")


_FREE_VALUES = "(values " + ", ".join(f"({O.lit(d)})" for d in __import__("leadsmith").functions.constants.FREE_PROVIDERS) + ") f(domain)"


@register("free_provider_anti", f"select _row, domain from (select row_idx as _row, {O.domain_from_email('work_email')} "
          f"as domain from {_P_RAW} where contains(work_email, '@')) d where not exists (select 1 from {_FREE_VALUES} "
          f"where f.domain = d.domain)")
def q_free_provider_anti(spark, sf):
    from ..functions.constants import FREE_PROVIDERS

    free = spark.createDataFrame([(d,) for d in FREE_PROVIDERS], "domain string")
    p = FX.people_raw(spark, sf)
    d = p.where(C("work_email").contains("@")).select("_row", X.domain_from_email(C("work_email")).alias("domain"))
    return d.join(F.broadcast(free), "domain", "left_anti").select("_row", "domain")



@register("process_files")
def q_process_files(spark, sf):
    """End to end: two CSV exports -> profile -> alias mapper -> clean -> processed CSV (read back)."""
    from ..sources.csv_scan import read_csv_files
    from .pipeline import process_files

    base = _write_exports(spark, sf)
    res = process_files(spark, [base], "people", _run_dir(spark, "uploads"), job_id="people_job")
    return read_csv_files(spark, [res["path"]])



@register("delivery_status", "select 'job_company' as job_id, rn as record_number, 'processing' as status, "
          "cast(80 + floor(rn / n * 20) as bigint) as progress, rn as webhooks_sent, n as webhooks_total "
          f"from {_RESULTS}")
def q_delivery_status(spark, sf):
    """Process-and-deliver on the company fixture with the deterministic fake receiver."""
    _, (_, _, status) = _job(spark, sf)
    return status.select("job_id", "record_number", "status", "progress", "webhooks_sent", "webhooks_total")


@register("log_query_store", ORACLE["log_query"])
def q_log_query_store(spark, sf):
    """F9 over the date-partitioned log store (written once per call under the checkpoint folder)."""
    path = LG.write_logs(_logs(spark, sf), _run_dir(spark, "logs") + "/events")
    r = LG.query_logs(LG.read_logs(spark, path), start=_WEEK, end=AS_OF, level="error", error_type="HTTP_401",
                      as_of=AS_OF)
    return r.select("log_id", F.col("ts").cast("string").alias("ts"), "job_id", "level", "error_type", "message")


@register("count_records_csv", "select coalesce(source, 'TOTAL') as file, n as records from (select source, count(*) as n "
          f"from {_P_RAW} group by rollup(source))")
def q_count_records_csv(spark, sf):
    from ..sources.csv_scan import count_records

    return count_records(spark, [_write_exports(spark, sf)])


# ---------------------------------------------------------------------------
# Fuzzy record dedup (O2) and fuzzy header match (O1)
# ---------------------------------------------------------------------------

from ..operators import fuzzy as FZ  # noqa: E402


def _normal_sql(c):
    return f"case when {O.m6(c)} then '' else lower(regexp_replace({O.strip(c)}, '\\s+', ' ', 'g')) end"


_M_KEYED = ("m as (select *, case when a = '' and b = '' then 'unique_' || cast(row_idx as varchar) else a || chr(31) || b end as k from ("
            f"select *, {_normal_sql('full_name')} as a, {_normal_sql('company_name')} as b from ({FX.MISSPELT_SQL})))")
_M_LINKS = (
    f"with recursive {_M_KEYED}, "
    "g as (select distinct k, f, substr(' ' || s || ' ', cast(i as int), 3) as t from (select k, f, s, unnest(range(1, length(s) + 1)) as i from ("
    "select distinct k, 0 as f, a as s from m where a || b <> '' union all select distinct k, 1 as f, b as s from m where a || b <> ''))), "
    "z as (select k, count(*) filter (f = 0) as n0, count(*) filter (f = 1) as n1 from g group by k), "
    "sh as (select x.k as u, y.k as v, count(*) filter (x.f = 0) as s0, count(*) filter (x.f = 1) as s1 from g x join g y "
    "on x.f = y.f and x.t = y.t and x.k < y.k group by 1, 2), "
    "l as (select u, v from sh join z p on p.k = u join z q on q.k = v "
    "where s0 * 100 >= (p.n0 + q.n0 - s0) * 60 and s1 * 100 >= (p.n1 + q.n1 - s1) * 60), "
    "r as (select k as x, k as y from (select distinct k from m) union select r.x, case when l.u = r.y then l.v else l.u end from r join l on r.y in (l.u, l.v)), "
    "cl as (select x as k, min(y) as class from r group by x) "
)


@register("fuzzy_links_people", _M_LINKS + "select u as key_u, v as key_v from l")
def q_fuzzy_links_people(spark, sf):
    """O2: the links between misspelt records' keys."""
    keyed = FZ.fuzzy_key(FX.misspelt_people(spark, sf), "people")
    return FZ.fuzzy_links(keyed.select(F.col("_key").alias("key")).distinct())


def _longest_sql(c):
    return f"first({O.strip(c)} order by length({O.strip(c)}) desc, row_idx) filter (where not {O.m7(c)})"


@register("fuzzy_dedup_people", _M_LINKS + ", ".join((
    "select class as _key", "count(*) as _n", "min(row_idx) as _row",
    *(f"case when count(*) = 1 then any_value({c}) else coalesce({_longest_sql(c)}, '') end as \"{n}\"" for c, n in (
        ("full_name", "Full Name"), ("company_name", "Company Name"), ("job_title", "Job Title"))),
    "string_agg(distinct source, '; ' order by source) as \"Source\"")) + " from m join cl using (k) group by class")
def q_fuzzy_dedup_people(spark, sf):
    """O2: one record per class of similar names at similar companies, merged like exact duplicates."""
    return FZ.fuzzy_deduplicate(FX.misspelt_people(spark, sf), "people")


_MISSPELT_HEADERS = {"full_name": "Name Full", "job_title": "jobtitel", "company_name": "Compny_Name", "website": "web-site", "city": "Locaton",
                     "work_email": "work emial", "employees": "Employes Count", "founded": "Founded Yeer", "linkedin": "linkedn url"}
_H_COLS = [_MISSPELT_HEADERS.get(c, c) for c in P_COLS[2:]]
_H_BASE = (f"select {', '.join(f'{O.q(c)} as {O.q(h)}' for c, h in zip(P_COLS[2:], _H_COLS))}, source as \"Source\", "
           f"cast(row_idx as bigint) as _row from {_P_RAW}")


def _sorted_words_sql(x):
    return f"array_to_string(list_sort(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"


def _fuzzy_alias_sql(profile, table_type):
    from ..functions.constants import ALIASES, FUZZY_HEADER_LEAST

    values = ", ".join(f"({O.lit(a.strip().lower().replace('_', ' '))}, {O.lit(std)}, {i}, {j})"
                       for i, (std, al) in enumerate(ALIASES[table_type].items()) for j, a in enumerate(al))
    return (f"select \"Source\", ordinal, column_name, std, std_ord, alias_ord, alias, score from (select *, "
            f"replace(lower({O.strip('column_name')}), '_', ' ') = alias as exact, cast(floor((greatest(length(x), length(y)) - levenshtein(x, y)) "
            "* 100.0 / greatest(length(x), length(y)) + 0.5) as int) as score from (select p.*, a.*, "
            f"{_sorted_words_sql('p.column_name')} as x, {_sorted_words_sql('a.alias')} as y from ({profile}) p, "
            f"(values {values}) a(alias, std, std_ord, alias_ord) where p.kept)) where score >= {FUZZY_HEADER_LEAST} "
            "qualify row_number() over (partition by \"Source\", ordinal, column_name order by exact desc, score desc, std_ord, alias_ord) = 1")


@register("fuzzy_header_match", _fuzzy_alias_sql(O.profile_sql(_H_BASE, _H_COLS), "people"))
def q_fuzzy_header_match(spark, sf):
    """O1: misspelt headers of an export matched to standard headers."""
    p = FX.people_raw(spark, sf).withColumnsRenamed(_MISSPELT_HEADERS)
    return FZ.fuzzy_alias_matches(PR.column_profile(p), "people")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
