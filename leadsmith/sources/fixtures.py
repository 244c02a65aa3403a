"""Lead fixtures derived from the driver tables.

The same SQL text runs on Spark and on DuckDB, so the oracle and the Spark
plans start from identical rows. Fixture rows scale with the source tables
(customer / supplier / events), so every query's work grows with them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# People fixture "P": messy merged export from two sources (crm_a.csv, crm_b.csv). Row numbers hold the file in
# their high bits, as the CSV source numbers them.
PEOPLE_SQL = """
select cast(d.dup as bigint) * 8589934592 + c_custkey as row_idx,
 case when d.dup=0 then 'crm_a.csv' else 'crm_b.csv' end as source,
 c_custkey as person_key,
 case when c_custkey % 11 = 3 then 'nan' else concat('jo-ann  o''neil ', lower(c_mktsegment), cast(c_custkey % 400 as varchar(10))) end as full_name,
 case when c_custkey % 3 = 0 then cast(null as varchar(10)) when c_custkey % 3 = 1 then '' else 'ANN' end as first_name,
 case when c_custkey % 4 = 0 then 'None' when c_custkey % 4 = 1 then '   ' else 'mcDONALD' end as last_name,
 case when d.dup=0 then 'vp-sales' else '  head  of  SALES ' end as job_title,
 case when c_custkey % 5 = 0 then cast(null as varchar(10)) else concat('linkedin.com/in/p', cast(c_custkey % 400 as varchar(10))) end as linkedin,
 case c_custkey % 6 when 0 then cast(null as varchar(10)) when 1 then concat('P', cast(c_custkey % 400 as varchar(10)), '@Gmail.com') when 2 then concat(' p', cast(c_custkey % 400 as varchar(10)), '@acme-', lower(n_name), '.io ') else concat('p', cast(c_custkey % 400 as varchar(10)), '@corp', cast(c_nationkey as varchar(10)), '.com') end as work_email,
 case c_custkey % 7 when 0 then 'nan' when 1 then 'x@hotmail.com' when 2 then 'y@yahoo.fr' else cast(null as varchar(10)) end as personal_email,
 case when c_custkey % 9 = 0 then 'z@outlook.com' when c_custkey % 9 = 1 then 'n/a-noat' else '' end as email_2,
 case when c_custkey % 4 = 2 then '' else concat('corp ', cast(c_nationkey as varchar(10))) end as company_name,
 case c_custkey % 8 when 0 then concat('HTTPS://WWW.Corp', cast(c_nationkey as varchar(10)), '.com/about?x=1') when 1 then 'foo.com, bar.com' when 2 then 'acme-labs.io,***redacted**' when 3 then '[redacted]' when 4 then 'null' else cast(null as varchar(10)) end as website,
 case when d.dup=0 then concat(cast(c_custkey % 500 as varchar(10)), '.5') else '50-100' end as employees,
 case when c_custkey % 2 = 0 then '1999.0' else '' end as founded,
 n_name as city
from (select c.*, n.*, 0 as dup from customer c join nation n on c.c_nationkey = n.n_nationkey
 union all
 select c.*, n.*, 1 as dup from customer c join nation n on c.c_nationkey = n.n_nationkey
 where c.c_custkey % 3 <> 0) d
"""

# Mapping spec for P (as the external mapper would answer it).
PEOPLE_SPEC = {
    "mapped_files": [
        {
            "filename": "crm_a.csv",
            "mapped_headers": {
                "Full Name": {"primary": "full_name"},
                "First Name": {"primary": "first_name"},
                "Last Name": {"primary": "last_name"},
                "Job Title": {"primary": "job_title"},
                "LinkedIn Profile": {"primary": "linkedin"},
                "Person Location": {"primary": "city"},
                "Work Email": {"primary": "work_email", "secondary": "email_2"},
                "Personal Email": {"primary": "personal_email"},
                "Company Name": {"primary": "company_name"},
                "Company Domain": {"primary": "website"},
                "Company Employee Count": {"primary": "employees"},
                "Year Founded": {"primary": "founded"},
            },
        },
        {
            "filename": "crm_b.csv",
            "mapped_headers": {
                "Full Name": {"primary": "full_name"},
                "Work Email": {"primary": "work_email", "secondary": "email_2"},
            },
        },
    ]
}

# Company fixture "C": three exports of supplier rows.
COMPANY_SQL = """
select cast(d.dup as bigint) * 8589934592 + s_suppkey as row_idx, concat('export_', cast(d.dup as varchar(2)), '.csv') as source,
 case when s_suppkey % 4 = 1 then '' else concat('the ', lower(n_name), ' co ', cast(s_suppkey as varchar(10))) end as company_name,
 case when d.dup = 0 then concat('https://www.Shop-', cast(s_suppkey as varchar(10)), '.io/?utm=1') when d.dup = 1 then concat('shop-', cast(s_suppkey as varchar(10)), '.io, ***redacted***') else cast(null as varchar(10)) end as domain_url,
 case when s_suppkey % 3 = 0 then concat('linkedin.com/company/s', cast(s_suppkey as varchar(10))) end as linkedin_account,
 case when d.dup = 0 then concat('info@shop', cast(s_suppkey as varchar(10)), '.io:sales@shop', cast(s_suppkey as varchar(10)), '.io;info@shop', cast(s_suppkey as varchar(10)), '.io') when d.dup = 1 then concat('hello@shop', cast(s_suppkey as varchar(10)), '.io') else 'n/a' end as emails,
 cast(round(s_acctbal) as varchar(20)) as employee_count,
 cast(1950 + s_suppkey % 70 as varchar(10)) as founded, n_name as hq
from (select s.*, n.*, 0 as dup from supplier s join nation n on s.s_nationkey = n.n_nationkey
 union all
 select s.*, n.*, 1 as dup from supplier s join nation n on s.s_nationkey = n.n_nationkey
 union all
 select s.*, n.*, 2 as dup from supplier s join nation n on s.s_nationkey = n.n_nationkey
 where s.s_suppkey % 5 = 0) d
"""

# Mapping spec for C: domain_url, linkedin_account and employee_count are left
# for the variant consolidation to pick up.
COMPANY_SPEC = [
    {
        "mapped_files": [
            {
                "filename": "export_0.csv",
                "mapped_headers": {
                    "Company Name": {"primary": "company_name"},
                    "Year Founded": {"primary": "founded"},
                    "Company Location": {"primary": "hq"},
                },
            }
        ]
    }
]

# Fixture "M": people from three exports, some of whose names or companies are misspelt in the second and third. Every third
# person works for one and the same company.
MISSPELT_SQL = """
with c as (
 select c_custkey as k,
  concat(translate(substring(md5(concat('f', cast(c_custkey % 700 as varchar(10)))), 1, 7), '0123456789', 'ghijklmnop'), ' ',
   translate(substring(md5(concat('l', cast(c_custkey % 700 as varchar(10)))), 1, 9), '0123456789', 'ghijklmnop')) as name,
  case when c_custkey % 3 = 0 then 'Global  Freight Holding'
   else concat(translate(substring(md5(cast(c_custkey % 140 as varchar(10))), 1, 10), '0123456789', 'qrstuvwxyz'), ' ltd') end as company
 from customer
)
select cast(0 as bigint) * 8589934592 + k as row_idx, 'crm_0.csv' as source, name as full_name, company as company_name,
 concat('role ', cast(k % 9 as varchar(10))) as job_title from c
union all
select cast(1 as bigint) * 8589934592 + k, 'crm_1.csv', case when k % 4 = 1 then concat(substring(name, 1, 3), substring(name, 5, 20))
  when k % 4 = 2 then upper(name) when k % 8 = 3 then '' else name end,
 case when k % 5 = 1 then concat(company, '.') when k % 8 = 3 then 'nan' else company end, concat('senior role ', cast(k % 7 as varchar(10)))
from c where k % 2 = 1
union all
select cast(2 as bigint) * 8589934592 + k, 'crm_2.csv', concat(name, 'x'), company, cast(null as varchar(10)) from c where k % 5 = 2
"""

# Log view "L" over events (one row per structured log event).
LOGS_SQL = """
select event_id as log_id,
 ts as ts,
 event_id as record_number,
 concat('job_', cast(user_id as varchar(20))) as job_id,
 case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end as level,
 case when event_type <> 'error' then cast(null as varchar(10))
      when event_id % 7 = 0 then cast(null as varchar(10))
      else concat('HTTP_', cast(400 + event_id % 4 as varchar(10))) end as error_type,
 case event_type when 'error' then 429 when 'signup' then 500 else 200 end as status_code,
 concat(event_type, ' event ', cast(event_id as varchar(20))) as message,
 value as duration,
 props as metadata
from events
"""

# Evaluation clock for the log fixture (day after the last event).
LOGS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """The fixture tables are one small file each: spread their rows, as a folder of exports would be."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the driver parquet tables as temp views (lazy; nothing is read)."""
    for t in names or TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def people_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture P with merged-table column names: Source and the _row identity."""
    register_tables(spark, sf_dir, ["customer", "nation"])
    df = _spread(spark.sql(PEOPLE_SQL))
    cols = [c for c in df.columns if c not in ("row_idx", "source")]
    return df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in cols], "source as Source",
                         "cast(row_idx as bigint) as _row")


def company_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["supplier", "nation"])
    df = _spread(spark.sql(COMPANY_SQL))
    cols = [c for c in df.columns if c not in ("row_idx", "source")]
    return df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in cols], "source as Source",
                         "cast(row_idx as bigint) as _row")


def misspelt_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture M with standard headers."""
    register_tables(spark, sf_dir, ["customer"])
    return _spread(spark.sql(MISSPELT_SQL)).selectExpr(
        "full_name as `Full Name`", "company_name as `Company Name`", "job_title as `Job Title`", "source as Source", "row_idx as _row")


# The same view as DataFrame expressions (usable on a streaming events source).
LOGS_EXPRS = [
    "event_id as log_id",
    "ts as ts",
    "event_id as record_number",
    "concat('job_', cast(user_id as string)) as job_id",
    "case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end as level",
    "case when event_type <> 'error' then cast(null as string) when event_id % 7 = 0 then cast(null as string) "
    "else concat('HTTP_', cast(400 + event_id % 4 as string)) end as error_type",
    "case event_type when 'error' then 429 when 'signup' then 500 else 200 end as status_code",
    "concat(event_type, ' event ', cast(event_id as string)) as message",
    "value as duration",
    "props as metadata",
]


def logs_frame(events: DataFrame) -> DataFrame:
    return events.selectExpr(*LOGS_EXPRS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_frame(table(spark, sf_dir, "events"))


# Fake receivers for checks and tests (nothing in the library uses them).

def scripted_transport(codes: dict[int, list[int]], default: int = 200):
    """Per record a list of status codes by attempt (the last one repeats)."""
    def factory():
        def send(payload, rn, attempt):
            seq = codes.get(rn, [default])
            code = seq[min(attempt, len(seq) - 1)]
            return code, json.dumps({"code": code})
        return send
    return factory


def rule_transport(fail_every: int = 11, throttle_every: int = 7):
    """500 for every ``fail_every``-th record, one 429 then 200 for every ``throttle_every``-th, 200 otherwise."""
    def factory():
        def send(payload, rn, attempt):
            if fail_every and rn % fail_every == 0:
                return 500, "server error"
            if throttle_every and rn % throttle_every == 0 and attempt == 0:
                return 429, "slow down"
            return 200, "ok"
        return send
    return factory


def status_updates(logs: DataFrame) -> DataFrame:
    """Partial status updates derived from the log fixture (absent field = null)."""
    from ..operators.logs import with_job_sequence

    return with_job_sequence(logs).select(
        "job_id", "ts", "log_id", "seq",
        F.when(F.col("level") == "ERROR", F.lit("failed")).when(F.col("level") == "WARNING", F.lit("processing"))
        .alias("status"),
        F.least(F.lit(100), F.floor(F.col("seq") / 15) * 10).cast("bigint").alias("progress"),
        F.when(F.col("level") != "INFO", F.col("message")).alias("message"),
    )
