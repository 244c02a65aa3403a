"""Per-record JSON payloads.

Payloads are built with ``struct`` / ``map_filter`` / ``to_json`` — one
projection, no Python. Field order follows the record's column order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import C, split_multi_emails
from ..functions.constants import COMPANY_FIELDS, PAYLOAD_PERSON_FIELDS, PAYLOAD_SOURCE_LABEL

INTERNAL = ("_row", "_key", "_n", "record_number")


def data_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL and not c.startswith("__")]


def repair_headers(df: DataFrame) -> DataFrame:
    """P10: 'Linked In' -> 'LinkedIn' inside column names."""
    return df.select(*[C(c).alias(c.replace("Linked In", "LinkedIn")) if c not in INTERNAL else C(c)
                       for c in df.columns])


def record_emails(df: DataFrame) -> Column:
    """Distinct addresses over all e-mail fields, first-seen order."""
    ecols = [c for c in data_cols(df) if "email" in c.lower()]
    if not ecols:
        return F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[split_multi_emails(C(c)) for c in ecols])))


def number_emails(df: DataFrame) -> DataFrame:
    """The record's distinct addresses as ``__emails``; ``payloads`` gives it its own Company Email 1..n."""
    return df.withColumn("__emails", record_emails(df))


def email_fields(emails: Column) -> Column:
    """Map 'Company Email k' -> k-th address: as many keys as the record has addresses."""
    return F.map_from_entries(F.transform(emails, lambda e, i: F.struct(
        F.concat(F.lit("Company Email "), (i + 1).cast("string")).alias("key"), e.alias("value"))))


def _inner(json: Column) -> Column:
    """What stands between the braces of a JSON object; null if nothing does."""
    return F.when(F.length(json) > 2, F.substring(json, F.lit(2), F.length(json) - 2))


def _fields(cols, wanted) -> list[str]:
    return [c for c in cols if c in wanted]


def additional_map(cols: list[str]) -> Column:
    """Every non-standard field that is not null and not ''."""
    std = set(PAYLOAD_PERSON_FIELDS) | set(COMPANY_FIELDS) | {"Source"}
    extra = [c for c in cols if c not in std and not c.startswith("Company Email ")]
    if not extra:
        return F.create_map().cast("map<string,string>")
    m = F.create_map(*[x for c in extra for x in (F.lit(c), C(c).cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def _struct(cols) -> Column:
    return F.struct(*[C(c).alias(c) for c in cols]) if cols else F.struct(F.lit(None).alias("_"))


def company_payload(df: DataFrame, record_number: Column, ts: Column) -> Column:
    """Standard company fields, numbered e-mails, additional fields and metadata as one JSON object."""
    cols = data_cols(df)
    options = {"ignoreNullFields": "false"}
    add = additional_map(cols)
    meta = F.struct(record_number.alias("record_number"), ts.alias("timestamp"),
                    F.lit(PAYLOAD_SOURCE_LABEL).alias("source"), F.size(add).alias("total_additional_fields"))
    top = [c for c in cols if c in set(COMPANY_FIELDS) | {"Source"}]
    parts = [_inner(F.to_json(_struct(top), options))] if top else []
    if "__emails" in df.columns:
        parts.append(_inner(F.to_json(email_fields(F.col("__emails")))))
    parts.append(_inner(F.to_json(F.struct(add.alias("additional_fields"), meta.alias("_metadata")), options)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def payload_struct(df: DataFrame, table_type: str, record_number: Column, ts: Column) -> Column:
    cols = data_cols(df)
    if table_type == "people":
        add = additional_map(cols)
        meta = F.struct(record_number.alias("record_number"), ts.alias("timestamp"),
                        F.lit(PAYLOAD_SOURCE_LABEL).alias("source"), F.size(add).alias("total_additional_fields"))
        src = [C("Source").alias("Source")] if "Source" in cols else []
        return F.struct(_struct(_fields(cols, PAYLOAD_PERSON_FIELDS)).alias("person"),
                        _struct(_fields(cols, COMPANY_FIELDS)).alias("company"),
                        *src, add.alias("additional_fields"), meta.alias("_metadata"))
    meta = F.struct(record_number.alias("record_number"), ts.alias("timestamp"),
                    F.lit(PAYLOAD_SOURCE_LABEL).alias("source"))
    return F.struct(*[C(c).alias(c) for c in cols], meta.alias("_metadata"))


def payloads(df: DataFrame, table_type: str, timestamp: int, record_col: str = "record_number") -> DataFrame:
    """(record_number, payload JSON text); nulls are kept as JSON null."""
    fixed = repair_headers(df)
    number, stamp = F.col(record_col).cast("bigint"), F.lit(int(timestamp)).cast("bigint")
    if table_type == "company":
        body = company_payload(fixed, number, stamp)
    else:
        body = F.to_json(payload_struct(fixed, table_type, number, stamp), {"ignoreNullFields": "false"})
    return fixed.select(number.alias("record_number"), body.alias("payload"))
