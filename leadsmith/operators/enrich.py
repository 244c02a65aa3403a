"""Phase 3 row-local steps (X1-X10, P8), each one ``select`` of built-in expressions.

Order matters and is kept by ``enrich``: split names -> e-mails -> company
domain from work e-mail -> clean domains -> company name from domain ->
normalise. Every step is a narrow transformation (no shuffle), so Spark fuses
them into the scan's stage.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    C, clean_domain, clean_integer, company_name_from_domain, domain_from_email,
    is_free_provider, is_personal_email, m3, m4, normalize_text, personal_rank,
    strip, title_name, WS_CLASS,
)
from ..functions.constants import INTEGER_FIELDS
from .dedup import deduplicate

ROW = "_row"


def _cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW and not c.startswith("__")]


def _select(df: DataFrame, plan: "OrderedDict[str, Column]") -> DataFrame:
    keep = [c for c in df.columns if c == ROW or c.startswith("__")]
    return df.select(*[e.alias(n) for n, e in plan.items()], *keep)


def _identity(df: DataFrame) -> "OrderedDict[str, Column]":
    return OrderedDict((c, C(c)) for c in _cols(df))


# X1 -----------------------------------------------------------------------

def split_names(df: DataFrame) -> DataFrame:
    """Fill missing First/Last Name from Full Name (first / last whitespace token)."""
    cols = _cols(df)
    if "Full Name" not in cols:
        return df
    null = F.lit(None).cast("string")
    first = C("First Name") if "First Name" in cols else null
    last = C("Last Name") if "Last Name" in cols else null
    bound = df.select("*", F.split(strip(C("Full Name")), WS_CLASS + "+").alias("__parts"))
    parts = F.col("__parts")
    full_ok = ~m3(C("Full Name"))
    plan = _identity(df)
    plan["First Name"] = F.when(full_ok & m3(first) & (F.size(parts) >= 1), F.get(parts, 0)).otherwise(first)
    plan["Last Name"] = F.when(full_ok & m3(last) & (F.size(parts) >= 2),
                               F.get(parts, F.size(parts) - 1)).otherwise(last)
    return _select(bound, plan).drop("__parts")


# X3 / P8 ------------------------------------------------------------------

def email_columns(cols: list[str]) -> list[str]:
    return [c for c in cols if "email" in c.lower()]


def collected_emails(cols: list[str]) -> Column:
    """Valid (M4) e-mail values of a row, stripped + lower-cased, in column order."""
    arr = F.array(*[F.when(~m4(C(c)), F.lower(strip(C(c)))) for c in email_columns(cols)])
    return F.filter(arr, lambda e: e.isNotNull())


def best_personal(emails: Column) -> Column:
    """Best-ranked personal address, first on ties (null if none)."""
    personal = F.filter(emails, lambda e: is_personal_email(e))
    scored = F.transform(personal, lambda e, i: F.struct(personal_rank(e).alias("r"), (-i).alias("p"), e.alias("e")))
    return F.array_max(scored)["e"]


def first_work(emails: Column) -> Column:
    return F.get(F.filter(emails, lambda e: ~is_personal_email(e)), 0)


def enrich_emails(df: DataFrame) -> DataFrame:
    """Personal Email = best personal, Work Email = first other; other e-mail columns -> ''."""
    cols = _cols(df)
    ecols = email_columns(cols)
    bound = df.select("*", collected_emails(cols).alias("__emails"))
    emails = F.col("__emails")
    plan = _identity(df)
    for c in ecols:
        if c not in ("Personal Email", "Work Email"):
            plan[c] = F.lit("")
    plan["Personal Email"] = F.coalesce(best_personal(emails), F.lit(""))
    plan["Work Email"] = F.coalesce(first_work(emails), F.lit(""))
    return _select(bound, plan).drop("__emails")


# X5 -----------------------------------------------------------------------

def work_email_usable(we: Column) -> Column:
    return (we.isNotNull() & (strip(we) != "") & we.contains("@")
            & ~F.lower(we).isin("nan", "none", "null", ""))


def enrich_company_domain(df: DataFrame) -> DataFrame:
    """Missing Company Domain <- domain of the work e-mail unless a free provider."""
    cols = _cols(df)
    if "Company Domain" not in cols or "Work Email" not in cols:
        return df
    dom = domain_from_email(C("Work Email"))
    plan = _identity(df)
    plan["Company Domain"] = (
        F.when(m3(C("Company Domain")) & work_email_usable(C("Work Email")) & ~is_free_provider(dom), dom)
        .otherwise(C("Company Domain"))
    )
    return _select(df, plan)


# X6 -----------------------------------------------------------------------

def domain_columns(cols: list[str]) -> list[str]:
    return [c for c in cols if "domain" in c.lower() or "website" in c.lower()]


def clean_domains(df: DataFrame) -> DataFrame:
    plan = _identity(df)
    for c in domain_columns(list(plan)):
        plan[c] = clean_domain(C(c))
    return _select(df, plan)


# X7 -----------------------------------------------------------------------

def enrich_company_name(df: DataFrame) -> DataFrame:
    """Missing Company Name <- capitalised words of the (clean) domain."""
    cols = _cols(df)
    if "Company Domain" not in cols:
        return df
    name = C("Company Name") if "Company Name" in cols else F.lit("")
    gen = company_name_from_domain(C("Company Domain"))
    plan = _identity(df)
    plan["Company Name"] = F.when(m3(name) & ~m3(C("Company Domain")) & gen.isNotNull(), gen).otherwise(name)
    return _select(df, plan)


# X8-X10 -------------------------------------------------------------------

def name_columns(cols: list[str]) -> list[str]:
    return [c for c in cols if "name" in c.lower() or "title" in c.lower()]


def normalize(df: DataFrame) -> DataFrame:
    """Whitespace on every column but Source, title case on name/title, integer clean."""
    plan = _identity(df)
    names = set(name_columns(list(plan)))
    for c in list(plan):
        if c == "Source":
            continue
        v = normalize_text(C(c))
        if c in names:
            v = title_name(v)
        if c in INTEGER_FIELDS:
            v = clean_integer(v)
        plan[c] = v
    return _select(df, plan)


def enrich(df: DataFrame) -> DataFrame:
    """All row-local Phase 3 steps in their fixed order."""
    df = split_names(df)
    df = enrich_emails(df)
    df = enrich_company_domain(df)
    df = clean_domains(df)
    df = enrich_company_name(df)
    return normalize(df)


def enrich_with_stats(df: DataFrame) -> DataFrame:
    """``enrich`` plus per-row flags (``__*`` columns) that ``enrich_stats`` counts."""
    cols = _cols(df)
    if "Full Name" in cols:
        first = C("First Name") if "First Name" in cols else F.lit(None).cast("string")
        last = C("Last Name") if "Last Name" in cols else F.lit(None).cast("string")
        n = F.size(F.split(strip(C("Full Name")), WS_CLASS + "+"))
        split = ~m3(C("Full Name")) & (m3(first) | m3(last)) & ((n >= 2) | ((n == 1) & m3(first)))
    else:
        split = F.lit(False)
    df = df.withColumn("__names_split", split)
    df = split_names(df)
    emails = collected_emails(_cols(df))
    df = (df.withColumn("__personal", F.size(F.filter(emails, lambda e: is_personal_email(e))) > 0)
            .withColumn("__work", F.size(F.filter(emails, lambda e: ~is_personal_email(e))) > 0))
    df = enrich_emails(df)
    cols = _cols(df)
    if "Company Domain" in cols and "Work Email" in cols:
        dom = domain_from_email(C("Work Email"))
        df = df.withColumn("__domain_enriched", m3(C("Company Domain")) & work_email_usable(C("Work Email"))
                           & ~is_free_provider(dom))
    else:
        df = df.withColumn("__domain_enriched", F.lit(False))
    df = enrich_company_domain(df)
    df = df.withColumn("__domains_cleaned", changed_domains(df))
    df = clean_domains(df)
    cols = _cols(df)
    if "Company Domain" in cols:
        name = C("Company Name") if "Company Name" in cols else F.lit("")
        gen = company_name_from_domain(C("Company Domain"))
        df = df.withColumn("__name_generated", m3(name) & ~m3(C("Company Domain")) & gen.isNotNull())
    else:
        df = df.withColumn("__name_generated", F.lit(False))
    df = enrich_company_name(df)
    return normalize(df)


def changed_domains(df: DataFrame) -> Column:
    """Domain cells of a row that cleaning would change."""
    cols = domain_columns(_cols(df))
    changed = [F.when(C(c).isNull() | (C(c) != clean_domain(C(c))), 1).otherwise(0) for c in cols]
    return sum(changed[1:], changed[0]) if changed else F.lit(0)


def enrich_stats(flagged: DataFrame, table_type: str | None = None) -> DataFrame:
    """A8 counters from ``enrich_with_stats`` flags.

    With ``table_type`` the cells that the pass after the dedup changes count as well: each row's flags go through the
    dedup's own aggregate as sums, so the input is read and enriched once.
    """
    flag = lambda c: c.cast("bigint")
    counters = {
        "personal_emails_ranked": flag(F.col("__personal")),
        "work_emails_identified": flag(F.col("__work")),
        "emails_enriched": flag(F.col("__personal") | F.col("__work")),
        "names_split": flag(F.col("__names_split")),
        "domains_enriched": flag(F.col("__domain_enriched")),
        "domains_cleaned": flag(F.col("__domains_cleaned")),
        "company_names_generated": flag(F.col("__name_generated")),
    }
    names = tuple(f"__sum_{c}" for c in counters)
    rows = flagged.withColumns({f"__sum_{c}": F.coalesce(v, F.lit(0)) for c, v in counters.items()})
    if table_type is not None:
        rows = deduplicate(rows, table_type, normalized=True, carried=names)
        rows = rows.withColumn("__sum_domains_cleaned", F.col("__sum_domains_cleaned") + changed_domains(rows))
    return rows.agg(*[F.coalesce(F.sum(f"__sum_{c}"), F.lit(0)).cast("bigint").alias(c) for c in counters])
