"""Composite-key dedup with longest-value merge.

Plan shape (skew-safe, no group is ever collected):

1. key column (``concat_ws`` over non-missing key parts, else ``unique_<row>``);
2. one aggregate by key with map-side partials: per column the best candidate
   ``max(struct(length, -row, value))``, the row count, the first row, and the
   set of (file ordinal, Source), at most one entry per source file. The file
   ordinal is the high bits of ``_row`` (see ``sources.csv_scan``), so the order
   of first appearance needs no aggregate of its own.

A key holding a third of all rows is reduced to one row per map task before
the first exchange, so no task ever sees the hot group whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import C, m6, m7, strip
from ..functions.constants import DEDUP_KEYS

ROW = "_row"
KEY = "_key"


def dedup_key(cols: list[str], table_type: str, row: Column | None = None) -> Column:
    """A3: lower(strip) of non-missing (M6) key values joined by '|', else unique_<row>."""
    row = F.col(ROW) if row is None else row
    keys = [k for k in DEDUP_KEYS[table_type] if k in cols]
    parts = [F.when(~m6(C(k)), F.lower(strip(C(k)))) for k in keys]
    joined = F.concat_ws("|", *parts) if parts else F.lit("")
    return F.when(joined == "", F.concat(F.lit("unique_"), row.cast("string"))).otherwise(joined)


def _data_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW, KEY) and not c.startswith("__")]


def with_key(df: DataFrame, table_type: str) -> DataFrame:
    return df.withColumn(KEY, dedup_key(_data_cols(df), table_type))


def _best(c: Column, normalized: bool = False) -> Column:
    """Longest stripped non-missing (M7) value, earliest row on ties.

    ``normalized``: values are already stripped and non-null (Phase-3 output),
    so stripping again is skipped; the result is identical.
    """
    if normalized:
        missing = c.isNull() | (c == "") | F.lower(c).isin("nan", "none")
        return F.when(~missing, F.struct(F.length(c).alias("n"), (-F.col(ROW)).alias("r"), c.alias("v")))
    t = strip(c)
    return F.when(~m7(c), F.struct(F.length(t).alias("n"), (-F.col(ROW)).alias("r"), t.alias("v")))


FILE_BITS = 33


def partial_aggs(cols: list[str], normalized: bool = False) -> list[Column]:
    """Aggregates of one batch of keyed rows; ``fold_aggs`` folds any number of their results."""
    aggs = [F.count(F.lit(1)).alias("__n"), F.min(ROW).alias("__first")]
    for i, c in enumerate(c for c in cols if c != "Source"):
        best = _best(C(c), normalized)
        aggs.append(F.max(best).alias(f"__c{i}b"))
        # the raw value is carried only where it differs from its candidate: rows stay small
        aggs.append(F.any_value(F.when(best.isNull() | (best["v"] != C(c)), C(c))).alias(f"__c{i}r"))
    if "Source" in cols:
        at = F.struct(F.shiftright(ROW, FILE_BITS).alias("f"), strip(C("Source")).alias("s"))
        aggs.append(F.collect_set(F.when(~m7(C("Source")), at)).alias("__srcs"))
        aggs.append(F.any_value(C("Source")).alias("__src_raw"))
    return aggs


def fold_aggs(cols: list[str]) -> list[Column]:
    aggs = [F.sum("__n").alias("__n"), F.min("__first").alias("__first")]
    for i in range(len([c for c in cols if c != "Source"])):
        aggs += [F.max(f"__c{i}b").alias(f"__c{i}b"), F.any_value(f"__c{i}r").alias(f"__c{i}r")]
    if "Source" in cols:
        aggs += [F.array_distinct(F.flatten(F.collect_list("__srcs"))).alias("__srcs"),
                 F.any_value("__src_raw").alias("__src_raw")]
    return aggs


def merged_rows(whole: DataFrame, cols: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Final records from the aggregates of whole keys: size-1 groups keep their raw values."""
    single = F.col("__n") == 1
    ids = {c: f"__c{i}" for i, c in enumerate(c for c in cols if c != "Source")}
    out = []
    for c in cols:
        if c == "Source":
            merged = F.array_join(F.array_distinct(F.transform(F.array_sort("__srcs"), lambda x: x["s"])), "; ")
            out.append(F.when(single, F.col("__src_raw")).otherwise(merged).alias("Source"))
        else:
            best_v = F.col(ids[c] + "b")["v"]
            raw = F.coalesce(ids[c] + "r", best_v)
            out.append(F.when(single, raw).otherwise(F.coalesce(best_v, F.lit(""))).alias(c))
    return whole.select(*out, F.col("__first").alias(ROW), F.col(KEY), F.col("__n").alias("_n"), *carried)


def merge_duplicates(keyed: DataFrame, normalized: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """A4/A5: one row per key, columns in input order, plus _key (for ordering) and _n.

    ``carried``: number columns (named ``__...``) that come along as sums over their key.
    """
    cols = _data_cols(keyed)
    sums = [F.sum(c).alias(c) for c in carried]
    return merged_rows(keyed.groupBy(KEY).agg(*partial_aggs(cols, normalized), *sums), cols, carried)


def deduplicate(df: DataFrame, table_type: str, normalized: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Key + merge. Output order is defined by ``_key`` (callers sort only when they need order)."""
    cols = _data_cols(df)
    if not any(k in cols for k in DEDUP_KEYS[table_type]):
        return df.withColumn(KEY, F.concat(F.lit("unique_"), F.col(ROW).cast("string"))).withColumn("_n", F.lit(1).cast("bigint"))
    return merge_duplicates(with_key(df, table_type), normalized, carried)


def dedup_stats(keyed: DataFrame) -> DataFrame:
    """Rows in, groups out, duplicates removed = sum(size - 1)."""
    g = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").cast("bigint").alias("rows_in"),
                 F.count(F.lit(1)).cast("bigint").alias("rows_out"),
                 (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("duplicates_removed"))
