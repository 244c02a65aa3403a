"""Phase 2: mapping spec -> standard schema.

The spec and the column list are metadata (files x headers); they are read on
the driver to *plan* one projection. Rows never leave the executors: every
operator here is a single ``select`` of built-in expressions.
"""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import C, m1, m2, m2_target, strip
from ..functions.constants import CONSOLIDATION_RULES, standard_fields

PRIORITIES = ("primary", "secondary", "tertiary")
ROW = "_row"


# ---------------------------------------------------------------------------
# Mapping spec
# ---------------------------------------------------------------------------

def _unwrap(spec):
    if isinstance(spec, (str, bytes)):
        spec = json.loads(spec)
    if not spec:
        raise ValueError("mapping spec is empty")
    if isinstance(spec, list):
        spec = spec[0]
    files = spec.get("mapped_files") if isinstance(spec, dict) else None
    if not files:
        raise ValueError("mapping spec has no 'mapped_files'")
    return files


def plan_mappings(spec) -> "OrderedDict[str, dict[str, list]]":
    """Fold all files' specs: std -> {priority: [source columns]} distinct, file order.

    ``spec`` is the mapper's answer, or the table of ``read_mapping_spec`` / ``mapping_table``, folded by Spark: one
    collected row per mapped header.
    """
    merged: OrderedDict = OrderedDict()
    if isinstance(spec, DataFrame):
        rows = merged_mapping_table(spec).orderBy("first_seen", "prio_ord").select("std", "priority", "source_col").collect()
        for std, priority, source_col in rows:
            merged.setdefault(std, {p: [] for p in PRIORITIES})[priority].append(source_col)
        return merged
    for fm in _unwrap(spec):
        for std, pm in (fm.get("mapped_headers") or {}).items():
            slot = merged.setdefault(std, {p: [] for p in PRIORITIES})
            for p in PRIORITIES:
                if p in pm and pm[p] not in slot[p]:
                    slot[p].append(pm[p])
    return merged


FILES_TYPE = "array<struct<filename string, mapped_headers map<string, map<string, string>>>>"
SPEC_TYPE = f"mapped_files {FILES_TYPE}, _malformed string"


def mapping_table(spark: SparkSession, spec) -> DataFrame:
    """Spec as a table (file_ord, filename, std, priority, source_col)."""
    # as JSON text: a dict that becomes a map column by itself loses the order of its entries
    text = spark.createDataFrame([(json.dumps(_unwrap(spec)),)], "value string")
    return _spec_entries(text.select(F.from_json("value", FILES_TYPE).alias("mapped_files")))


def read_mapping_spec(spark: SparkSession, path: str) -> DataFrame:
    """A mapper's answer in a JSON file as the table of ``mapping_table``.

    The file holds one object, or an array whose first item counts. Text that is not such JSON, headers of another shape
    and an answer without mapped files fail with the file's name; so does a folder of several files.
    """
    text = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("body"))
    if len(text.inputFiles()) != 1:
        raise ValueError(f"{path} holds {len(text.inputFiles())} files; a mapping spec is one")
    at = spark._jvm.org.apache.hadoop.fs.Path(text.inputFiles()[0])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() == 0:  # a scan skips such files
        raise ValueError(f"mapping spec is empty or malformed: {at.toString()}")
    body, options = F.col("body"), {"columnNameOfCorruptRecord": "_malformed"}
    listed = F.get(F.from_json(body, f"array<struct<{SPEC_TYPE}>>", options), F.lit(0))
    spec = F.when(F.startswith(strip(body), F.lit("[")), listed).otherwise(F.from_json(body, f"struct<{SPEC_TYPE}>", options))
    read = text.select("path", spec.alias("spec"))

    def fail(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"mapping spec {reason}: "), F.col("path"))).cast(FILES_TYPE)

    files = (F.when(F.col("spec").isNull() | F.col("spec._malformed").isNotNull(), fail("is empty or malformed"))
             .when(F.coalesce(F.size("spec.mapped_files"), F.lit(0)) <= 0, fail("has no 'mapped_files'"))
             .otherwise(F.col("spec.mapped_files")))
    return _spec_entries(read.select(files.alias("mapped_files")))


def _spec_entries(spec: DataFrame) -> DataFrame:
    """The entries of a spec's ``mapped_files``, in its order."""
    files = spec.select(F.posexplode("mapped_files").alias("file_ord", "f")).select("file_ord", "f.*")
    std = files.select("file_ord", "filename", F.posexplode("mapped_headers").alias("std_ord", "std", "pm"))
    pr = std.select("file_ord", "filename", "std_ord", "std",
                    F.explode(F.array(*[F.struct(F.lit(i).alias("prio_ord"), F.lit(p).alias("priority"),
                                                 F.col("pm")[p].alias("source_col"))
                                        for i, p in enumerate(PRIORITIES)])).alias("x"))
    return (pr.select("file_ord", "filename", "std_ord", "std", "x.prio_ord", "x.priority", "x.source_col")
            .where(F.col("source_col").isNotNull()))


def merged_mapping_table(mapping: DataFrame) -> DataFrame:
    """P2 on the spec table: one row per (std, priority, source_col), first-seen order."""
    return (mapping.groupBy("std", "priority", "prio_ord", "source_col")
            .agg(F.min(F.struct("file_ord", "std_ord")).alias("first_seen")))


# ---------------------------------------------------------------------------
# Priority coalesce, standard projection, unmapped preservation
# ---------------------------------------------------------------------------

def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW and not c.startswith("__")]


def priority_coalesce(cols: list[str], mapping: dict) -> Column:
    """First non-missing (M1) value over primary -> secondary -> tertiary; else ''."""
    cands = [c for p in PRIORITIES for c in mapping.get(p, []) if c and c in cols]
    return F.coalesce(*[F.when(~m1(C(c)), C(c)) for c in cands], F.lit(""))


def standardize_plan(columns: list[str], spec, table_type: str) -> "OrderedDict[str, Column]":
    merged = plan_mappings(spec)
    out: OrderedDict = OrderedDict()
    for h in standard_fields(table_type):
        out[h] = priority_coalesce(columns, merged[h]) if h in merged else F.lit("")
    out["Source"] = C("Source")
    used = {"Source"}
    for slot in merged.values():
        for p in PRIORITIES:
            used.update(c for c in slot[p] if c and isinstance(c, str))
    for c in columns:
        if c not in used:
            out[c] = C(c)  # same name as a standard header: overwrites it in place
    return out


def consolidate_plan(out: "OrderedDict[str, Column]", table_type: str) -> "OrderedDict[str, Column]":
    """Fill an empty target from each variant (case-insensitive), drop variants."""
    out = OrderedDict(out)
    for target, variants in CONSOLIDATION_RULES[table_type]:
        by_lower = {}
        for name in out:
            by_lower[name.lower()] = name  # last column wins on case collisions
        found = []
        for v in variants:
            actual = by_lower.get(v.lower())
            if actual is not None and actual not in found:
                found.append(actual)
        if not found:
            continue
        if target not in out:
            out[target] = F.lit("")
        for v in found:
            tgt, src = out[target], out[v]
            out[target] = F.when(m2_target(tgt) & ~m2(src), src).otherwise(tgt)
            if v != target:
                del out[v]
    return out


def _project(df: DataFrame, plan: "OrderedDict[str, Column]") -> DataFrame:
    keep = [c for c in df.columns if c == ROW]
    return df.select(*[e.alias(n) for n, e in plan.items()], *keep)


def standardize(df: DataFrame, spec, table_type: str, consolidate: bool = True) -> DataFrame:
    """Merged table -> standard headers + Source + unmapped columns (+ variant consolidation)."""
    plan = standardize_plan(data_columns(df), spec, table_type)
    if consolidate:
        plan = consolidate_plan(plan, table_type)
    return _project(df, plan)


def consolidate_variants(df: DataFrame, table_type: str) -> DataFrame:
    plan = OrderedDict((c, C(c)) for c in data_columns(df))
    return _project(df, consolidate_plan(plan, table_type))


def mapping_fill_stats(df: DataFrame, spec, table_type: str) -> DataFrame:
    """Cells filled per priority level (one aggregate) + unmapped column count."""
    cols = data_columns(df)
    merged = plan_mappings(spec)
    counts = {p: [] for p in PRIORITIES}
    for h in standard_fields(table_type):
        if h not in merged:
            continue
        filled = F.lit(False)
        for p in PRIORITIES:
            for c in merged[h][p]:
                if not c or c not in cols:
                    continue
                take = ~filled & ~m1(C(c))
                counts[p].append(F.when(take, 1).otherwise(0))
                filled = filled | ~m1(C(c))
    used = {"Source"} | {c for s in merged.values() for p in PRIORITIES for c in s[p] if c}
    unmapped = len([c for c in cols if c not in used])
    aggs = [(F.sum(sum(v[1:], v[0])) if v else F.lit(0)).cast("bigint").alias(f"{p}_mappings")
            for p, v in counts.items()]
    return df.agg(*aggs).select("*", F.lit(unmapped).cast("bigint").alias("unmapped_headers"))
