"""Column profile, junk-column filter and the default alias mapper.

Only sample values come from the first rows of each file: that is the feature
(the first row, a composite-sample scan of 1000 rows). The "first N per source"
cut is a ``row_number() <= N`` window, which Spark plans as a WindowGroupLimit
before and after the exchange, so even a source holding a third of all rows
ships at most N rows per map task. Whether a column is empty, and so left out
of the mapping, is one aggregate over all rows. A file is profiled over the
columns of its own header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import C, is_hash_like, m8, strip
from ..functions.constants import (
    ALIASES, BOOLEANISH_SAMPLES, ID_TERMS, IMPORTANT_TERMS, PROFILE_SAMPLE_ROWS, TRACKING_TERMS, UNWANTED_TERMS,
)

ROW = "_row"


def head_per_group(df: DataFrame, group: str, order: str, n: int, pos: str = "__pos") -> DataFrame:
    """First n rows per group by ``order`` (WindowGroupLimit plan), with a 1-based position."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn(pos, F.row_number().over(w)).where(F.col(pos) <= n)


#: Columns per file, by header: (columns, file names). None: every file has all columns.
Headers = list[tuple[list[str], list[str]]]


def _own_cells(cols: list[str], headers: Headers | None, cell) -> Column:
    """Array of ``cell(ordinal, column)`` over the columns of the row's own file."""
    if headers is None:
        return F.array(*[cell(i, c) for i, c in enumerate(cols)])
    out = None
    for own, files in headers:
        wanted = set(own)
        cells = F.array(*[cell(i, c) for i, c in enumerate(cols) if c in wanted])
        here = C("Source").isin(files)
        out = F.when(here, cells) if out is None else out.when(here, cells)
    return out


def long_cells(df: DataFrame, cols: list[str], pos: str = "__pos", headers: Headers | None = None) -> DataFrame:
    """Unpivot to (Source, ordinal, column_name, value, pos)."""
    def cell(i, c):
        return F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), C(c).cast("string").alias("value"))

    x = df.select(C("Source"), F.col(pos), F.explode(_own_cells(cols, headers, cell)).alias("cell"))
    return x.select(C("Source"), F.col(pos).alias("pos"), "cell.ordinal", "cell.column_name", "cell.value")


def filled_counts(df: DataFrame, cols: list[str], headers: Headers | None = None) -> DataFrame:
    """(Source, ordinal, non_null, not_blank) over all rows: one aggregate per file, then unpivoted."""
    aggs = []
    for i, c in enumerate(cols):
        v = C(c).cast("string")
        aggs += [F.count_if(v.isNotNull()).alias(f"__f{i}"), F.count_if(v.isNull() | (strip(v) != "")).alias(f"__b{i}")]
    def cell(i, c):
        return F.struct(F.lit(i).alias("ordinal"), F.col(f"__f{i}").alias("non_null"), F.col(f"__b{i}").alias("not_blank"))

    wide = df.groupBy("Source").agg(*aggs)
    return wide.select(C("Source"), F.explode(_own_cells(cols, headers, cell)).alias("cell")).select(C("Source"), "cell.*")


def _contains_any(text: Column, terms) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def is_useless_column(name: Column, sample: Column, unwanted_terms=None) -> Column:
    """F5 junk rule on (column name, first-row sample) in its fixed order."""
    unwanted = [t.lower() for t in (unwanted_terms or UNWANTED_TERMS)]
    low = F.lower(name)
    v = strip(F.coalesce(sample, F.lit("")))
    return (
        _contains_any(low, unwanted)
        | _contains_any(low, ID_TERMS)
        | is_hash_like(v)
        | (F.lower(v).isin(BOOLEANISH_SAMPLES) & ~_contains_any(low, IMPORTANT_TERMS))
        | (name.rlike(r"^.+/\d+$") & (v == ""))
        | _contains_any(low, TRACKING_TERMS)
        | ((F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))) > 2)
    )


def column_profile(df: DataFrame, sample_rows: int = PROFILE_SAMPLE_ROWS, unwanted_terms=None,
                   headers: Headers | None = None) -> DataFrame:
    """Per (Source, column of its header): first value, composite sample, emptiness, junk flag, kept flag."""
    cols = [c for c in df.columns if c not in (ROW, "Source") and not c.startswith("__")]
    head = head_per_group(df, "Source", ROW, sample_rows)
    cells = long_cells(head, cols, headers=headers)
    v = F.col("value")
    in_smp = F.col("pos") <= sample_rows
    t = strip(v)
    prof = cells.groupBy("Source", "ordinal", "column_name").agg(
        F.min_by(F.coalesce(v, F.lit("")), F.col("pos")).alias("first_value"),
        F.max(F.when(in_smp & ~m8(v), F.struct(F.length(t).alias("n"), (-F.col("pos")).alias("p"),
                                                 t.alias("v")))).alias("best"),
        F.count_if(in_smp & v.isNotNull()).alias("smp_non_null"),
        F.count_if(in_smp & (v.isNull() | (strip(v) != ""))).alias("smp_not_blank"),
        F.count_if(in_smp).alias("smp_rows"),
    ).join(filled_counts(df, cols, headers), ["Source", "ordinal"])
    first = F.col("first_value")
    first_ok = ~m8(first)
    enriched_ok = (F.col("smp_rows") > 1) & (F.col("smp_non_null") > 0) & (F.col("smp_not_blank") > 0)
    best_v = F.col("best")["v"]
    composite = (
        F.when(~enriched_ok, first)
        .when(F.col("best").isNull(), first)
        .when(first_ok & (F.length(strip(first)) >= F.col("best")["n"]), first)
        .otherwise(best_v)
    )
    out = prof.select(
        "Source", "ordinal", "column_name", "first_value",
        ((F.col("non_null") == 0) | (F.col("not_blank") == 0)).alias("is_empty"),
        is_useless_column(F.col("column_name"), first, unwanted_terms).alias("is_junk"),
        composite.alias("sample_value"),
        F.col("non_null").cast("bigint").alias("non_null_count"),
    )
    # all columns of a source filtered -> keep the unfiltered (non-empty) ones
    w = Window.partitionBy("Source")
    kept_any = F.max(F.when(~F.col("is_empty") & ~F.col("is_junk"), 1).otherwise(0)).over(w)
    return out.withColumn("kept", ~F.col("is_empty") & (~F.col("is_junk") | (kept_any == 0)))


def header_stats(profile: DataFrame) -> DataFrame:
    """Headers before (sum per file), after (distinct kept), removed, percentage."""
    per = profile.agg(
        F.count(F.lit(1)).cast("bigint").alias("headers_before_filtering"),
        F.count_distinct(F.when(F.col("kept"), F.col("column_name"))).cast("bigint").alias("headers_after_filtering"),
    )
    b, a = F.col("headers_before_filtering"), F.col("headers_after_filtering")
    return per.select(b, a, (b - a).alias("headers_filtered_out"),
                      F.when(b > 0, F.round((b - a) / b * 100, 1)).otherwise(F.lit(0.0)).alias("filtering_percentage"))


def header_key(name: Column) -> Column:
    """Matching form of a header: stripped, lower-cased, '_' read as a space."""
    return F.replace(F.lower(strip(name)), F.lit("_"), F.lit(" "))


def alias_table(spark: SparkSession, table_type: str) -> DataFrame:
    """J3 dimension: (alias, std, std_ord, alias_ord) — first match in dictionary order wins."""
    rows = [(a, std, i, j) for i, (std, al) in enumerate(ALIASES[table_type].items()) for j, a in enumerate(al)]
    return spark.createDataFrame(rows, "alias string, std string, std_ord int, alias_ord int")


def alias_matches(profile: DataFrame, table_type: str) -> DataFrame:
    """Kept profile columns matched to standard headers by alias (broadcast equi-join).

    The alias side is the fixed dictionary (< 200 rows), so broadcasting it is bounded.
    Both sides are compared in ``header_key`` form; an alias that appears in two
    spellings ('staff size' / 'staff_size') counts once, at its first position.
    """
    spark = profile.sparkSession
    al = alias_table(spark, table_type).select(header_key(F.col("alias")).alias("alias"), "std", "std_ord",
                                                "alias_ord")
    cols = profile.where("kept").select("Source", "ordinal", "column_name",
                                        header_key(F.col("column_name")).alias("alias"))
    j = cols.join(F.broadcast(al), "alias", "inner")
    first = F.min(F.struct("std_ord", "alias_ord", "std")).alias("m")
    return j.groupBy("Source", "ordinal", "column_name").agg(first).select(
        "Source", "ordinal", "column_name", "m.std", "m.std_ord", "m.alias_ord")


def _ranked(matches: DataFrame) -> DataFrame:
    w = Window.partitionBy("Source", "std").orderBy("alias_ord", "ordinal")
    return matches.withColumn("rank", F.row_number().over(w))


def mapped_spec_rows(matches: DataFrame) -> DataFrame:
    """Default mapper: per (file, std) the 1st/2nd/3rd matching column become primary/secondary/tertiary.

    A mapping spec has these three places; ``left_over_columns`` lists the columns that find none.
    """
    ranked = _ranked(matches).where("rank <= 3")
    return ranked.select(
        F.col("Source").alias("filename"), "std", "std_ord",
        F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("tertiary")), F.col("rank")).alias("priority"),
        F.col("column_name").alias("source_col"),
    )


def left_over_columns(matches: DataFrame) -> DataFrame:
    """(filename, std, source_col) of matching columns beyond the three places; they stay as additional columns."""
    return _ranked(matches).where("rank > 3").select(
        F.col("Source").alias("filename"), "std", F.col("column_name").alias("source_col"))


def spec_from_rows(rows) -> dict:
    """Metadata rows (filename, std, std_ord, priority, source_col) -> mapping spec dict."""
    files: dict = {}
    for r in sorted(rows, key=lambda r: (r["filename"], r["std_ord"])):
        mh = files.setdefault(r["filename"], {})
        mh.setdefault(r["std"], {})[r["priority"]] = r["source_col"]
    return {"mapped_files": [{"filename": f, "mapped_headers": mh} for f, mh in files.items()]}


def header_set(catalog: DataFrame) -> DataFrame:
    """The distinct header names of a header catalogue (no file body is read)."""
    return catalog.select(F.col("header").alias("column_name")).distinct()


def unmapped_headers(catalog: DataFrame, mapped: list[str]) -> DataFrame:
    """Header names that the mapping spec does not use."""
    return header_set(catalog).where(~F.col("column_name").isin(*mapped))


def common_columns(profile: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per file, the kept columns of its profile that its header holds."""
    own = catalog.select(F.col("file_name").alias("Source"), F.col("header").alias("column_name"))
    return profile.where("kept").select("Source", "column_name").join(own, ["Source", "column_name"], "left_semi")


def term_hits(profile: DataFrame, unwanted_terms=None) -> DataFrame:
    """(column, unwanted term) pairs where the term occurs in the lower column name.

    Both sides are metadata (distinct column names x ~100 terms); the term list is broadcast.
    """
    spark = profile.sparkSession
    terms = spark.createDataFrame([(t.lower(),) for t in (unwanted_terms or UNWANTED_TERMS)], "term string")
    names = profile.select("column_name").distinct()
    return names.join(F.broadcast(terms), F.lower(F.col("column_name")).contains(F.col("term")), "inner")
