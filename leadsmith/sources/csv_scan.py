"""CSV exports in, CSV out (S1-S4, S9) plus global row positions.

* The header catalogue is read from the first record of every file.
* Bodies are read per header signature with physical names ``c0..cn`` (Spark
  would otherwise rename duplicate headers), then renamed to the catalogue
  names and unioned by name in first-seen column order.
* ``_row`` orders rows by file and position: the file's ordinal in the high
  bits, the reader's position in the low bits. No job is run to number rows.
* Nothing is lost in silence: an empty file, and a record with more cells than
  its header, fail with the file's name.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import C, na_token_to_null
from ..functions.constants import EXPORT_NAME, EXPORT_STAMP, NA_TOKENS
from ..session import ship
from .csv_split import file_system, irregular_files, open_file, range_states, split_records

# Split a CSV header line on commas outside double quotes.
_CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def file_path() -> Column:
    """The path of a row's file as file listings write it; ``_metadata.file_path`` has it URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """CSV files of no length, which Spark's readers leave out without a word."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for p in paths:
        at = hadoop.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for top in fs.globStatus(at) or []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                if f.getLen() == 0 and f.getPath().getName().endswith(".csv"):
                    found.append(f.getPath().toString())
    return sorted(found)


def list_csv_files(spark: SparkSession, paths) -> list[str]:
    """Expand folders/globs to *.csv files, sorted by base name then path (deterministic order)."""
    return [path for path, _ in csv_listing(spark, paths)]


def csv_listing(spark: SparkSession, paths) -> list[tuple[str, int]]:
    """(path, bytes) of the files of ``list_csv_files``."""
    if isinstance(paths, str):
        paths = [paths]
    if not paths:
        raise ValueError("no files provided for merging")
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
          .option("recursiveFileLookup", "true").load(list(paths)).select("path", "length"))
    blank = _empty_files(spark, paths)
    if blank:
        raise ValueError(f"no columns to read in empty file(s): {', '.join(blank)}")
    files = [(r["path"], r["length"]) for r in df.collect()]  # file listing: metadata, one row per file
    if not files:
        raise ValueError(f"no .csv files under {paths}")
    return sorted(files, key=lambda f: (os.path.basename(f[0]), f[0]))


def _unquote(h):
    h = F.regexp_replace(h, r"^\s*\"|\"\s*$", "")
    return F.replace(h, F.lit('""'), F.lit('"'))


def _header_line(raw: bytes) -> tuple[str, bool]:
    """First CSV record of the bytes (a quoted header may span lines), BOM removed.

    Returns (line, complete): complete is False while no record end was seen.
    """
    in_quotes = False
    for i, b in enumerate(raw):
        if b == 0x22:
            in_quotes = not in_quotes
        elif b in (0x0A, 0x0D) and not in_quotes:
            return raw[:i].decode("utf-8", "replace").lstrip("\ufeff"), True
    return raw.decode("utf-8", "replace").lstrip("\ufeff"), False


def first_lines(spark: SparkSession, files: list[str], chunk: int = 1 << 16) -> DataFrame:
    """(path, line): only the first bytes of every file are read, in parallel tasks.

    File paths are spread over tasks; each task opens its files through the
    Arrow filesystem layer (local, HDFS, object stores) and stops at the end
    of the header record, so the catalogue never scans file bodies.
    """
    import pandas as pd

    ship(spark)

    def read(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"].tolist():
                buf = b""
                with open_file(p) as fh:
                    while True:
                        part = fh.read(chunk)
                        buf += part
                        line, complete = _header_line(buf)
                        if complete or not part:
                            break
                out.append((p, line))
            yield pd.DataFrame(out, columns=["path", "line"])

    paths = spark.createDataFrame([(p,) for p in files], "path string")
    n = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    return paths.repartition(n).mapInPandas(read, "path string, line string")


def header_catalog(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_ord, path, file_name, ordinal, header) with pandas-style duplicate renaming (x, x.1, ...)."""
    order = spark.createDataFrame([(i, p) for i, p in enumerate(files)], "file_ord int, path string")
    first = first_lines(spark, files)
    heads = first.select("path", F.posexplode(F.split("line", _CSV_SPLIT)).alias("ordinal", "raw"))
    named = _unquote(F.col("raw"))
    # a blank header takes its position's name, as an index column of an export has it
    named = F.when(named == "", F.concat(F.lit("Unnamed: "), F.col("ordinal").cast("string"))).otherwise(named)
    heads = heads.select("path", "ordinal", named.alias("header"))
    # pandas renames the k-th repeat of a name to name.k
    from pyspark.sql import Window
    w = Window.partitionBy("path", "header").orderBy("ordinal")
    k = F.row_number().over(w) - 1
    heads = heads.withColumn("header", F.when(k == 0, F.col("header"))
                             .otherwise(F.concat("header", F.lit("."), k.cast("string"))))
    return (heads.join(order, "path")
            .select("file_ord", "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
                    "ordinal", "header"))


def with_partition_offsets(df: DataFrame, name: str) -> DataFrame:
    """1-based global position following partition order then in-partition order.

    The input is checkpointed (reliable, to spark.checkpoint.dir) so the
    counting pass and the numbering pass see identical partitions even if
    executors are lost in between.
    """
    spark = df.sparkSession
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    stable = df.checkpoint(eager=True)
    tagged = stable.select("*", F.spark_partition_id().alias("__pid"),
                           (F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("__pos"))
    counts = sorted((r["__pid"], r["n"]) for r in
                    tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offs, acc = [], 0
    for pid, n in counts:  # one entry per partition
        offs.append((pid, acc))
        acc += n
    off = spark.createDataFrame(offs or [(0, 0)], "__pid int, __off long")
    out = tagged.join(F.broadcast(off), "__pid")
    return out.withColumn(name, F.col("__off") + F.col("__pos") + 1).drop("__pid", "__pos", "__off")


def header_signatures(catalog: DataFrame) -> list[tuple[list[str], list[str], list[int]]]:
    """(headers, paths, file ordinals) of each distinct header, in order of its first file.

    One collected row per distinct header and its list of files (the listing the driver holds already).
    """
    per_file = catalog.groupBy("file_ord", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "header"))), lambda x: x["header"]).alias("headers"))
    rows = per_file.groupBy("headers").agg(F.array_sort(F.collect_list(F.struct("file_ord", "path"))).alias("files"))
    found = [(r["headers"], [f["path"] for f in r["files"]], [f["file_ord"] for f in r["files"]]) for r in rows.collect()]
    return sorted(found, key=lambda x: x[2][0])


def file_headers(spark: SparkSession, paths) -> list[tuple[list[str], list[str]]]:
    """(headers, file names) of each distinct header."""
    found = header_signatures(header_catalog(spark, list_csv_files(spark, paths)))
    return [([h for h in headers if h != "Source"], [p.rsplit("/", 1)[-1] for p in files]) for headers, files, _ in found]


def _union_all(parts: list[DataFrame]) -> DataFrame:
    """Balanced union by name, so that many header signatures do not nest deeply."""
    while len(parts) > 1:
        parts = [parts[i] if i + 1 == len(parts) else parts[i].unionByName(parts[i + 1], allowMissingColumns=True)
                 for i in range(0, len(parts), 2)]
    return parts[0]


#: Larger files are read by ranges of bytes, many tasks a file (``csv_split``).
SPLIT_BYTES = 64 << 20
READ = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}


def _splittable(spark: SparkSession, listing: list[tuple[str, int]], split_bytes: int) -> DataFrame | None:
    """Byte ranges of the large files that can be split."""
    large = [f for f in listing if f[1] > split_bytes]
    if not large:
        return None
    states = range_states(spark, large, max(split_bytes // 2, 1))
    whole = irregular_files(states)
    return states.where(~F.col("path").isin(whole)) if whole else states


def _split_paths(ranges: DataFrame | None) -> set[str]:
    return {r["path"] for r in ranges.select("path").distinct().collect()} if ranges is not None else set()


def _bodies(spark: SparkSession, headers: list[str], group: list[str], ranges: DataFrame | None, split: set[str],
            na_tokens) -> list[DataFrame]:
    """The rows of files of one header, with their ``__path`` and their position ``__mono``."""
    # one column more than the header has: it is null unless a record is too long
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers) + 1)])
    sel = [na_token_to_null(F.col(f"c{i}"), na_tokens).alias(h)
           for i, h in enumerate(headers) if h != "Source"]

    def cells(body, path, position):
        checked = F.when(F.col(f"c{len(headers)}").isNull(), path).otherwise(
            F.raise_error(F.concat(F.lit("a record has more cells than the header of "), path)).cast("string"))
        return body.select(*sel, checked.alias("__path"), position.alias("__mono"))

    parts = []
    whole = [p for p in group if p not in split]
    if whole:
        body = spark.read.schema(schema).options(header="true", multiLine="true", **READ)
        # readers take paths as patterns; these are names
        body = body.csv([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in whole])
        parts.append(cells(body, file_path(), F.monotonically_increasing_id()))
    if len(whole) < len(group):
        body = split_records(ranges.where(F.col("path").isin([p for p in group if p in split])))
        row = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), READ)
        body = body.select("path", "number", row.alias("r")).select("path", "number", "r.*")
        parts.append(cells(body, F.col("path"), F.col("number")))
    return parts


def _placed(merged: DataFrame, ords: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, Source and ``_row`` of rows with ``__path`` and ``__mono``; ``ords`` gives the files their ordinals."""
    merged = merged.join(ords, "__path", "left")
    no_ordinal = F.raise_error(F.concat(F.lit("no file of the listing is named "), F.col("__path"))).cast("bigint")
    ordinal = F.coalesce(F.col("__file_ord"), no_ordinal)
    position = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    row = F.shiftleft(ordinal, 33).bitwiseOR(position).alias("_row")
    base = F.element_at(F.split("__path", "/"), -1)
    return merged.select(*[C(c) for c in columns], base.alias("Source"), row)


def read_csv_files(spark: SparkSession, paths, na_tokens=NA_TOKENS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Many CSV files with differing headers -> one all-string table + Source + _row.

    A file is one task up to ``split_bytes``, and one task for each half of that beyond; rows and their order are the same.
    """
    listing = csv_listing(spark, paths)
    files = [path for path, _ in listing]
    ranges = _splittable(spark, listing, split_bytes)
    split = _split_paths(ranges)
    signatures = header_signatures(header_catalog(spark, files))
    col_order = list(dict.fromkeys(h for headers, _, _ in signatures for h in headers if h != "Source"))
    if spark.conf.get("spark.sql.caseSensitive", "false").lower() != "true" and \
            len({h.lower() for h in col_order}) < len(col_order):
        raise ValueError("headers differ by case only: set spark.sql.caseSensitive to true to read these files")
    parts = [p for headers, group, _ in signatures for p in _bodies(spark, headers, group, ranges, split, na_tokens)]
    ords = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "__path string, __file_ord bigint")
    return _placed(_union_all(parts), ords, col_order)


def read_listed_files(spark: SparkSession, listing: list[tuple[str, int]], headers: list[str], columns: list[str], ords: DataFrame,
                      na_tokens=NA_TOKENS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of the (path, bytes) of a listing that all have ``headers``, over ``columns``; ``ords`` has (__path, __file_ord)."""
    ranges = _splittable(spark, listing, split_bytes)
    split = _split_paths(ranges)
    merged = _union_all(_bodies(spark, headers, [path for path, _ in listing], ranges, split, na_tokens))
    absent = [F.lit(None).cast("string").alias(c) for c in columns if c not in headers]
    return _placed(merged.select("*", *absent), ords, columns)


def count_records(spark: SparkSession, paths) -> DataFrame:
    """A1: data records per file (blank lines are not records) plus a TOTAL row."""
    merged = read_csv_files(spark, paths)
    r = merged.rollup("Source").agg(F.count(F.lit(1)).cast("bigint").alias("records"))
    return r.select(F.coalesce("Source", F.lit("TOTAL")).alias("file"), "records")


def merge_stats(merged: DataFrame) -> DataFrame:
    """A2: files, records, columns (without Source)."""
    ncols = len([c for c in merged.columns if c not in ("Source", "_row") and not c.startswith("__")])
    return merged.agg(F.count_distinct("Source").cast("bigint").alias("files_processed"),
                      F.count(F.lit(1)).cast("bigint").alias("total_records"),
                      F.lit(ncols).cast("bigint").alias("total_columns"))


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Header CSV, cells as they are. Internal columns are dropped.

    ``single_file`` makes one file of that very name (as exports are handed out), rows in the order of the partitions. Its
    parts are written by all tasks and then joined byte by byte (``join_files``).
    """
    cols = [c for c in df.columns if c not in ("_row", "_key", "_n") and not c.startswith("__")]
    out = df.select(*[C(c) for c in cols])

    def write(rows: DataFrame, target: str, mode: str, header: str) -> None:
        (rows.write.mode(mode).option("header", header).option("quote", '"').option("escape", '"').option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(target))

    if not single_file:
        write(out, path, mode, "true")
        return path
    spark = df.sparkSession
    write(spark.createDataFrame([], out.schema), f"{path}__parts/head", "overwrite", "true")
    write(out, f"{path}__parts/body", "overwrite", "false")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}__parts")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for part in ("head", "body"):
        found = [f for f in fs.listStatus(hadoop.Path(folder, part)) if f.getPath().getName().startswith("part-")]
        # one write's names differ by the number of the partition only, which has five digits or more
        parts += sorted(((f.getPath().toString(), f.getLen()) for f in found), key=lambda f: (len(f[0]), f[0]))
    joined = fs.makeQualified(hadoop.Path(folder, "joined"))
    join_files(spark, parts, joined.toString())
    fs.delete(hadoop.Path(path), False)
    if not fs.rename(joined, hadoop.Path(path)):
        raise OSError(f"{path} could not take the place of its parts")
    fs.delete(folder, True)
    return path


def _copy(part: str, size: int, write, block: int = 1 << 20) -> None:
    """The bytes of a file, a block at a time."""
    done = 0
    with open_file(part) as fh:
        while data := fh.read(block):
            write(data, done)
            done += len(data)
    if done != size:
        raise OSError(f"{part} has {done} bytes, {size} were listed")


def join_files(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """One new file of the bytes of ``parts``, (path, bytes) each, in their order.

    In a file system that all machines mount, one task for each part writes it at its place. Other stores write a file from
    its start to its end only: there one task copies the finished parts.
    """
    ship(spark)

    def place(part: tuple[str, int, int]) -> None:
        path, size, at = part
        fd = os.open(local, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            def write(data, done):
                while data:
                    n = os.pwrite(fd, data, at + done)
                    data, done = data[n:], done + n

            _copy(path, size, write)
        finally:
            os.close(fd)

    def append(all_parts: list[tuple[str, int]]) -> None:
        fs, at = file_system(target)
        with fs.open_output_stream(at) as out:
            for path, size in all_parts:
                _copy(path, size, lambda data, _: out.write(data))

    if target.startswith("file:"):
        local = spark._jvm.org.apache.hadoop.fs.Path(target).toUri().getPath()
        ends = list(accumulate(size for _, size in parts))
        placed = [(path, size, end - size) for (path, size), end in zip(parts, ends, strict=True)]
        spark.sparkContext.parallelize(placed, len(placed)).foreach(place)
    else:
        spark.sparkContext.parallelize([parts], 1).foreach(append)


def export_name(table_type: str, stamp) -> str:
    """The time-stamped name of a processed export."""
    return EXPORT_NAME.format(table_type=table_type, stamp=stamp.strftime(EXPORT_STAMP))
