"""Large CSV files read by many tasks, quoted line breaks included.

A byte range of a file cannot be read alone: whether its first byte stands
inside quotes depends on all quotes before it. So two passes read the ranges:

1. each range counts its quotes, and its records under both assumptions;
   along a file, parities and counts add up to each range's true state and to
   the number of its first record;
2. each range takes the records that start in it, the last one to its end
   beyond the range, and ``from_csv`` splits them into cells.

Ranges go by bytes alone, so one file of any size is as many tasks as it has
ranges, and a task holds one block of its range and the record that is open at
the block's end. Files where quotes stand elsewhere than
around whole cells, or lines end in a lone carriage return, are named by the
first pass and left to the reader that takes a file as one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship

RANGE_BYTES = 32 << 20
#: A range holds a byte order mark whole.
LEAST_RANGE = 16
#: Bytes of a range that a task holds at a time, ``LEAST_RANGE`` at least.
BLOCK_BYTES = 1 << 20
#: Rows that go back to Spark at a time, and the bytes that end a batch before.
BATCH_RECORDS, BATCH_BYTES = 10_000, 4 << 20
QUOTE, COMMA, LF, CR = 0x22, 0x2C, 0x0A, 0x0D
BOM = b"\xef\xbb\xbf"


def file_system(path: str):
    """(Arrow's file system, the path in it) of a path as file listings write it."""
    from urllib.parse import quote

    import pyarrow.fs as pafs

    scheme, _, rest = path.partition(":")
    rest = quote(rest, safe="/:@")
    return pafs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and rest[:2] != "//" else f"{scheme}:{rest}")


def open_file(path: str):
    """A random-access file of any store that Arrow knows; ``path`` as file listings write it."""
    fs, at = file_system(path)
    return fs.open_input_file(at)


def _outside(data: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each byte stands outside quotes, the quotes before it counted."""
    quote = data == QUOTE
    # only the parity counts, so the sum may pass a byte
    return (np.cumsum(quote, dtype=np.uint8) ^ quote ^ inside) & 1 == 0


def record_starts(data: np.ndarray, inside: bool, first: bool) -> np.ndarray:
    """Where records start; ``data`` holds one byte before the range unless it is the file's ``first``. Blank lines are none."""
    outside = _outside(data, inside)
    starts = np.flatnonzero((data == LF) & outside) + 1
    if first:
        starts = np.concatenate([[0], starts])
    starts = starts[starts < len(data)]
    ahead = np.concatenate([data, [LF, LF]])
    blank = (ahead[starts] == LF) | ((ahead[starts] == CR) & (ahead[starts + 1] == LF))
    return starts[~blank]


def irregular(data: np.ndarray, inside: bool, before: int, after: int) -> bool:
    """Quotes that do not stand around whole cells, or a lone carriage return outside quotes."""
    outside = _outside(data, inside)
    left, right = np.concatenate([[before], data[:-1]]), np.concatenate([data[1:], [after]])
    around = [COMMA, LF, CR, QUOTE]
    quote = data == QUOTE
    return bool((quote & outside & ~np.isin(left, around)).any() or (quote & ~outside & ~np.isin(right, around)).any()
                or ((data == CR) & outside & (right != LF)).any())


def first_break(data: np.ndarray, after: int) -> int | None:
    """1 if the first line break is a carriage return with a line feed, 0 if it is another one, quoted or not."""
    breaks = np.flatnonzero((data == LF) | (data == CR))
    if not len(breaks):
        return None
    k = int(breaks[0])
    return int(data[k] == CR and (data[k + 1] if k + 1 < len(data) else after) == LF)


def _blocks(fh, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the bytes [at, end), a block at a time."""
    fh.seek(at)
    while at < end:
        block = fh.read(min(BLOCK_BYTES, end - at))
        if not block:
            return
        yield at, block
        at += len(block)


def _seams(fh, at: int, end: int, size: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(place, block, byte before, byte behind) of the bytes [at, end); line feeds stand at a file's ends."""
    before, held = LF, None
    for place, block in _blocks(fh, max(at - 1, 0), min(end + 1, size)):
        if place < at:
            before, place, block = block[0], at, block[1:]
        if held and block:
            yield *held[:2], before, block[0]
            before = held[1][-1]
        if block:
            held = (place, block)
    if held:
        place, block = held
        if place + len(block) > end:  # the byte behind the range came along
            block, after = block[:-1], block[-1]
        else:
            after = LF
        if block:
            yield place, block, before, after


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, at, end, size in pdf.itertuples(index=False):
            odd, records, bad, crlf = 0, [0, 0], [False, False], None
            with open_file(path) as fh:
                for place, block, before, after in _seams(fh, at, end, size):
                    skip = len(BOM) if place == 0 and block.startswith(BOM) else 0
                    data = np.frombuffer(block, np.uint8)[skip:]
                    # the byte before the block is a line feed that ends a record only outside quotes
                    led = np.concatenate([np.array([before], np.uint8), data]) if place else data
                    for start in (0, 1):
                        inside = bool(start ^ odd)
                        began = inside ^ (before == QUOTE) if place else inside
                        records[start] += len(record_starts(led, began, place == 0))
                        bad[start] |= irregular(data, inside, before, after) if len(data) else False
                    crlf = first_break(data, after) if crlf is None else crlf
                    odd ^= int((data == QUOTE).sum()) % 2
            out.append([path, at, odd, records[0], bad[0], records[1], bad[1], crlf])
        yield pd.DataFrame(out, columns=["path", "at", "odd", "records0", "irregular0", "records1", "irregular1", "crlf"]).astype({"crlf": "Int32"})


def _records(fh, at: int, end: int, size: int, inside: bool) -> Iterator[bytes]:
    """The records that start in a range; the last is read to its end. Blank lines are none."""
    begun: list[bytes] | None = [] if at == 0 else None  # what was read of the open record; None before the first one starts
    for place, block in _blocks(fh, max(at - 1, 0), size):
        if place >= end and begun is None:
            return
        if place == 0 and at == 0 and block.startswith(BOM):
            place, block = len(BOM), block[len(BOM):]
        if place < at:  # the state is that behind this byte
            inside ^= block[0] == QUOTE
        data = np.frombuffer(block, np.uint8)
        start = 0
        for stop in np.flatnonzero((data == LF) & _outside(data, inside)).tolist():
            if begun is not None:
                line = b"".join([*begun, block[start:stop]]).removesuffix(b"\r")
                if line:
                    yield line
            begun, start = [], stop + 1
            if place + start >= end:
                return
        inside ^= bool((data == QUOTE).sum() % 2)
        if begun is not None:
            begun.append(block[start:])
    line = b"".join(begun or []).removesuffix(b"\r")
    if line:
        yield line


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, at, end, size, inside, number, crlf in pdf.itertuples(index=False):
            with open_file(path) as fh:
                rows: list[tuple[str, int, str]] = []
                held = 0
                for record in _records(fh, at, end, size, bool(inside)):
                    if number:  # the first record of a file is its header
                        text = record.decode("utf-8", "replace")
                        rows.append((path, number - 1, text.replace("\r\n", "\n") if crlf else text))
                        held += len(record)
                    number += 1
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "number", "record"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["path", "number", "record"])


def range_states(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, end, size, inside, number, crlf, irregular): every byte range of the files, and the state that it starts in."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    range_bytes = max(range_bytes, LEAST_RANGE)
    whole = spark.createDataFrame(files, "path string, size bigint").where("size > 0")
    cut = whole.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("at"))
    cut = cut.select("path", "at", F.least(F.col("at") + range_bytes, F.col("size")).alias("end"), "size")
    many = max(1, sum(-(-size // range_bytes) for _, size in files))
    seen = cut.repartition(min(many, 10 * spark.sparkContext.defaultParallelism + many // 100)).mapInPandas(
        _counted, "path string, at bigint, odd int, records0 bigint, irregular0 boolean, records1 bigint, irregular1 boolean, crlf int")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = cut.join(seen, ["path", "at"]).withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("inside"), F.col("records1")).otherwise(F.col("records0"))
    known = known.withColumn("own", own).withColumn("number", F.coalesce(F.sum("own").over(before), F.lit(0)))
    bad = F.when(F.col("inside"), F.col("irregular1")).otherwise(F.col("irregular0"))
    # where a file's first line break is \r\n, Spark's reader makes \n of each, within quotes too
    crlf = F.coalesce(F.first("crlf", ignorenulls=True).over(Window.partitionBy("path").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)) == 1
    # a file that ends inside quotes is irregular as well
    ends_open = (F.col("end") == F.col("size")) & ((F.col("inside").cast("int") + F.col("odd")) % 2 == 1)
    return known.select("path", "at", "end", "size", "inside", "number", crlf.alias("crlf"), (bad | ends_open).alias("irregular")).checkpoint()


def irregular_files(states: DataFrame) -> list[str]:
    """Files that cannot be split; names come to the driver, as in file listings."""
    return [r["path"] for r in states.where("irregular").select("path").distinct().collect()]


def split_records(states: DataFrame) -> DataFrame:
    """(path, number, record): the records of the files behind their headers, numbered from 0 within the file."""
    ranges = states.select("path", "at", "end", "size", "inside", "number", "crlf")
    spread = ranges.repartition(max(1, ranges.count()), "path", "at")
    return spread.mapInPandas(_split, "path string, number bigint, record string")
