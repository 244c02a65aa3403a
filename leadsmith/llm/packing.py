"""Concatenate and cut: all documents' tokens in one long row, cut into sequences of a fixed length.

Pass one encodes every text once and writes its ids, with the tokens before it in its own partition. The partitions' totals,
one row each, are summed to global offsets. Pass two adds the offset of the partition and cuts each document where a
sequence ends; no token is moved between tasks, and the last sequence alone is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadsmith.llm.bpe import default_path, encoder, text_batches
from leadsmith.llm.shared import stored

SEQUENCE, END = 2048, 1


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """part, before, doc_id, ids: each document's ids with END behind them, and the tokens before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for keys, texts in text_batches(batches):
            ids, counts = tokenizer.encode(texts)
            if ids.size and ids.max() > 0xFFFF:
                raise ValueError("ids beyond 16 bits: packing keeps them as unsigned 16-bit integers")
            ends = np.cumsum(counts)
            closed = np.insert(ids.astype("<u2"), ends, END)
            ends = ends + np.arange(1, len(ends) + 1)
            offsets = pa.array(np.concatenate([[0], 2 * ends]).astype(np.int32)).buffers()[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), part, np.int32)),
                    pa.array(before + ends - counts - 1),
                    pa.array(keys, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(closed.tobytes())]),
                ],
                names=["part", "before", "doc_id", "ids"],
            )
            before += int(ends[-1])

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "part int, before bigint, doc_id bigint, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    sequence: int = SEQUENCE,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues, and ids if asked for.

    Every document has one token at least, the END behind it; null text counts as empty. A document that runs over the end
    of a sequence ``continues`` in the next one. Rows stand for themselves: repeated rows are packed each, null identifiers
    stay null. An empty table gives no pieces. Only the two named columns are read.
    """
    tokens = stored(encoded(docs, id_col, text_col, path or default_path()), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / 2).cast("bigint").alias("n"))
    # One row per partition of pass one, a few bytes each: bounded by the number of tasks, not by the data.
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for doc_id, at, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(ids) // 2
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                start = 0
                while start < n:
                    number, offset = divmod(at + start, sequence)
                    length = min(n - start, sequence - offset)
                    piece = wide[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), n, number, offset, start + length < n)
                    for column, value in zip(columns, (*row, bytes(piece) if keep_ids else b""), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues", "ids"]
    schema = ", ".join(f"`{c}` bigint" for c in names[:7]) + ", continues boolean, ids binary"
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("at"), "ids")
    pieces = placed.mapInArrow(cut, schema)
    return pieces if keep_ids else pieces.drop("ids")
