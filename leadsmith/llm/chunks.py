"""Chunks of documents that ask a hash-partitioned table about their keys, and get the answers back.

A key of a text (an n-gram, an anchor of a window) must meet its like from all other texts. Instead of one row per key, a
chunk of documents sends one row per bucket of the key space, with all its keys in that bucket packed in order; a task of the
bucket answers for the whole row, in the same order. The number of buckets grows with the session's shuffle partitions.
A chunk is a run of documents of one input partition; its number holds a checksum of what is in it, so that a table that
comes out in another order when a lost partition is read again leads to an error, not to wrong results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm.shared import shuffle_partitions

#: Bytes of text in a chunk (unless an operator says otherwise), or one longer text.
CHUNK_BYTES = 1_000_000
#: Stands for a null identifier, and sorts behind all others.
NO_ID = np.int64(2**63 - 1)
#: Bits of a chunk's number: its partition, its place there, and a checksum of what is in it.
PART_BITS, PLACE_BITS, CHECK_BITS = 24, 15, 24
#: Bytes kept of a key below its bucket's bits.
KEY_BYTES = 6


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    texts: list[bytes]


def chunk_number(part: int, place: int, check: int) -> int:
    """Unlike for any two chunks of a table; partitions or chunks beyond the bits are an error."""
    if part >> PART_BITS or place >> PLACE_BITS:
        raise OverflowError(f"chunk {place} of partition {part} has no number: read the input in more or fewer partitions")
    return (part << PLACE_BITS | place) << CHECK_BITS | check >> (32 - CHECK_BITS)


def only(texts: pd.DataFrame) -> pd.Series:
    """The one row of a chunk's texts."""
    if len(texts) != 1:
        raise RuntimeError("the input came out in another order when it was read again; write it to a table first")
    return texts.iloc[0]


def chunked(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[Chunk]:
    """Chunks of (identifier, text) batches, of ``most`` bytes of text or one longer text; null texts are empty."""
    most = most or CHUNK_BYTES
    part, count = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def made() -> Chunk:
        keys = np.array(ids, np.int64)
        check = zlib.crc32(np.fromiter(map(len, texts), np.int64, len(texts)).tobytes(), zlib.crc32(keys.tobytes()))
        return Chunk(chunk_number(part, count, check), keys, texts)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(int(NO_ID) if key is None else key)
            texts.append((text or "").encode())
            size += len(texts[-1]) + 1
            if size >= most:
                yield made()
                ids, texts, size, count = [], [], 0, count + 1
    if ids:
        yield made()


def read_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def packed_texts(docs: DataFrame, most: int | None = None) -> DataFrame:
    """chunk, ids, sizes, blob: one row per chunk with its compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunked(batches, most):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.number]), pa.array([c.ids.tobytes()]), *[pa.array([x]) for x in pack_texts(c.texts)]],
                names=["chunk", "ids", "sizes", "blob"],
            )

    return docs.mapInArrow(run, "chunk bigint, ids binary, sizes binary, blob binary")


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return sizes.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def unpack_texts(sizes: bytes, blob: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    data = zstandard.ZstdDecompressor().decompress(blob)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def bucket_bits(spark: SparkSession) -> int:
    """Bits of the key space's buckets: eight buckets or more for a shuffle partition."""
    return max(4, (8 * shuffle_partitions(spark) - 1).bit_length())


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that the sorted keys have a part in."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]]) if len(top) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(top[a]), a, b


def shorten(keys: np.ndarray, bits: int) -> np.ndarray:
    """The KEY_BYTES below the bucket's bits, as 64-bit integers."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)


def pack_keys(short: np.ndarray) -> bytes:
    """Sorted keys as gaps, one byte plane after the other, so that the planes of high bytes compress."""
    gaps = np.diff(short, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(KEY_BYTES, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :KEY_BYTES] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)
