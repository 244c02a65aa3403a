"""Long repeats between texts, in passes over chunks of documents; shared by two operators.

A scheme names each window of a text by a key that depends on nothing but the window's content, so that equal windows have
equal keys wherever they stand, and neighbouring windows mostly share one. Pass one finds the keys that occur more than
once. Pass two cuts out the fragments around those keys, settles equal fragments within a chunk there, and sends one of each
to its key's bucket, where windows are compared in full. Pass three removes what was found. A passage that very many documents
share costs each chunk one fragment, whatever the number of documents. The texts are read anew in each pass, so that the
shuffled texts of one pass are the most that stands on disk beside its keys or fragments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm import chunks as C
from leadsmith.llm.shared import release, stored
from leadsmith.llm.words import ragged

WORK_COLUMNS = ["chunk", "bucket", "ids", "text_rows", "starts", "sizes", "blob"]
WORK = "chunk bigint, bucket int, ids binary, text_rows binary, starts binary, sizes binary, blob binary"
SPANS = "chunk bigint, text_rows binary, starts binary, sizes binary"


@dataclass
class View:
    """Texts of a chunk in units (bytes or words): unit ``u`` is data[begin[u]:end[u]], text ``k`` has units at[k] to stop[k]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    stop: np.ndarray

    def rows_of(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, units, "right") - 1


class Scheme:
    """What the two operators differ in; ``dtype`` is that of the fragments' data."""

    width: int
    dtype: type

    def view(self, texts: list[bytes]) -> View:
        raise NotImplementedError

    def keys(self, view: View) -> tuple[np.ndarray, np.ndarray | None]:
        """Key of the window at each unit (anything where none starts), and which occurrence of it in the chunk it is."""
        raise NotImplementedError

    def occurrences(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and whether each alone makes a repeat within the chunk."""
        raise NotImplementedError

    def settle(self, group: np.ndarray, ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of fragments in groups of equal ones (``several``: some stand for more): removed for sure, to be compared with
        others, and standing for several."""
        raise NotImplementedError

    def repeated(self, windows: np.ndarray, ids: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Which of a bucket's windows (rows of bytes or of numbers) are to be removed."""
        raise NotImplementedError

    def fragments(self, view: View, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Data from which a bucket compares the windows of runs: all in one array, where each run's lies (from, to), a hash."""
        raise NotImplementedError

    def fragment_hashes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the fragments at[k] to at[k + 1] of such data."""
        raise NotImplementedError

    def fragment_windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the fragments at[k] to at[k + 1] of such data, and the fragment that each is from, in order."""
        raise NotImplementedError

    def window_counts(self, sizes: np.ndarray) -> np.ndarray:
        """Windows in fragments of these sizes."""
        raise NotImplementedError

    def keep(self, view: View, row: int, kept: np.ndarray) -> bytes:
        raise NotImplementedError


def runs(scheme: Scheme, view: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one occurrence of a key: key, first and last window's unit."""
    count = np.maximum(view.stop - view.at - scheme.width + 1, 0)
    starts = ragged(view.at, count)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    keys, place = scheme.keys(view)
    keys = keys[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    if place is not None:
        place = place[starts]
        new[1:] |= place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return keys[first], starts[first], starts[last]


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def asks(docs: DataFrame, scheme: Scheme, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.chunked(batches):
            view = scheme.view(chunk.texts)
            keys, first, _ = runs(scheme, view)
            keys, several = scheme.occurrences(keys, view.rows_of(first))
            short = C.shorten(keys, bits)
            rows = [(b, C.pack_keys(short[i:j]), _bits(several[i:j])) for b, i, j in C.by_bucket(keys, bits)]
            if rows:
                bucket, packed, flags = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket, pa.int32()),
                        pa.array([chunk.number] * len(rows), pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(flags, pa.binary()),
                    ],
                    names=["bucket", "chunk", "keys", "several"],
                )

    return docs.mapInArrow(run, "bucket int, chunk bigint, keys binary, several binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which keys of a bucket occur in several chunks, or several times in one."""
    keys = [C.unpack_keys(k) for k in pdf["keys"]]
    sizes = [len(k) for k in keys]
    several = np.concatenate([_mask(f, n) for f, n in zip(pdf["several"], sizes, strict=True)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    found = (np.bincount(place, minlength=len(distinct)) + np.bincount(place[several], minlength=len(distinct)) > 1)[place]
    out = []
    for chunk, part in zip(pdf["chunk"], np.split(found, np.cumsum(sizes)[:-1]), strict=True):
        if part.any():
            out.append((chunk, pdf["bucket"].iat[0], _bits(part)))
    return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])


@dataclass
class Picked:
    """The runs of a chunk whose keys occur elsewhere, and what the chunk alone says about them."""

    number: int
    ids: np.ndarray
    view: View
    keys: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    removed: np.ndarray
    sent: np.ndarray
    several: np.ndarray


def _groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of each pair's group of equal pairs."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def _picked(scheme: Scheme, bits: int, texts: pd.DataFrame, answers: pd.DataFrame) -> Picked:
    chunk = C.only(texts)
    ids = np.frombuffer(chunk["ids"], np.int64)
    view = scheme.view(C.unpack_texts(chunk["sizes"], chunk["blob"]))
    keys, first, last = runs(scheme, view)
    distinct, _ = scheme.occurrences(keys, view.rows_of(first))
    shared = np.zeros(len(distinct), bool)
    given = dict(zip(answers["bucket"], answers["bits"], strict=True))
    for b, i, j in C.by_bucket(distinct, bits):
        if b in given:
            shared[i:j] = _mask(given[b], j - i)
    pick = shared[np.searchsorted(distinct, keys)] if len(keys) else np.zeros(0, bool)
    keys, first, last = keys[pick], first[pick], last[pick]
    row = view.rows_of(first)
    data, lo, hi, content = scheme.fragments(view, keys, first, last)
    settled = scheme.settle(_groups(keys, content), ids[row], np.zeros(len(row), bool))
    return Picked(int(chunk["chunk"]), ids, view, keys, first, last, row, data, lo, hi, *settled)


def _fragments(scheme: Scheme, bits: int, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Pass two over one chunk: fragments for the buckets."""
    out: list[tuple] = []
    if len(answers):
        p = _picked(scheme, bits, texts, answers)
        order = np.flatnonzero(p.sent)
        order = order[np.argsort(p.keys[order], kind="stable")]
        for b, i, j in C.by_bucket(p.keys[order], bits):
            o = order[i:j]
            size = p.hi[o] - p.lo[o]
            blob = C.zstandard.ZstdCompressor(level=1).compress(p.data[ragged(p.lo[o], size)].tobytes())
            start = p.first[o] - p.view.at[p.row[o]]
            parts = (p.ids[p.row[o]], p.row[o].astype(np.int32), start, np.stack([size, p.several[o]]).astype(np.int32))
            out.append((p.number, b, *(x.tobytes() for x in parts), blob))
    return pd.DataFrame(out, columns=WORK_COLUMNS)


def _compare(scheme: Scheme, pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of all fragments of a bucket, compared in full; spans to remove, by chunk."""
    parts = []
    for r in pdf.itertuples():
        sizes = np.frombuffer(r.sizes, np.int32).reshape(2, -1)
        data = C.zstandard.ZstdDecompressor().decompress(r.blob)
        ids, row, start = np.frombuffer(r.ids, np.int64), np.frombuffer(r.text_rows, np.int32), np.frombuffer(r.starts, np.int64)
        parts.append((np.full(len(ids), r.chunk), ids, row, start, sizes[0].astype(np.int64), sizes[1] > 0, data))
    chunk, ids, row, start, size, several = (np.concatenate([p[k] for p in parts]) for k in range(6))
    data = np.frombuffer(b"".join(p[6] for p in parts), scheme.dtype)
    del parts
    at = np.concatenate([[0], np.cumsum(size)])
    known = several  # their own chunk has removed them
    # Equal fragments of different chunks settle each other; one of each goes on to be compared window by window.
    removed, sent, several = scheme.settle(_groups(scheme.fragment_hashes(data, at), size.astype(np.uint64)), ids, several)
    keep = np.flatnonzero(sent)
    data = data[ragged(at[:-1][keep], size[keep])]
    windows, part = scheme.fragment_windows(data, np.concatenate([[0], np.cumsum(size[keep])]))
    fragment = keep[part]
    hit = scheme.repeated(windows, ids[fragment], several[fragment])
    del windows
    # Flagged windows in a row become one span.
    order = np.arange(len(fragment)) - np.searchsorted(fragment, fragment)
    places = np.flatnonzero(hit & ~removed[fragment])
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (fragment[places[1:]] != fragment[places[:-1]])
    first = np.flatnonzero(new)
    length = np.append(first[1:], len(places)) - first
    whole = np.flatnonzero(removed & ~known)
    f = np.concatenate([fragment[places[first]], whole])
    if not len(f):
        return pd.DataFrame([], columns=["chunk", "text_rows", "starts", "sizes"])
    begin = np.concatenate([order[places[first]], np.zeros(len(whole), np.int64)])
    width = np.concatenate([length, scheme.window_counts(size[whole])]) - 1 + scheme.width
    spans = pd.DataFrame({"chunk": chunk[f], "row": row[f].astype(np.int32), "start": start[f] + begin, "size": width})
    out = [
        (c, g["row"].to_numpy(np.int32).tobytes(), g["start"].to_numpy(np.int64).tobytes(), g["size"].to_numpy(np.int64).tobytes())
        for c, g in spans.groupby("chunk")
    ]
    return pd.DataFrame(out, columns=["chunk", "text_rows", "starts", "sizes"])


RESULT = ["doc_id", "n_units", "n_removed", "n_spans", "kept"]


def _finish(scheme: Scheme, bits: int, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Pass three over one chunk: ``found`` holds the answers of pass one again, and the spans that the buckets found."""
    p = _picked(scheme, bits, texts, found[found["bucket"] >= 0])
    view, ids = p.view, p.ids
    change = np.zeros(int(view.stop[-1]) + 2, np.int32)
    gone_first, gone_last = p.first[p.removed], p.last[p.removed]
    np.add.at(change, gone_first, 1)
    np.add.at(change, gone_last + scheme.width, -1)
    for s in found[found["bucket"] < 0].itertuples():
        lo = view.at[np.frombuffer(s.text_rows, np.int32)] + np.frombuffer(s.starts, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, lo + np.frombuffer(s.sizes, np.int64), -1)
    gone = np.cumsum(change) > 0
    out = []
    for k, doc_id in enumerate(ids.tolist()):
        mine = gone[view.at[k] : view.stop[k]]
        n_spans = int(np.count_nonzero(np.diff(mine.astype(np.int8), prepend=0) == 1))
        kept = scheme.keep(view, k, ~mine)
        out.append((None if doc_id == C.NO_ID else doc_id, len(mine), int(mine.sum()), n_spans, kept))
    return pd.DataFrame(out, columns=RESULT).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, and what is kept (bytes) of every row."""
    spark = docs.sparkSession
    bits = C.bucket_bits(spark)
    read = C.read_columns(docs, id_col, text_col)
    texts = C.packed_texts(read).groupBy("chunk")
    answers = asks(read, scheme, bits).groupBy("bucket").applyInPandas(_answer, "chunk bigint, bucket int, bits binary")
    answers = stored(answers, "answers")
    release(spark)
    fragments = texts.cogroup(answers.groupBy("chunk")).applyInPandas(lambda t, a: _fragments(scheme, bits, t, a), WORK)
    spans = stored(fragments.groupBy("bucket").applyInPandas(lambda p: _compare(scheme, p), SPANS), "spans")
    del fragments
    release(spark)
    found = spans.withColumn("bucket", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    schema = "doc_id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept binary"
    return texts.cogroup(found.groupBy("chunk")).applyInPandas(lambda t, f: _finish(scheme, bits, t, f), schema)
