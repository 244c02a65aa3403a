"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in an earlier document are removed.

Texts meet by anchors: of the 25 hashes of 26 bytes that lie in a 50-byte window, the smallest is the window's key, so equal
windows have the same one. In a bucket, the suffixes that start at a window are sorted (by as many bytes as a window has);
along that order, suffixes in a row with a common prefix of a window's length form a block, and a suffix has a previous
factor in an earlier document if the previous or the next smaller identifier in its block exists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from leadsmith.llm.repeats import Scheme, View, remove_repeats
from leadsmith.llm.words import joined, mix, ragged, rolling_hashes, span_hashes

WINDOW, GRAM = 50, 26


class EarlierBytes(Scheme):
    dtype = np.uint8

    def __init__(self, width: int = WINDOW, gram: int = GRAM):
        self.width, self.gram = width, gram

    def view(self, texts: list[bytes]) -> View:
        data, at = joined(texts)
        units = np.arange(len(data))
        return View(data, units, units + 1, at[:-1], at[1:] - 1)

    def keys(self, view: View) -> tuple[np.ndarray, None]:
        low = rolling_hashes(view.data, self.gram)
        span, done = self.width - self.gram + 1, 1
        while done < span:  # the minimum over ``span`` hashes in a row, by doubling
            step = min(done, span - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        # Minima are small numbers: mixed once more, they spread evenly over the buckets.
        return np.concatenate([mix(low), np.zeros(len(view.data) - len(low), np.uint64)]), None

    def occurrences(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        k, r = keys[order], rows[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(first)
        several = np.zeros(len(at), bool)
        if len(at):  # rows are in order within a key: another document if the last one differs
            several = r[at] != r[np.append(at[1:], len(k)) - 1]
        return k[at], several

    def settle(self, group: np.ndarray, ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, group, ids)
        removed = ids > low[group]
        return removed, ~removed, np.zeros(len(ids), bool)

    def fragments(self, view: View, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        end = last + self.width
        return view.data, first, end, span_hashes(view.data, first, end)

    def fragment_hashes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return span_hashes(data, at[:-1], at[1:])

    def window_counts(self, sizes: np.ndarray) -> np.ndarray:
        return sizes - self.width + 1

    def fragment_windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(at) - self.width + 1
        start = ragged(at[:-1], count)
        return np.lib.stride_tricks.sliding_window_view(data, self.width)[start], np.repeat(np.arange(len(count)), count)

    def repeated(self, windows: np.ndarray, ids: np.ndarray, several: np.ndarray) -> np.ndarray:
        windows = np.ascontiguousarray(windows)
        order = np.argsort(windows.view(f"S{self.width}").ravel(), kind="stable")  # the suffix array
        ranked, doc = windows[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(1)  # where the common prefix with the suffix before is shorter
        block = np.cumsum(new) - 1
        found = np.zeros(len(order), bool)
        found[order] = _smaller_before(doc, block) | _smaller_before(doc[::-1], block[-1] - block[::-1])[::-1]
        return found

    def keep(self, view: View, row: int, kept: np.ndarray) -> bytes:
        return view.data[view.at[row] : view.stop[row]][kept].tobytes()


def _smaller_before(doc: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether a smaller identifier stands before each place, in its block."""
    _, rank = np.unique(doc, return_inverse=True)
    step = int(rank.max()) + 1
    # Blocks are numbered upwards, so lowering each by its number lets one running minimum serve all of them.
    least = np.minimum.accumulate(rank - block * step) + block * step
    return least < rank


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of every row.

    Null texts are empty. Texts shorter than a window keep all. A document is later than another if its identifier is
    larger; null identifiers come last, and rows that repeat one identifier are never earlier than each other. An empty
    table gives an empty result. Only the two named columns are read.
    """
    found = remove_repeats(docs, EarlierBytes(width, (width + 2) // 2), id_col, text_col)
    return found.withColumnRenamed("n_units", "n_bytes").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
