"""Substring dedup by recompression: words in repeated windows are removed, all copies alike.

Words become symbols, and in rounds, runs of equal symbols and pairs of neighbours become one new symbol: two neighbours merge
if they are equal or if the round's hash bit puts the left one on the left and the right one on the right side. The new
symbol's name is a hash of what it stands for, so that all executors name alike without a common table. Whether neighbours
merge depends on those two alone; so each symbol carries the stretch of words that settles it (its own and one neighbour
more on each side, round by round), and within equal substrings all symbols that are settled inside are equal. A window's
key is the smallest symbol of the highest level that is settled inside the window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.repeats import Scheme, View, remove_repeats
from leadsmith.llm.words import ODD, joined, mix, powers, ragged, span_hashes, word_spans

WINDOW, LEVELS = 35, 5
U = np.uint64
PLACE = U(2**26 - 1)


def next_level(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, wall: np.ndarray, level: int) -> tuple:
    """One round: symbols, the words that settle them (from ``lo`` to ``hi``), and the walls between texts."""
    side = (mix(sym + U(ODD[level])) & U(1)).astype(bool)
    merge = (sym[:-1] == sym[1:]) | (~side[:-1] & side[1:])
    merge &= ~wall[:-1] & ~wall[1:]
    first = np.flatnonzero(np.concatenate([[True], ~merge]))
    size = np.diff(np.append(first, len(sym)))
    last = first + size - 1
    place = np.arange(len(sym)) - np.repeat(first, size)
    # Order matters in a block: each symbol is mixed with its place before they are summed.
    named = mix(np.add.reduceat(mix(sym ^ (place.astype(np.uint64) * U(ODD[16]))), first) + U(ODD[17 + level]))
    named = np.where(size == 1, sym[first], named)
    n = len(sym)
    # The first text has no wall before it, yet what stands first is not settled from within a window.
    return named, np.concatenate([[-1], lo])[first], hi[np.minimum(last + 1, n - 1)], wall[first]


class RepeatedWords(Scheme):
    dtype = np.uint64

    def __init__(self, width: int = WINDOW, levels: int = LEVELS):
        self.width, self.levels = width, levels

    def view(self, texts: list[bytes]) -> View:
        """Words of all texts joined by single spaces; behind each text stands one empty unit, the wall."""
        data, at = joined(texts)
        start, end = word_spans(data)
        bounds = np.searchsorted(start, at)
        n_texts = len(texts)
        count = np.diff(bounds)
        # A wall is an empty unit: insert one behind the words of each text.
        begin = np.insert(start, bounds[1:], at[1:] - 1)
        stop_at = np.insert(end, bounds[1:], at[1:] - 1)
        first = bounds[:-1] + np.arange(n_texts)
        size = stop_at - begin
        spaced = ragged(begin, size + 1)
        out_end = np.cumsum(size + 1)
        canon = data[spaced]
        canon[out_end - 1] = 0x20
        return View(canon, out_end - size - 1, out_end - 1, first, first + count)

    def keys(self, view: View) -> tuple[np.ndarray, np.ndarray]:
        n = len(view.begin)
        wall = view.begin == view.end
        sym = span_hashes(view.data, view.begin, view.end)
        lo, hi = np.arange(n), np.arange(n) + 1
        levels = [(sym, lo, hi)]
        for level in range(self.levels):
            sym, lo, hi, wall = next_level(sym, lo, hi, wall, level)
            levels.append((sym, lo, hi))
        keys, symbol = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        todo = ragged(view.at, np.maximum(view.stop - view.at - self.width + 1, 0))
        for level in range(self.levels, -1, -1):
            if not len(todo):
                break
            sym, lo, hi = levels[level]
            a = np.searchsorted(lo, todo, "left")
            b = np.searchsorted(hi, todo + self.width, "right")
            some = a < b
            if some.any():
                value = mix(sym ^ U(ODD[30 + level]))
                # The low bits give way to the place, so that the minimum is the first of the smallest symbols.
                if len(value) > int(PLACE):
                    raise OverflowError(f"{len(value)} symbols in one chunk: places have 26 bits")
                placed = np.append((value & ~PLACE) | np.arange(len(value), dtype=np.uint64), U(0))
                pairs = np.stack([a[some], b[some]], 1).ravel()
                at = (np.minimum.reduceat(placed, pairs)[::2] & PLACE).astype(np.int64)
                keys[todo[some]] = mix(value[at])  # minima are small numbers: mixed, they spread over the buckets
                symbol[todo[some]] = at + (level << 32)
            todo = todo[~some]
        return keys, symbol

    def occurrences(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, count = np.unique(keys, return_counts=True)
        return distinct, count > 1

    def settle(self, group: np.ndarray, ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        more = (np.bincount(group, weights=1 + several) > 1)[group]
        first = np.zeros(len(group), bool)
        first[np.unique(group, return_index=True)[1]] = True
        return more, first, more

    def fragments(self, view: View, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """A run's key, then a 64-bit sum over the words of each of its windows: 128 bits tell windows apart."""
        words = mix(span_hashes(view.data, view.begin, view.end) ^ U(ODD[42]))
        up, down = powers(len(words) + 1)
        sums = np.concatenate([[U(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        n = max(len(words) - self.width + 1, 0)
        windows = mix((sums[self.width :] - sums[:n]) * down[:n])
        size = last - first + 2
        end = np.cumsum(size)
        begin = end - size
        data = np.empty(int(end[-1]) if len(end) else 0, np.uint64)
        head = np.zeros(len(data), bool)
        head[begin] = True
        data[head] = keys
        data[~head] = windows[ragged(first, size - 1)]
        return data, begin, end, self.fragment_hashes(data, np.append(begin, len(data)))

    def fragment_hashes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0, np.uint64)
        place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
        return np.add.reduceat(mix(data + U(ODD[43]) * place.astype(U)), at[:-1])

    def window_counts(self, sizes: np.ndarray) -> np.ndarray:
        return sizes - 1

    def fragment_windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(at) - 1
        place = ragged(at[:-1] + 1, count)
        fragment = np.repeat(np.arange(len(count)), count)
        return np.stack([data[at[:-1]][fragment], data[place]], 1), fragment

    def repeated(self, windows: np.ndarray, ids: np.ndarray, several: np.ndarray) -> np.ndarray:
        order = np.lexsort((windows[:, 1], windows[:, 0]))
        ranked = windows[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return (np.bincount(place, weights=1 + several) > 1)[place]

    def keep(self, view: View, row: int, kept: np.ndarray) -> bytes:
        use = np.flatnonzero(kept) + view.at[row]
        return view.data[ragged(view.begin[use], view.end[use] - view.begin[use] + 1)].tobytes()[:-1]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept (the words that are left, joined by one space) of every row.

    A word goes if a window of ``width`` words covers it that also starts anywhere else, in the same text too. Null texts
    have no words. Repeated rows repeat all their windows, whatever their identifiers; null identifiers stay null. An empty
    table gives an empty result. Only the two named columns are read.
    """
    found = remove_repeats(docs, RepeatedWords(width), id_col, text_col)
    kept = F.col("kept").cast("string").alias("kept")
    return found.withColumnRenamed("n_units", "n_words").select("doc_id", "n_words", "n_removed", "n_spans", kept)
