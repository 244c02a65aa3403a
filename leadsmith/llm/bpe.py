"""Byte-level BPE encoding and decoding over whole texts.

A batch of texts is cut into words by array operations on its code points, each distinct word is encoded once, and its ids
are copied to every place where it stands. Short words not seen before are encoded together, by the contiguous rank array:
one row a word holds its part boundaries and the ranks of adjacent parts; each step takes the minimum of every row, deletes
that boundary and refreshes the two neighbouring ranks, until no row has a rank left. Words longer than SHORT bytes, for
which repeated scans cost too much, go to the tokenizers library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.words import span_hashes

#: Longest word, in bytes, that the rank array takes; the texts that are encoded together, in characters; and the ids that
#: a worker remembers (it forgets all beyond that, which costs time but changes no result).
SHORT, BATCH_CHARS, REMEMBERED = 48, 1_500_000, 4_000_000
NONE = np.int32(2**30)
LETTER, NUMBER, BLANK, OTHER, EDGE = range(5)
#: White space as the tokenizer's pattern takes it, without the information separators 1C to 1F.
BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the pattern splits off behind an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[BLANKS] = BLANK
    return found


def cut_words(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words start, in code points of several texts in a row, each followed by one separator at ``edges``.

    The separators start a word of their own. A word is a contraction's ending, or letters, numbers or other characters
    with one blank before them, or blanks; of several blanks before a word the last stands apart.
    """
    n = len(points)
    kind = _classes()[points]
    kind[edges] = EDGE
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    starts = first.copy()
    blank = kind == BLANK
    at = np.flatnonzero(blank[:-1] & (kind[1:] < EDGE) & ~blank[1:])  # last blank before a word
    starts[at] = True
    starts[at[points[at] == 0x20] + 1] = False
    mark = np.flatnonzero((points[:-1] == 0x27) & starts[:-1] & (kind[1:] == LETTER))
    if len(mark):
        tail = np.concatenate([points, np.zeros(3, points.dtype)])
        size = np.zeros(len(mark), np.int64)
        for e in ENDINGS[::-1]:
            same = np.ones(len(mark), bool)
            for k, c in enumerate(e):
                same &= tail[mark + 1 + k] == ord(c)
            size[same] = len(e)
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        starts[mark + 1 + size] = True
    return np.flatnonzero(starts)


class Encoder:
    """Vocabulary, merges and remembered words of one tokenizer file; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(Path(path).read_text())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        shown = _shown_bytes()
        self.byte_ids = np.array([vocab[c] for c in shown], np.int32)
        back = {c: b for b, c in enumerate(shown)}
        bytes_of = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in vocab.items():
            bytes_of[i] = bytes(back[c] for c in token) if token not in self.special else b""
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.n_bytes = np.array([len(b) for b in bytes_of], np.int64)
        self.at_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.known: dict[int, int] = {}
        self.start, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n_pool = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_short(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as rows of bytes: ids in a row, and how many there are of each word."""
        n, width = rows.shape
        parts = self.byte_ids[rows]
        inside = np.arange(width - 1)[None, :] < (sizes - 1)[:, None]
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = np.where(inside, self._rank(parts[:, :-1], parts[:, 1:]), NONE)
        left, live = sizes.astype(np.int64).copy(), np.arange(n)
        p, r, size = parts, ranks, left.copy()
        cols = np.arange(width)
        while len(live):
            low = r.argmin(1)
            row = np.arange(len(live))
            best = r[row, low]
            ends = best == NONE
            if ends.any():
                done = live[ends]
                parts[done], left[done] = p[ends], size[ends]
                go = ~ends
                live, p, r, size, low, best = live[go], p[go], r[go], size[go], low[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            source = np.minimum(cols + (cols > low[:, None]), width - 1)  # deletes the boundary behind the minimum
            p = np.take_along_axis(p, source, 1)
            r = np.take_along_axis(r, source, 1)
            r[:, -1] = NONE
            p[row, low] = self.merged[best]
            size -= 1
            after = low + 1 < size
            r[row, low] = NONE
            r[row[after], low[after]] = self._rank(p[row[after], low[after]], p[row[after], low[after] + 1])
            before = low > 0
            r[row[before], low[before] - 1] = self._rank(p[row[before], low[before] - 1], p[row[before], low[before]])
        return parts[cols[None, :] < left[:, None]], left

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: list[int]) -> None:
        """Encode words that are not remembered yet."""
        n = len(self.known)
        need = n + len(size)
        while need > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        ids_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in (4, 8, 12, 16, 24, SHORT):
            mine = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(mine), 65_536):
                w = mine[k : k + 65_536]
                at = np.minimum(start[w, None] + np.arange(width), len(data) - 1)
                ids_of.append((w, *self.encode_short(data[at], size[w])))
        long = np.flatnonzero(size > SHORT)
        for w in long:
            word = data[start[w] : start[w] + size[w]].tobytes().decode()
            ids = np.array(self._by_library(word), np.int32)
            ids_of.append((np.array([w]), ids, np.array([len(ids)])))
        for w, ids, count in ids_of:
            while self.n_pool + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, self.pool])
            self.pool[self.n_pool : self.n_pool + len(ids)] = ids
            self.start[n + w] = self.n_pool + np.cumsum(count) - count
            self.size[n + w] = count
            self.n_pool += len(ids)
        self.known.update(zip(hashes, range(n, need), strict=True))

    def _by_library(self, word: str) -> list[int]:
        return self.library.encode(word, add_special_tokens=False).ids

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of ordinary text, and the id of the special token behind each (-1: none)."""
        while True:
            found = [(text.find(s), -len(s), s) for s in self.special if s in text]
            if not found:
                yield text, -1
                return
            at, _, s = min(found)
            yield text[:at], self.special[s]
            text = text[at + len(s) :]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many there are of each."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces, special, owner = [], [], []
        for k, text in enumerate(texts):
            for piece, i in self._pieces(text) if any(s in text for s in self.special) else ((text, -1),):
                pieces.append(piece)
                special.append(i)
                owner.append(k)
        whole = "\0".join(pieces) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edges = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        starts = cut_words(points, edges)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at_byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at_byte[1:])
        del width
        data = np.frombuffer(whole.encode(), np.uint8)
        is_edge = np.zeros(len(points), bool)
        is_edge[edges] = True
        edge_word = is_edge[starts]
        begin, end = at_byte[starts], at_byte[np.append(starts[1:], len(points))]
        word = ~edge_word
        hashes = span_hashes(data, begin[word], end[word])
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n_pool > REMEMBERED:
            self.known, self.n_pool = {}, 0
        known, listed = self.known, distinct.tolist()
        new = [k for k, h in enumerate(listed) if h not in known]
        if new:
            where = first[new]
            b = begin[word][where]
            self._learn(data, b, end[word][where] - b, [listed[k] for k in new])
        entry = np.fromiter((known[h] for h in listed), np.int64, len(listed))
        # One entry per word or separator: a separator gives its special token, or nothing.
        count = np.zeros(len(starts), np.int64)
        source = np.zeros(len(starts), np.int64)
        e = entry[inverse]
        count[word], source[word] = self.size[e], self.start[e]
        marks = np.asarray(special, np.int64)
        count[edge_word] = marks >= 0
        ends = np.cumsum(count)
        total = int(ends[-1])
        index = np.arange(total) + np.repeat(source - (ends - count), count)
        marked = np.repeat(edge_word, count)
        index[marked] = 0
        ids = self.pool[index]
        ids[marked] = marks[marks >= 0]
        per_piece = np.diff(np.concatenate([[0], ends[edge_word]]))
        return ids, np.bincount(np.asarray(owner, np.int64), weights=per_piece, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        size = self.n_bytes[ids]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at_byte[ids] - (ends - size), size)
        return self.all_bytes[index].tobytes().decode("utf-8", "replace")


def _shown_bytes() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, spare = [], 0x100
    for b in range(256):
        if b in printable:
            shown.append(chr(b))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most BATCH_CHARS characters or one text; null texts as empty."""
    keys: list = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if texts and chars + len(text) > BATCH_CHARS:
                yield keys, texts
                keys, texts, chars = [], [], 0
            keys.append(key)
            texts.append(text)
            chars += len(text) + 1
    if texts:
        yield keys, texts


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, and the text decoded from these ids.

    Null and empty texts give no ids and an empty text. Rows stand for themselves: repeated rows and null identifiers come
    out as they went in. Only the two named columns are read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for keys, texts in text_batches(batches):
            ids, counts = tokenizer.encode(texts)
            ends = np.cumsum(counts)
            cut = [ids[e - c : e] for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([c.astype("<u4").tobytes() for c in cut], pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array([tokenizer.decode(c) for c in cut], pa.string()),
                ],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
