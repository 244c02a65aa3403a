"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Count tables of all orders are partitioned by the n-grams' hashes. Each chunk of documents sends its n-grams to them and is
joined to the corpus counts that come back; every word then gets the score of the longest n-gram that other documents hold
as well, and the scores are summed per document. A document's own n-grams are taken off the counts, since otherwise none
would ever be unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm import chunks as C
from leadsmith.llm.words import ODD, joined, mix, span_hashes, word_spans

ORDER, BACKOFF = 3, 0.4
#: Word scores are decimal logarithms in millionths, so that their sums are exact whatever their order.
UNIT = 1_000_000
#: Larger chunks send fewer n-grams, since each chunk sends an n-gram once.
NGRAM_CHUNK = 4_000_000


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for each order the hashes of the n-grams that END at each word, and where there is one."""
    data, at = joined(texts)
    start, end = word_spans(data)
    words = span_hashes(data, start, end)
    first = np.searchsorted(start, at)
    counts = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], counts)
    grams, valid = [], []
    run = np.zeros(len(words), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(words), np.uint64)
        shifted[n:] = words[: len(words) - n] if n else words
        run = run + mix(shifted + np.uint64(ODD[50 + n]))
        grams.append(mix(run ^ np.uint64(ODD[60 - n])))
        valid.append(place >= n)
    return counts, grams, valid


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    _, grams, valid = ngrams(texts, order)
    return np.unique(np.concatenate([g[v] for g, v in zip(grams, valid, strict=True)]), return_counts=True)


def _asks(docs: DataFrame, order: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.chunked(batches, NGRAM_CHUNK):
            keys, counts = _distinct(chunk.texts, order)
            short = C.shorten(keys, bits)
            rows = [(b, C.pack_keys(short[i:j]), C.pack_counts(counts[i:j])) for b, i, j in C.by_bucket(keys, bits)]
            if rows:
                bucket, packed, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket, pa.int32()),
                        pa.array([chunk.number] * len(rows), pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(n, pa.binary()),
                    ],
                    names=["bucket", "chunk", "grams", "counts"],
                )

    return docs.mapInArrow(run, "bucket int, chunk bigint, grams binary, counts binary")


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of the n-grams that each chunk asked a bucket for."""
    grams = [C.unpack_keys(k) for k in pdf["grams"]]
    counts = np.concatenate([C.unpack_counts(c) for c in pdf["counts"]])
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(place, weights=counts).astype(np.int64)[place]
    parts = np.split(totals, np.cumsum([len(g) for g in grams])[:-1])
    return pd.DataFrame(
        {"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "totals": [C.pack_counts(p) for p in parts]}
    )


RESULT = "doc_id bigint, n_words bigint, log_score bigint, n_backed_off bigint, n_unseen bigint"


def _scores(order: int, bits: int, n_corpus: int, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    chunk = C.only(texts)
    ids = np.frombuffer(chunk["ids"], np.int64)
    bodies = C.unpack_texts(chunk["sizes"], chunk["blob"])
    n_words, grams, valid = ngrams(bodies, order)
    owner = np.repeat(np.arange(len(bodies)), n_words)
    keys, place = np.unique(np.concatenate([g[v] for g, v in zip(grams, valid, strict=True)]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    given = dict(zip(answers["bucket"], answers["totals"], strict=True))
    for b, i, j in C.by_bucket(keys, bits):
        totals[i:j] = C.unpack_counts(given[b])
    # The n-gram's count in other documents, for each order and word.
    other, at = [], 0
    for v in valid:
        mine = place[at : at + int(v.sum())]
        at += int(v.sum())
        pair = owner[v] * np.int64(len(keys)) + mine
        _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.zeros(len(owner), np.int64)
        count[v] = totals[mine] - own[back]
        other.append(count)
    others = np.maximum(n_corpus - n_words, 0)[owner].astype(float)
    longest = np.minimum(order - 1, np.arange(len(owner)) - np.repeat(np.cumsum(n_words) - n_words, n_words))
    score = np.full(len(owner), -1.0)
    used = np.full(len(owner), -1)
    for n in range(order - 1, -1, -1):
        if n:  # the context is the n-gram that ends one word earlier; it stands in others wherever the longer one does
            context = np.concatenate([[0], other[n - 1][:-1]]).astype(float)
        else:
            context = others
        fit = (used < 0) & valid[n] & (other[n] > 0)
        score[fit] = BACKOFF ** (longest[fit] - n) * (other[n][fit] / np.maximum(context[fit], 1))
        used[fit] = n
    unseen = used < 0
    score[unseen] = BACKOFF ** (longest[unseen] + 1) / (others[unseen] + 1)
    logs = np.rint(np.log10(score) * UNIT).astype(np.int64)
    sums = np.zeros(len(bodies), np.int64)
    np.add.at(sums, owner, logs)
    backed = np.bincount(owner[(used >= 0) & (used < longest)], minlength=len(bodies))
    missed = np.bincount(owner[unseen], minlength=len(bodies))
    found = pd.DataFrame({"doc_id": ids, "n_words": n_words, "log_score": sums, "n_backed_off": backed, "n_unseen": missed})
    found["doc_id"] = found["doc_id"].astype("Int64").mask(found["doc_id"] == C.NO_ID)
    return found


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (sum over words, in millionths), n_backed_off, n_unseen, mean_log10 of every row.

    A word's score is the relative count of the longest n-gram that ends at it and that other rows hold as well, times
    BACKOFF for each order given up; a word that no other row holds gets one more BACKOFF and a count of 1. Null and blank
    texts have no words, a sum of 0 and a null mean. Repeated rows are other rows to each other. Null identifiers stay null.
    """
    spark = docs.sparkSession
    bits = C.bucket_bits(spark)
    read = C.read_columns(docs, id_col, text_col)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n_corpus = read.agg(F.sum(words.cast("bigint"))).first()[0] or 0
    totals = _asks(read, order, bits).groupBy("bucket").applyInPandas(_totals, "chunk bigint, bucket int, totals binary")
    scored = (
        C.packed_texts(read, NGRAM_CHUNK)
        .groupBy("chunk")
        .cogroup(totals.groupBy("chunk"))
        .applyInPandas(lambda t, a: _scores(order, bits, n_corpus, t, a), RESULT)
    )
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / (UNIT * F.col("n_words")), 6))
    return scored.withColumn("mean_log10", mean)
