"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded, hash-chosen sample of labelled training rows: words and word beginnings that stand in
many more toxic than other texts. Every whole text then gives lexicon densities, second-person proximity, capitals,
punctuation and obfuscation rates; trees are fitted on most of the sample and calibrated on the rest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.llm.shared import stored
from leadsmith.llm.words import LOWER, joined, span_hashes

#: Bound of the sample of labelled rows on which lexicon, trees and calibration are fitted, and the share for calibration.
SAMPLE_ROWS, CALIBRATION = 12_000, 0.2
#: Byte lengths of word beginnings that may enter the lexicon, least toxic texts with a term, and most terms.
BEGINNINGS, LEAST_TEXTS, MOST_TERMS = (4, 5, 6, 7, 8), 8, 400
#: Words that address a reader, by language: English, German, French, Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur ya du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros vuestro tuyo"
).split()
#: Look-alikes of letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR_WORDS = 6
FEATURES = (
    "strong_rate",
    "strong_count",
    "strong_kinds",
    "mild_rate",
    "best_score",
    "disguised_hits",
    "second_rate",
    "second_near",
    "upper_share",
    "capital_words",
    "exclamations",
    "questions",
    "punctuation",
    "mixed_words",
    "stretched",
    "log_words",
)
BATCH_BYTES = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DISGUISE = LOWER.copy()
for _c, _l in LOOKALIKES.items():
    _DISGUISE[ord(_c)] = ord(_l)
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in LOOKALIKES]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the accented capitals U+00C0 to U+00DE."""
    out = LOWER[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[accented] += 0x20
    return out


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Lexicon:
    """Hashes of terms in order, and their scores; a word counts with the best term that it is or begins with."""

    hashes: np.ndarray
    scores: np.ndarray
    terms: list[str]

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        best = np.zeros(len(start))
        if not len(self.hashes):
            return best
        size = end - start
        for length in (0, *BEGINNINGS):
            mine = np.arange(len(start)) if not length else np.flatnonzero(size > length)
            h = span_hashes(data, start[mine], end[mine] if not length else start[mine] + length)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            best[mine] = np.maximum(best[mine], np.where(self.hashes[at] == h, self.scores[at], 0.0))
        return best


def term_hashes(terms: list[str]) -> np.ndarray:
    data, at = joined([t.encode("utf-8", "surrogateescape") for t in terms])
    return span_hashes(data, at[:-1], at[1:] - 1)


def terms_of(data: np.ndarray) -> set[bytes]:
    """Words, and beginnings of longer words, of one text in lower case."""
    raw = data.tobytes()
    found = {raw[a:b] for a, b in zip(*(x.tolist() for x in spans(_LETTER[data])), strict=True)}
    return found | {w[:n] for w in found for n in BEGINNINGS if len(w) > n}


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text, computed for all texts at once; an empty text gives zeros."""
    data, at = joined([(t or "").encode() for t in texts])
    low = lowered(data)
    n = len(texts)

    start, end = spans(_LETTER[data])
    owner = np.searchsorted(at, start, "right") - 1
    score = lexicon.word_scores(low, start, end)
    strong, mild = score >= math.log(20), score > 0
    count = lambda mask, own=owner: np.bincount(own[mask], minlength=n)[:n].astype(float)
    n_words = np.bincount(owner, minlength=n)[:n].astype(float)
    rate = 100.0 / np.maximum(n_words, 1)
    best = np.zeros(n)
    np.maximum.at(best, owner[mild], score[mild])
    kinds = np.unique(np.stack([owner[strong].astype(np.uint64), span_hashes(low, start[strong], end[strong])]), axis=1)[0]

    second = np.isin(span_hashes(low, start, end), term_hashes(SECOND_PERSON))
    nearest = np.flatnonzero(second)
    hits = np.flatnonzero(strong)
    near = np.zeros(len(hits), bool)
    if len(nearest):
        k = np.searchsorted(nearest, hits)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(nearest) - 1)):
            near |= (np.abs(nearest[side] - hits) <= NEAR_WORDS) & (owner[nearest[side]] == owner[hits])

    upper = (data >= 0x41) & (data <= 0x5A)
    sums = np.concatenate([[0], np.cumsum(upper)])
    capital = (end - start >= 2) & (sums[end] - sums[start] == end - start)
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), at[:-1]).astype(float)
    letters = np.maximum(total(_LETTER[data]), 1)
    chars = np.maximum(np.diff(at) - 1, 1).astype(float)

    token = _LETTER[data] | _MASK[data]
    t_start, t_end = spans(token)
    lead = np.append(_MASK[data[:-1]] & _LETTER[data[1:]], False)  # a look-alike with a letter behind it
    leads = np.concatenate([[0], np.cumsum(lead)])
    mixed = leads[t_end] > leads[t_start]
    m_start, m_end = t_start[mixed], t_end[mixed]
    m_owner = np.searchsorted(at, m_start, "right") - 1
    disguised = lexicon.word_scores(_DISGUISE[lowered(data)], m_start, m_end) >= math.log(20)
    stretched = np.zeros(len(data), bool)
    stretched[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & _LETTER[data[:-2]]

    return np.stack(
        [
            count(strong) * rate,
            np.log1p(count(strong)),
            np.bincount(kinds.astype(np.int64), minlength=n)[:n].astype(float),
            count(mild & ~strong) * rate,
            best,
            np.bincount(m_owner[disguised], minlength=n)[:n].astype(float),
            count(second) * rate,
            np.bincount(owner[hits[near]], minlength=n)[:n].astype(float),
            total(upper) / letters,
            count(capital) * rate,
            total(data == ord("!")) / chars * 100,
            total(data == ord("?")) / chars * 100,
            total((data >= 0x21) & (data <= 0x7E) & ~_LETTER[data]) / chars,
            np.bincount(m_owner, minlength=n)[:n] * rate,
            total(stretched) / chars * 100,
            np.log1p(n_words),
        ],
        axis=1,
    )


def _text_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Rows and their texts, cut where the texts come to BATCH_BYTES."""
    for batch in batches:
        rows = batch.column(0)
        texts = rows.field(text_col).to_pylist()
        part = np.cumsum([len(t or "") for t in texts]) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield rows.slice(a, b - a), texts[a:b]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of the sample (text, toxic) by their log odds, shrunk by counts; at most MOST_TERMS of them.

    Both collected tables are bounded by the sample: terms in LEAST_TEXTS toxic texts or more, and their counts elsewhere.
    """
    n_toxic, n_other = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()

    def counted(wanted: set[bytes] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    terms = terms_of(lowered(np.frombuffer((text or "").encode(), np.uint8))) if text else set()
                    seen.update(terms if wanted is None else terms & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"]
            )

        return run

    def counts(rows: DataFrame, wanted: set[bytes] | None) -> DataFrame:
        return rows.select("text").mapInArrow(counted(wanted), "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    toxic = {bytes(r.term): r.n for r in counts(sample.where("toxic = 1"), None).where(F.col("n") >= LEAST_TEXTS).collect()}
    other = {bytes(r.term): r.n for r in counts(sample.where("toxic = 0"), set(toxic)).collect()}
    scored = []
    for term, p in toxic.items():
        n = other.get(term, 0)
        odds = math.log((p + 0.5) / (n_toxic + 1)) - math.log((n + 0.5) / (n_other + 1))
        z = odds / math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if odds >= math.log(4) and z >= 2.5:
            scored.append((z, odds, term))
    top = sorted(scored, reverse=True)[:MOST_TERMS]
    terms = [t.decode("utf-8", "surrogateescape") for _, _, t in top]
    hashes, scores = (term_hashes(terms) if terms else np.zeros(0, np.uint64)), np.array([o for _, o, _ in top])
    order = np.argsort(hashes)
    return Lexicon(hashes[order], scores[order], terms)


def with_features(docs: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """Column ``row`` with the whole row, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _text_batches(batches, text_col):
            found = features(texts, lexicon)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["row", "features"]
            )

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, toxic) of at most about SAMPLE_ROWS training rows, chosen by a hash of the identifier."""
    train = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, SAMPLE_ROWS / max(1, train.count()))
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # About SAMPLE_ROWS identifiers with a label each: bounded by that parameter.
    return texts.join(F.broadcast(chosen), "doc_id")


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as column ``row``, with held_out, score (0 to 1) and predicted (score of 0.5 or more).

    Labels are taken from training rows alone: those whose CRC-32 of the identifier as text is no multiple of 5. Null and
    empty texts have features, hence a score; a null identifier is not held out and never trains. Repeated rows are scored
    alike. Without toxic and other training rows every score is the share of toxic ones, 0 if there are none at all.
    """
    sample = stored(labelled_sample(docs, labels, id_col, text_col), "sample").coalesce(6)
    lexicon_rows = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(100)) < 60)
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    flags = {"held_out": held_out(F.col(f"row.`{id_col}`"))}
    enough = lexicon_rows.agg(F.min("toxic"), F.max("toxic")).first()
    if not n or not 0 < toxic < n or enough != (0, 1):
        return docs.select(F.struct("*").alias("row")).withColumns(
            flags | {"score": F.lit(float(toxic or 0) / max(n, 1)), "predicted": F.lit(int(2 * (toxic or 0) >= max(n, 1)))}
        )
    lexicon = learn_lexicon(lexicon_rows)
    known = with_features(sample, "text", lexicon).select("row.doc_id", F.col("row.toxic").cast("double").alias("toxic"), "features")
    known = stored(known, "known").coalesce(2).withColumn("features", array_to_vector("features"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1000)) < int(CALIBRATION * 1000)
    trees = GBTClassifier(
        featuresCol="features", labelCol="toxic", maxIter=12, maxDepth=4, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=5
    ).fit(known.where(~part))
    margin = vector_to_array("rawPrediction")[1]
    marked = stored(trees.transform(known).where(part).select("toxic", margin.alias("margin")), "margins").coalesce(1)
    seen = marked.agg(F.min("toxic"), F.max("toxic")).first()
    scored = trees.transform(with_features(docs, text_col, lexicon).withColumn("features", array_to_vector("features")))
    scored = scored.select("row", margin.alias("margin"))
    if seen == (0.0, 1.0):
        curve = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(marked)
        scored = curve.transform(scored)
    else:  # no toxic row to calibrate on: the logistic of the margin
        scored = scored.withColumn("score", 1 / (1 + F.exp(-2 * F.col("margin"))))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select("row", score.alias("score")).withColumns(flags | {"predicted": (F.col("score") >= 0.5).cast("int")})


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``score_rows``."""
    scored = score_rows(docs.select(id_col, text_col), labels, id_col, text_col)
    return scored.select(F.col(f"row.`{id_col}`").alias("doc_id"), "held_out", "score", "predicted")


def non_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return score_rows(docs, labels, id_col, text_col).where("predicted = 0").select("row.*")
