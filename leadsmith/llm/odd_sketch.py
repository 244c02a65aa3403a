"""MinHash near-deduplication with odd sketches.

A document's MinHash samples serve twice: in bands, they bring candidates together; folded into a parity bitmap (the odd
sketch), they tell by the population count of an exclusive or how similar two candidates are, which rules out all pairs
that are surely unlike. What is left is confirmed on the full shingle sets.

Equal sets are one class with one representative from the start. Within a band's bucket, two representatives (the smallest
and the largest identifier) are compared with all others, which links any group of copies in a number of pairs that grows
with its rows. Only where a bucket still holds several components are the pairs between those looked at one by one, each
pair in one bucket alone; shingles that no other such row has bound from above what a row can share with any of them, which
leaves out the rows that were changed too much without comparing them. No bucket is capped and none is gathered in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.components import components
from leadsmith.llm.shared import discard, release, stored
from leadsmith.llm.words import LOWER, ODD, joined, mix, span_hashes, word_spans

#: Bands of the MinHash samples. A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 8
#: Estimates below this are over five standard errors under 0.8: no link.
LEAST_ESTIMATE = 0.55
BATCH_BYTES = 1_000_000


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(1, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; of the whole sequence, if it has fewer words."""
    data, at = joined([(t or "").encode() for t in texts])
    data = LOWER[data]
    start, end = word_spans(data)
    words = span_hashes(data, start, end)
    first = np.searchsorted(start, at)
    n = len(words) - width + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(width):
            grams += words[k : k + n] * np.uint64(ODD[k])
        grams = mix(grams)
    sets = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            sets.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            short = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                short = mix(words[k : k + 1] * np.uint64(ODD[k - lo]) + short)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES smallest values of each set under as many permutations of 32-bit values."""
    a, b = _constants()
    out = np.zeros((len(sets), SAMPLES), np.uint32)
    for k, s in enumerate(sets):
        low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[i : i + 1024, None] * a + b).min(0), out=low)
        out[k] = low
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(samples), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(ODD[k]) + parts[:, :, k])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the pairs (sample number, value), as 64-bit integers."""
    bits = SKETCH_LONGS * 64
    numbered = samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))
    place = (mix(numbered) % np.uint64(bits)).astype(np.int64) + bits * np.arange(len(samples))[:, None]
    odd = np.bincount(place.ravel(), minlength=bits * len(samples)) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64).reshape(len(samples), SKETCH_LONGS)


def estimate(z: Column) -> Column:
    """Similarity by the number of ones in the exclusive or of two odd sketches; 0 where that is too large to tell."""
    bits = SKETCH_LONGS * 64
    share = 1 - 2 * z / bits
    return F.when(share > 0, 1 + bits / (4 * SAMPLES) * F.log(F.greatest(share, F.lit(1e-9)))).otherwise(F.lit(0.0))


#: The largest number of differing bits at which the estimate reaches LEAST_ESTIMATE.
MOST_BITS = int(SKETCH_LONGS * 32 * (1 - math.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / (SKETCH_LONGS * 64))))


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_LONGS)), F.lit(0))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _long_lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), d1 and d2 (digests of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _batches(batches):
            sets = shingle_sets(texts, width)
            samples = minhash(sets)
            d1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
            d2 = np.array([int(mix(s ^ np.uint64(ODD[9])).sum(dtype=np.uint64)) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    _long_lists(band_keys(samples)),
                    _long_lists(odd_sketches(samples)),
                ],
                names=["doc_id", "n", "d1", "d2", "bands", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """rep, shingles: the full sets as arrays of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _batches(batches):
            sets = shingle_sets(texts, width)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["rep", "shingles"]
            )

    return docs.mapInArrow(run, "rep bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v whose full sets share ``percent`` or more of their union."""
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    both = both.select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv")).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("u", "v")


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs, those that the sketches leave open and the full sets confirm."""
    pairs = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sketch_u = reps.select(F.col("rep").alias("u"), F.col("sketch").alias("ku"))
    sketch_v = reps.select(F.col("rep").alias("v"), F.col("sketch").alias("kv"))
    alike = pairs.join(sketch_u, "u").join(sketch_v, "v").where(_differing("ku", "kv") <= MOST_BITS).select("u", "v")
    return stored(confirmed(alike, sets, percent), "links")


def _relabel(labels: DataFrame, links: DataFrame, first: bool = False) -> DataFrame:
    """(rep, label) after joining the components that ``links`` connect; at ``first`` each rep is its own label."""
    u = labels.select(F.col("rep").alias("u"), F.col("label").alias("lu"))
    v = labels.select(F.col("rep").alias("v"), F.col("label").alias("lv"))
    if not first:
        links = links.join(u, "u").join(v, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    found = components(links)
    found = found.select(F.col("node").alias("label"), F.col("label").alias("low"))
    return stored(labels.join(found, "label", "left").select("rep", F.coalesce("low", "label").alias("label")), "labels")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    labelled = buckets.select("rep", "band", "key").join(labels, "rep")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return stored(labelled.join(mixed, "key").select("rep", "band", "key", "label"), "open")


def _shareable(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, n (shingles), common: how many of them stand in another open row too."""
    held = rows.select("rep").distinct().join(sets, "rep")
    alone = held.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("k"))
    alone = alone.where("k = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    size = held.select("rep", F.size("shingles").cast("bigint").alias("n"))
    return size.join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _rest_links(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components of a bucket: pairs that bounds and sketches leave open, each in the first bucket it shares.

    The full sets are compared in the join itself, so that only links leave it. The tables given are deleted once they are joined.
    """
    able = _shareable(rows, sets).where(100 * F.col("common") >= percent * F.col("n"))
    full = stored(rows.join(able, "rep").join(reps, "rep").join(sets, "rep"), "rest")
    discard(rows, reps, sets)
    del able
    release(full.sparkSession)
    columns = ("rep", "label", "bands", "sketch", "n", "common", "shingles")
    a = full.select("key", "band", *[F.col(c).alias(f"{c}_u") for c in columns])
    b = full.select("key", *[F.col(c).alias(f"{c}_v") for c in columns])
    earlier = F.exists(F.slice(F.zip_with("bands_u", "bands_v", lambda x, y: x == y), 1, F.col("band")), lambda same: same)
    across = (a["key"] == b["key"]) & (F.col("rep_u") < F.col("rep_v")) & (F.col("label_u") != F.col("label_v"))
    most = (100 + percent) * F.least("common_u", "common_v") >= percent * (F.col("n_u") + F.col("n_v"))
    shared = F.size(F.array_intersect("shingles_u", "shingles_v"))
    alike = (100 + percent) * shared >= percent * (F.col("n_u") + F.col("n_v"))
    pairs = a.join(b, across & most & (_differing("sketch_u", "sketch_v") <= MOST_BITS) & ~earlier & alike)
    links = stored(pairs.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")), "links")
    discard(full)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null, empty and blank texts have no shingles and are linked with nothing: their component is their own identifier.
    Repeated rows have equal sets, hence one component. A null identifier takes the component of the class of equal sets
    that it lies in (null if that has no other identifier), but is never a representative. An empty table gives an empty
    result; only the two named columns are read.
    """
    if percent < 80:
        raise ValueError("bands and sketches are laid out for similarities of 0.8 or more")
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signs = stored(signatures(read, width), "signatures")
    key = ["n", "d1", "d2"]
    named = stored(signs.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(
        signs.where("n > 0").join(named, key).where("doc_id = rep").select("rep", "bands", "sketch").dropDuplicates(["rep"]),
        "representatives",
    )
    members = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    pivots = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    buckets = stored(members.join(pivots, "key"), "buckets")
    labels = stored(buckets.select("rep").distinct().withColumn("label", F.col("rep")), "labels")
    sets = stored(full_sets(read.join(labels, F.col("doc_id") == F.col("rep")).select("rep", "text"), width), "sets")

    release(docs.sparkSession)

    stars = buckets.select(F.explode(F.array("low", "high")).alias("u"), F.col("rep").alias("v"))
    labels = _relabel(labels, _links(stars, reps, sets, percent), first=True)
    release(docs.sparkSession)
    rows = _open(buckets, labels)
    discard(buckets)
    release(docs.sparkSession)
    links = _rest_links(rows, reps, sets, percent)
    if not links.isEmpty():
        labels = _relabel(labels, links)
    release(docs.sparkSession)
    return (
        signs.select("doc_id", *key)
        .join(named, key, "left")
        .join(labels, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
