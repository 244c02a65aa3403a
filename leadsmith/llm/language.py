"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language has a raw-content zstandard dictionary: pieces of texts of a bounded, hash-chosen sample of training rows. A
text is reduced to its letters in lower case and encoded in blocks, each with every dictionary; sizes are summed over the
whole text. The smallest sum wins, and an answer is rejected where the runner-up is nearly as small.

Results for awkward input: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; equal sums go to the language with more training rows, then by name; rows that repeat an identifier are scored each by
its own text; rows without an identifier are never learned from. Texts are read whole, and memory grows with the longest one.
Only doc_id, text and (for learning) lang are read of the columns; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The model is fitted on at most SAMPLE_ROWS rows a language, PIECE characters of each; a dictionary has DICTIONARY bytes at most.
SAMPLE_ROWS, PIECE, DICTIONARY = 400, 400, 32_768
#: Bytes of letters encoded at a time.
BLOCK = 4096
#: Spaces before each block: they always compress, so that no block is stored raw and short texts differ in size as well.
PAD = b" " * 200
#: An answer is rejected if the runner-up needs less than so many hundredths more than the winner.
NARROW = 1.0
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str | None) -> bytes:
    """The words of a text in lower case, with one space around each; empty if there is no letter."""
    found = _OTHER.sub(" ", text or "").strip().lower()
    return f" {found} ".encode() if found else b""


@dataclass(frozen=True)
class Dictionaries:
    """Languages in order of preference on equal sizes, and their dictionaries."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]


def learn(docs: DataFrame) -> Dictionaries:
    """Dictionaries from the rows that are not held out and have a lang and a letter.

    One pass over identifiers counts the rows of each language; rows below a hash bound (about twice the sample) are read, and
    the first SAMPLE_ROWS of them by hash are the sample. Languages come to the driver, not documents.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Dictionaries((), ())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * SAMPLE_ROWS / n))))
    piece = F.substring("text", 1, PIECE).alias("piece")
    near = rows.where((place < F.element_at(share, F.col("lang"))) & F.col("text").rlike(r"\p{L}")).select("lang", piece, F.xxhash64("doc_id").alias("at"))
    sample = near.withColumn("k", F.expr("row_number() over (partition by lang order by at, piece)")).where(F.col("k") <= SAMPLE_ROWS)
    pieces: dict[str, dict[bytes, None]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["k"])):
        if found := letters(r["piece"]):
            pieces.setdefault(r["lang"], {})[found] = None
    langs = sorted(pieces, key=lambda lang: (-counts[lang], lang))
    return Dictionaries(tuple(langs), tuple(b"".join(pieces[lang])[:DICTIONARY] for lang in langs))


@lru_cache(maxsize=1)
def _encoders(known: Dictionaries) -> list[zstandard.ZstdCompressor]:
    found = []
    for content in known.contents:
        params = zstandard.ZstdCompressionParameters.from_level(
            9, dict_size=DICTIONARY, source_size=BLOCK, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, write_content_size=0
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        found.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
    return found


def sizes(text: str | None, known: Dictionaries) -> list[int] | None:
    """Bytes of the whole text under each dictionary; none if there is no letter or no dictionary."""
    data = letters(text)
    if not data or not known.langs:
        return None
    blocks = [PAD + data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    return [sum(len(encoder.compress(block)) for block in blocks) for encoder in _encoders(known)]


def decide(found: list[int] | None, known: Dictionaries) -> tuple[str, float, float, bool]:
    """(language, score, margin in hundredths, rejected): the score is the winner's share of 2^-size over all languages."""
    if found is None:
        return UNKNOWN, 0.0, 0.0, True
    best = min(range(len(found)), key=found.__getitem__)
    others = [n for k, n in enumerate(found) if k != best]
    margin = 100.0 * (min(others) - found[best]) / found[best] if others else 100.0
    score = 1.0 / (1.0 + sum(2.0 ** -min(n - found[best], 1000) for n in others))
    return known.langs[best], score, margin, margin < NARROW


def identify(docs: DataFrame, known: Dictionaries | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every whole text; ``known`` may come from other documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs) if known is None else known)
    doc_id = docs.schema["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [decide(sizes(text.as_py(), known), known) for text in batch.column(2)]
            names = ("lang_pred", "score", "margin", "rejected")
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([r[k] for r in found], types[k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", *names])

    schema = T.StructType(
        [
            T.StructField("doc_id", doc_id.dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, schema)
