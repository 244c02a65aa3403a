"""Corpus pipeline: toxicity filter, exact dedup, near dedup, PII pseudonyms, packing.

Each stage takes all rows that the one before it kept, written as Parquet and read again. All but the last return the columns
of documents. Null texts count as empty, extra columns are carried along, and rows that repeat an identifier and a text stay or
go together; an empty table runs through to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm.odd_sketch import near_dedup
from leadsmith.llm.packing import pack
from leadsmith.llm.pseudonyms import pseudonymized
from leadsmith.llm.shared import documents, ship, stored
from leadsmith.llm.stream_dedup import exact_dedup, normalized
from leadsmith.llm.toxicity import non_toxic


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic; labels train, they never decide."""
    ship(spark)
    return non_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    ship(spark)
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.sha2(normalized(docs["text"]), 256) == kept["kept_sha"])
    return docs.join(kept, same, "left_semi")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near copies (five-word shingles, similarity 0.8 or more)."""
    ship(spark)
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by pseudonyms of the same format."""
    ship(spark)
    return pseudonymized(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; one row per piece."""
    ship(spark)
    return pack(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the toxicity model nor the tokenizer. Tests hold toxicity and exact dedup to planted rows, near dedup and
#: PII to losing no row, and packing to its columns; its pieces are held to the tokenizers library by the operator's own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet to the shared folder, and read again as the documents of the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
