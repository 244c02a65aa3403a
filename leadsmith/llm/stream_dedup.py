"""Exact deduplication as a stateful stream.

Texts are equal when identical after dropping ASCII white space. Every row becomes a slim fingerprint row (digest, stable
identifier, length, locator) in the shared folder; a stream over that folder folds it into keyed state in RocksDB, on the
executors' disks with its changelog in the checkpoint. No watermark is set, so state never expires and a later run with
the same folder goes on where the last one ended. Partial aggregation ahead of the shuffle reduces a hot digest to one
row a task. Digests with several rows are then checked on their full bytes against the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm.shared import SPACE, release, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
}
FINGERPRINT = "doc_id bigint, text_sha256 string, n_chars bigint, locator string"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest(sha: str, bits: int) -> Column:
    return F.substring(sha, 1, bits // 4)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per document."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.sha2(normalized(F.col(text_col)), 256).alias("text_sha256"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_chars"),
        F.input_file_name().alias("locator"),
    )


def fold_stream(spark: SparkSession, folder: str, digest_bits: int = 256) -> DataFrame:
    """Fold all fingerprint files of ``folder``/rows that no earlier run has read into the state, and return the state.

    One row per digest: digest, keep_id, keep_locator, group_size. The longest original text stays, then the smallest
    identifier (null identifiers last).
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "locator"))
        query = (
            spark.readStream.schema(FINGERPRINT)
            .parquet(f"{folder}/rows")
            .groupBy(digest("text_sha256", digest_bits).alias("digest"))
            .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(f"{folder}/state")
    best_at, size_at = state.schema["value"].dataType.fieldNames()
    kept = state.schema["value"].dataType[best_at].dataType.fieldNames()
    value = F.col("value")
    return state.select(
        F.col("key")[state.schema["key"].dataType.fieldNames()[0]].alias("digest"),
        value[best_at][kept[2]].alias("keep_id"),
        value[best_at][kept[3]].alias("keep_locator"),
        value[size_at].alias("group_size"),
    )


def _collision(docs: DataFrame, state: DataFrame, folder: str, id_col: str, text_col: str, digest_bits: int) -> bool:
    """Whether a row that hit a digest differs in its full bytes from the row that stays.

    Only rows of digests with several rows reach the table of hits; the comparison is a join, so that a hot digest can
    be split, and each digest has one text on its other side.
    """
    body = normalized(F.col(text_col))
    rows = docs.select(
        F.sha2(body, 256).alias("sha"), body.alias("body"), F.col(id_col).cast("bigint").alias("doc_id")
    ).withColumn("digest", digest("sha", digest_bits))
    hits = state.where("group_size > 1").select("digest", "keep_id")
    rows.join(hits, "digest").write.option("compression", "zstd").parquet(f"{folder}/hits")
    rows = docs.sparkSession.read.parquet(f"{folder}/hits")
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("keep_body"))
    return not rows.join(stays, "digest").where("body != keep_body").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    A null text counts as empty, and all empty texts are equal. A null identifier sorts last. Rows repeated with the same
    identifier and text count in group_size each; ``kept`` marks them all if their identifier stays (a caller that needs
    one row drops repeated rows first). An empty table gives an empty result. Extra columns are never read.
    ``digest_bits`` under 256 keys the state by a shorter digest; should texts then collide, the fold is done again by
    the whole digest.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    fingerprints(docs, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/rows")
    prints = spark.read.schema(FINGERPRINT).parquet(f"{folder}/rows")
    state = fold_stream(spark, folder, digest_bits)
    if _collision(docs, state, folder, id_col, text_col, digest_bits):
        if digest_bits >= 256:
            raise ValueError("different texts share a SHA-256 digest")
        return exact_dedup(docs, id_col, text_col)
    release(spark)
    return prints.withColumn("digest", digest("text_sha256", digest_bits)).join(state, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
