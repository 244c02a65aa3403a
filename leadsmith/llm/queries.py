"""Registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm.backoff import backoff_scores
from leadsmith.llm.bpe import digests, encode_decode
from leadsmith.llm.divergence import oracle_sql as quality_sql
from leadsmith.llm.divergence import quality_rules
from leadsmith.llm.language import identify
from leadsmith.llm.lpf import suffix_dedup
from leadsmith.llm.odd_sketch import near_dedup
from leadsmith.llm.packing import pack
from leadsmith.llm.phrases import ORACLE_SQL as PHRASES_SQL
from leadsmith.llm.phrases import collocations
from leadsmith.llm.prefix_trie import ORACLE_SQL as TRIE_SQL
from leadsmith.llm.prefix_trie import prefix_trie
from leadsmith.llm.pseudonyms import pseudonymize
from leadsmith.llm.recompression import repeated_words
from leadsmith.llm.shared import documents
from leadsmith.llm.stream_dedup import exact_dedup
from leadsmith.llm.toxicity import toxicity


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(documents(spark, sf_dir))


def op3_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), keep_ids=False)


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), width=2)


def op5_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir)))


def op6_suffix_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(documents(spark, sf_dir))


def op8_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(documents(spark, sf_dir))
    sha = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", sha, "n_spans")


def op10_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_phrase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_concat_cut_packing": op3_concat_cut_packing,
    "op4_odd_sketch_dedup": op4_odd_sketch_dedup,
    "op5_rank_array_bpe": op5_rank_array_bpe,
    "op6_suffix_lpf_dedup": op6_suffix_lpf_dedup,
    "op7_stupid_backoff": op7_stupid_backoff,
    "op8_stream_dedup": op8_stream_dedup,
    "op9_recompression_dedup": op9_recompression_dedup,
    "op10_toxicity_trees": op10_toxicity_trees,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrase_rollup": op12_phrase_rollup,
    "op13_compression_language": op13_compression_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_divergence": quality_sql(),
    "op7_stupid_backoff": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
            FROM documents
        ),
        p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        g AS (
            SELECT doc_id, i, w,
                   lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v,
                   lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u
            FROM p
        ),
        c1 AS (SELECT doc_id, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY w) AS total FROM g GROUP BY doc_id, w),
        c2 AS (SELECT doc_id, v, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, w) AS total
               FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
        c3 AS (SELECT doc_id, u, v, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v, w) AS total
               FROM g WHERE u IS NOT NULL GROUP BY doc_id, u, v, w),
        n AS (SELECT doc_id, count(*) AS n_words, sum(count(*)) OVER () - count(*) AS others FROM g GROUP BY doc_id),
        s AS (
            SELECT g.doc_id, n.n_words, n.others, least(g.i - 1, 2) AS longest,
                   CASE WHEN c3.total > c3.own THEN 2 WHEN c2.total > c2.own THEN 1 WHEN c1.total > c1.own THEN 0 ELSE -1 END AS used,
                   (c3.total - c3.own) / (b2.total - b2.own) AS s3,
                   (c2.total - c2.own) / (b1.total - b1.own) AS s2,
                   (c1.total - c1.own) / n.others AS s1
            FROM g JOIN n USING (doc_id)
            JOIN c1 ON c1.doc_id = g.doc_id AND c1.w = g.w
            LEFT JOIN c2 ON c2.doc_id = g.doc_id AND c2.v = g.v AND c2.w = g.w
            LEFT JOIN c3 ON c3.doc_id = g.doc_id AND c3.u = g.u AND c3.v = g.v AND c3.w = g.w
            LEFT JOIN c1 b1 ON b1.doc_id = g.doc_id AND b1.w = g.v
            LEFT JOIN c2 b2 ON b2.doc_id = g.doc_id AND b2.v = g.u AND b2.w = g.v
        ),
        l AS (
            SELECT doc_id, n_words, longest, used,
                   CAST(round_even(1000000 * log10(CASE used
                       WHEN 2 THEN power(0.4::DOUBLE, longest - 2) * s3
                       WHEN 1 THEN power(0.4::DOUBLE, longest - 1) * s2
                       WHEN 0 THEN power(0.4::DOUBLE, longest) * s1
                       ELSE power(0.4::DOUBLE, longest + 1) / (others + 1) END), 0) AS BIGINT) AS score
            FROM s
        )
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(score), 0) AS BIGINT) AS log_score,
               CAST(count(*) FILTER (used >= 0 AND used < longest) AS BIGINT) AS n_backed_off,
               CAST(count(*) FILTER (used = -1) AS BIGINT) AS n_unseen,
               CASE WHEN len(d.ws) > 0 THEN round(sum(score) / (1000000.0::DOUBLE * len(d.ws)), 6) END AS mean_log10
        FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, len(d.ws)
    """,
    "op8_stream_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
               text_sha256
        FROM d
    """,
    "op11_prefix_trie": TRIE_SQL,
    "op12_phrase_rollup": PHRASES_SQL,
}
