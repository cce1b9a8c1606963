"""The queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataform.llm import bpe, chat, exact_dedup, flac, language_id, mixing, near_dedup, ngram, token_counts, token_store
from strataform.llm.common import prepare, work_dir, written
from strataform.session import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return stored(spark, sf_dir, name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-store")
    shards = token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read(spark, folder, shards)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"), keep="largest")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label_groups(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.label_languages(documents, language_id.fit(documents))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = flac.with_pcm(flac.with_media(table(spark, sf_dir, "documents")), carry=("n_bytes",))
    return flac.describe(written(pcm, "pcm", compression="zstd"))  # streams stored beside it would take over twice the input


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeat=3, seed=42)
    return labelled.select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ngram.score(documents, ngram.train(documents))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_chat_perspectives,
        op3_exact_dedup,
        op4_near_dedup,
        op5_byte_bpe,
        op6_token_counts,
        op7_language_id,
        op8_flac_media,
        op9_mix_sources,
        op10_ngram_scores,
    )
}

ORACLE_SQL = {
    "op2_chat_perspectives": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, 'unknown')), md5(coalesce(text, ''))) - 1 AS nth
            FROM conversations
        ), speakers AS (
            SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
        ), views AS (
            SELECT t.*, perspective,
                   CASE WHEN role = 'system' THEN '<|system|>
' WHEN role = perspective THEN '<|assistant|>
'
                        ELSE '<|user name=' || replace(replace(replace(replace(role, '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') || '|>
' END AS head
            FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
        ), sized AS (
            SELECT *, head || text || '<|end|>
' AS segment,
                   CAST(sum(length(head || text || '<|end|>
')) OVER (PARTITION BY conv_id, perspective ORDER BY nth) AS BIGINT) AS seg_end
            FROM views
        )
        SELECT conv_id, perspective, turn, nth,
               CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS speaks_as,
               segment, seg_end - length(segment) AS seg_start, seg_end,
               CASE WHEN role = perspective AND role <> 'system' THEN seg_end - length(segment) + length(head) END AS mask_start,
               CASE WHEN role = perspective AND role <> 'system' THEN seg_end - 1 END AS mask_end
        FROM sized
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_mix_sources": """
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
                   row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth
            FROM documents
        ), sizes AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
            FROM docs GROUP BY source
        ), weighed AS (
            SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight, source_size * 3 AS cap, (source_size * 3) / CAST(1 + rank % 3 AS DOUBLE) AS level FROM sizes
        ), steps AS (
            SELECT (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share,
                   cap, weight, row_number() OVER (ORDER BY level, rank) AS step
            FROM weighed WINDOW before AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), chosen AS (
            SELECT coalesce((SELECT share FROM steps WHERE cap > weight * share ORDER BY step LIMIT 1), 0) AS share
        ), targets AS (
            SELECT source, source_size, CASE WHEN cap <= weight * share THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target FROM weighed, chosen
        ), rates AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || CASE WHEN nth > 0 THEN ':' || nth ELSE '' END), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
            FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rates
    """,
}
