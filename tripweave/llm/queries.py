"""The registered queries of the subpackage on the driver tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tripweave.llm import (
    bytebpe, chat, collocations, contextmix, embedgroups, language, mixing, quality, repair, simhash, tokencount,
    tokenfiles, urlrules)
from tripweave.llm.common import shared_path
from tripweave.sources.tables import read_table


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(
        read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return language.predict_documents(docs, language.fit(language.learning_part(docs)))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, vocabulary = read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    path = shared_path(docs, "tokens")
    tokenfiles.write_tokens(docs, path, lambda: tokenfiles.worker_encoder(vocabulary))
    return tokenfiles.read_tokens(spark, path)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.judge_documents(docs, quality.fit(docs, read_table(spark, folder, "labels")))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge_urls(read_table(spark, folder, "pages"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bytebpe.round_trip(read_table(spark, folder, "documents"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, folder, "documents"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversation_digests(chat.with_probe(read_table(spark, folder, "conversations")))


def op10_embedding_groups(spark: SparkSession, folder: str) -> DataFrame:
    return embedgroups.near_vectors(read_table(spark, folder, "embeddings"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_reports(repair.damaged(read_table(spark, folder, "conversations")), dropped="dropped")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


def op13_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return contextmix.score_documents(docs, contextmix.fit(docs))


QUERIES = {"pipeline": corpus_pipeline.run} | {query.__name__: query for query in (
    op1_token_counts, op2_language_id, op3_token_files, op4_quality_rules, op5_url_filters, op6_byte_bpe,
    op7_source_mix, op8_simhash, op9_chat_format, op10_embedding_groups, op11_conversation_repair,
    op12_collocations, op13_lm_scores)}
ORACLE = {"op5_url_filters": urlrules.sql(), "op7_source_mix": mixing.SQL, "op12_collocations": collocations.SQL}
