"""A corpus from raw documents to token ids: five stages, each a written table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of `documents`. `run` applies them in order. ORACLE_SQL is None:
language machines, fingerprints and byte-pair merges have no SQL; the stages are tested
against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import bytebpe, language, mixing, quality, simhash
from tripweave.llm.common import written
from tripweave.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the trusted ones."""
    return quality.keep_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like a learned language; all, if nothing was learned."""
    labelled = language.learning_part(docs)
    machines = language.fit(labelled)
    return language.keep_known(docs, machines, least_like=language.least_likeness(labelled, machines))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that reach each other by two differing bits."""
    return simhash.keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the words takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of what they decode to."""
    return bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-dedup", near_dedup),
          ("mixing sources", source_mix), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
