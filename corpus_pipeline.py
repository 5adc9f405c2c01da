"""A training-data pipeline: toxicity, near duplicates, secrets, source mix, tokens.

Each stage works on all rows that the one before kept, written as Parquet and
read again. Toxic documents go; of each class of near copies one document
stays; secrets are replaced in the texts; documents are emitted as often as the
mix says; what is left is encoded. All but the last stage return the columns of
``documents``; the last returns each emitted document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, jaccard, mixing, queries, secrets, toxicity
from palimpsest.sources.tables import discard, materialize, table, workspace


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, queries.tokenizer_file())


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: Boosted trees and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole corpus: doc_id, source, n_tokens, ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with workspace(spark) as kept:  # what a stage wrote on its way goes once its result is written
            before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
