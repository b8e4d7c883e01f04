"""From raw documents to training tokens, in five stages.

    toxicity      documents that score as toxic go
    exact dedup   of equal texts the row with the largest id stays
    near dedup    one document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays
    mix           sources are brought to their target weights; documents repeat or go
    tokens        texts become ids, with digests of ids and decoded text

Each stage reads the Parquet files of the one before it, so a lost executor
costs tasks of one stage only. Stages that hand whole texts to Python have the
session's Arrow batches at 1,000 rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import exact_dedup, mixing, near_copies, pieces, queries, toxicity
from usagelens.session import materialise, small_batches


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.clean_documents(docs, queries.table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_copies.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every row (a document that the mix repeats has as many)."""
    small_batches(spark)
    return pieces.digests(pieces.encode(docs, queries.piece_model()), "ids")


STAGES = [("toxicity", toxic_out), ("exact_dedup", copies_out), ("near_dedup", near_copies_out), ("mix", mixed), ("tokens", tokens)]

#: A learned classifier and a tokenizer have no SQL; the tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
