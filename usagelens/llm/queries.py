"""The registered queries of this subpackage, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import (alignment, ann, exact_dedup, fill_middle, licenses, main_text, mixing, pieces, quality, simhash, sql, token_files,
                           toxicity, url_filter)
from usagelens.session import scratch_path

#: Fixed by contract: (host, path, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> str:
    """The public vocabulary the contract names; its package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, folder, "documents"), piece_model()))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(pa.table(dict(zip(("host", "path", "verdict"), zip(*URL_RULES)))))
    return url_filter.judge(table(spark, folder, "pages"), rules)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), byte_model(), piece_model())


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    token_files.write(table(spark, folder, "documents"), byte_model(), path)
    return token_files.digests(spark, path)


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(fill_middle.pieces(table(spark, folder, "documents")))


_OPERATORS = (op1_licenses, op2_pieces, op3_exact_dedup, op4_url_filter, op5_toxicity, op6_quality, op7_simhash, op8_mixing, op9_main_text,
              op10_nearest, op11_alignment, op12_token_files, op13_fill_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
