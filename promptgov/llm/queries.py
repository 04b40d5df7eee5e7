"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgov.llm import (
    decontaminate, hard_negatives, html_text, line_dedup, pack, quality, secrets, simhash, source_audit, substring_dedup,
    suffix_dedup, token_counts, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(read(spark, sf_dir, "documents"), length=400, keep="none").drop("spans")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), least_bytes=0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.every_line(read(spark, sf_dir, "documents"), edits=2, least=40)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(read(spark, sf_dir, "documents"), length=20).drop("spans")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = pack.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = pack.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), end=2, added=added)
    pieces = pack.pieces(read(spark, sf_dir, "documents"), tokenizer, size=1024)
    return pack.pack(pieces, pack.Capacity(), "norm", "doc_id", "piece")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(read(spark, sf_dir, "documents"), least=3, top=200)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are wrong on purpose: the contract moves those of every seventh id."""
    rows = read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0, scale=256, positives=5, negatives=3)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), path, limit=512)


def queries() -> dict[str, Query]:
    return {
        "op1_main_text": op1,
        "op2_suffix_array_dedup": op2,
        "op3_warc": op3,
        "op4_line_dedup": op4,
        "op5_substring_dedup": op5,
        "op6_best_fit_packing": op6,
        "op7_quality_cascade": op7,
        "op8_wu_manber": op8,
        "op9_secret_ownership": op9,
        "op10_covering_simhash": op10,
        "op11_source_divergence": op11,
        "op12_hard_negatives": op12,
        "op13_token_counts": op13,
    }
