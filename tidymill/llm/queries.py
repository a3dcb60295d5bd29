"""One query per operator, over the whole table it is meant for, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, embedding_dedup, langid, licenses, ngram_join, packing, pieces, prefix_trie, quality_rules, structure_repair,
    token_counts, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lengths = token_counts.encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.suffix_table(token_counts.written_histogram(lengths))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs))


@query("op4_ngram_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query("op9_embedding_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op3_license_scan", licenses.detection_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.detect(table(spark, folder, "documents")).drop("detections")


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, folder, "labels")))


@query("op2_warc", warc.derivatives_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, folder, "pages")))
    return records.withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256)).drop("block", "record")


@query("op12_prefix_trie", prefix_trie.trie_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op13_structure_repair", structure_repair.repair_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return structure_repair.damage_and_repair(table(spark, folder, "conversations"))
