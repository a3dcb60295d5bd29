"""Pieces of rows that share an id or have none."""

import collections

import public_tokenizers

from tidymill.llm import packing

SCHEMA = "doc_id long, text string"


def test_rows_without_an_id_are_dealt_to_all_groups(spark):
    rows = [(None, "the same text") for _ in range(3000)] + [(1, f"number {i}") for i in range(1000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = packing.pack(table, public_tokenizers.path("byte_bpe_50k.json"), group_pieces=200)
    assert "__number" not in packed.columns
    sizes = collections.Counter(r["sequence_id"] >> 32 for r in packed.collect())
    assert sum(sizes.values()) == 4000 and len(sizes) == 20 and max(sizes.values()) < 400
