"""Rows that share an id or have none."""

import collections

import numpy as np
from llm_cases import prose

from tidymill.llm import ngram_join

SCHEMA = "doc_id long, text string"


def test_ids_with_several_texts_join_their_classes(spark):
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join(prose(rng, 40, 10**6)) for _ in range(4))
    rows = [(5, a), (9, a), (5, b), (3, b), (7, c), (9, c), (8, d), (8, None), (2, d)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(table).where("n_shingles > 0").collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (7, 3), (8, 2), (2, 2)}
    assert sorted(map(tuple, ngram_join.keep_one(table).collect())) == [(2, d), (3, b)]


def test_copies_without_an_id_go(spark):
    rng = np.random.default_rng(6)
    words = prose(rng, 60, 10**6)
    a, b, near = " ".join(words), " ".join(prose(rng, 40, 10**6)), " ".join([*words[:-1], "else"])
    rows = [(4, a), (None, a), (None, near), (None, b), (None, b), (None, None), (None, None), (None, " ")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text"]
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(
        [(4, a), (None, b), (None, None), (None, None), (None, " ")])


def test_rows_without_an_id_link_and_name_nothing(spark):
    rng = np.random.default_rng(8)
    words = prose(rng, 60, 10**6)
    near, far = [*words[:-4], "p", "q", "r", "s"], prose(rng, 30, 10**6)
    further = [*"abcdef", *near[6:]]  # like `near`, unlike `words`
    rows = [(4, " ".join(words)), (None, " ".join(near)), (9, " ".join(further)), (None, " ".join(far)), (None, " ".join(far)),
            (None, None), (None, "two words"), (6, " ".join(far[:7]))]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter([
        (4, 56, 4), (None, 56, 4), (9, 56, 4), (None, 26, None), (None, 26, None), (None, 0, None), (None, 1, None), (6, 3, 6)])
