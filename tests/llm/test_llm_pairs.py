"""Similarity joins against all pairs in plain Python."""

import math

import numpy as np
import pytest
from llm_cases import by_id, edge_documents, no_documents, prose

from tidymill.llm import embedding_dedup, ngram_join


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def components(nodes, links):
    name = {n: n for n in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(documents):
    sets = {i: shingles(t) for i, t in documents.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    named = components(sets, links)
    return {i: (len(sets[i]), named[i]) for i in sets}


def near_copies():
    """Copies, chains of near copies, a group in which not all are alike, shared passages, pairs at the limit."""
    rng = np.random.default_rng(3)
    documents, passage = {}, prose(rng, 60)
    for base in range(8):
        words = prose(rng, 120)
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[int(rng.integers(len(changed)))] = f"x{int(rng.integers(10**6))}"
            documents[len(documents)] = " ".join(changed)
            words = changed if base % 2 else words  # a chain, or all from one
        documents[len(documents)] = "\n".join(words).upper()
    for _ in range(30):  # a passage that many share, in texts of their own
        documents[len(documents)] = " ".join(prose(rng, 40, 10**6) + passage + prose(rng, int(rng.integers(5, 60)), 10**6))
    for tail in range(25):  # mostly the passage: many pairs at and around the limit
        documents[len(documents)] = " ".join(passage + prose(rng, tail % 13, 10**6))
    for n in range(1, 9):
        documents[len(documents)] = " ".join(f"s{k}" for k in range(n))
        documents[len(documents)] = " ".join(f"S{k}" for k in range(n))
    order = rng.permutation(len(documents))
    return {int(order[i]) * 3: text for i, text in documents.items()}


@pytest.mark.parametrize("pairs_per_posting", [8, 0])
def test_components_of_near_copies(spark, monkeypatch, pairs_per_posting):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_POSTING", pairs_per_posting)
    documents = near_copies()
    table = spark.createDataFrame([(i, t) for i, t in documents.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(table).collect()}
    assert got == jaccard_components(documents)


def test_blocks_do_not_change_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    documents = near_copies()
    table = spark.createDataFrame([(i, t) for i, t in documents.items()], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(table).collect()}
    assert got == jaccard_components(documents)


def test_odd_documents(spark):
    rows = ngram_join.near_duplicates(edge_documents(spark)).select("doc_id", "n_shingles", "component_id")
    got = by_id(rows)
    assert len(got) == 15 and [r for r in got if r[0] is None] == [(None, 1, None)]
    named = {r[0]: r[1:] for r in got}
    assert named[1] == (0, 1) and named[2] == (0, 2) and named[3] == (0, 3) and named[13] == (0, 13)
    assert named[7] == (2, 7) and named[8] == (2, 7) and got.count((8, 2, 7)) == 2
    kept = ngram_join.keep_one(edge_documents(spark))
    assert kept.columns == edge_documents(spark).columns
    assert by_id(kept.select("doc_id")) == [(None,), *sorted([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13)], key=lambda r: str(r[0]))]


def test_an_id_with_two_texts_links_by_either(spark):
    rng = np.random.default_rng(8)
    one, two = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    rows = [(5, one), (5, two), (6, one + " x"), (7, two + " y"), (8, two + " y"), (9, "other words entirely of its own")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(table).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 9)}


def test_no_documents(spark):
    assert ngram_join.near_duplicates(no_documents(spark)).count() == 0
    assert ngram_join.keep_one(no_documents(spark)).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(12, 16))
        for centre in centres:
            for _ in range(int(rng.integers(1, 9))):
                noise = rng.normal(size=16)
                noise *= np.linalg.norm(centre) / np.linalg.norm(noise) * rng.uniform(0, 0.35)
                rows.append(([float(x) for x in np.float32(centre + noise)], label))
    rows += [(rows[0][0], 1)] * 5 + [(rows[0][0], 2), (rows[0][0], None), ([0.0] * 16, 1), ([0.0] * 16, 1), (None, 1)]
    rows += [([math.nan] + [1.0] * 15, 1)] * 2 + [([math.inf] + [1.0] * 15, 1)] * 2 + [([1.0, None], 1), ([], 1), ([3.0], 1), ([4.0], 1)]
    return [(int(i) * 2, v, label) for i, (v, label) in zip(rng.permutation(len(rows)), rows)]


def cosine_links(rows):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for i, (a, v, k) in enumerate(rows):
        for b, w, m in rows[:i]:
            if k == m and k is not None and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("block", [512, 3])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    found = embedding_dedup.near_duplicates(table, recall=0.9999)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    links = cosine_links(rows)
    named = components([r[0] for r in rows], links)
    want = {r[0]: (sum(r[0] in link for link in links), named[r[0]], named[r[0]] == r[0]) for r in rows}
    assert got == want


def test_embedding_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table).collect()}
    want = cosine_links(rows)
    assert len(got) == len(rows) and 0.9 * 2 * len(want) <= sum(got.values()) <= 2 * len(want)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_vectors_without_an_id_link_and_bridge(spark):
    near = [[1.0, 0.0, 0.0, 0.0], [0.96, 0.28, 0.0, 0.0], [0.8432, 0.5376, 0.0, 0.0]]  # each near the next only
    rows = [(5, near[0], 1), (None, near[1], 1), (7, near[2], 1), (None, [0.0, 0.0, 1.0, 0.0], 2), (None, [0.0, 0.0, 1.0, 0.01], 2),
            (None, [0.0, 1.0, 0.0, 0.0], 3), (None, None, 3), (9, near[0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(str, map(tuple, embedding_dedup.near_duplicates(table, recall=0.99999).collect())))
    want = [(5, 1, 5, True), (None, 2, 5, False), (7, 1, 5, False), (None, 1, None, True), (None, 1, None, True),
            (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(map(str, want))
