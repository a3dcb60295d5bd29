"""Classifiers by held-out accuracy and by what they must not look at; the pipeline against its parts."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGE, edge_documents, no_documents, prose
from test_llm_pairs import jaccard_components
from test_llm_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from tidymill.llm import bpe, byte_tokens, langid, toxicity

SMALL = toxicity.Settings(steps=60, word_buckets=1 << 12, piece_buckets=1 << 13)


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.fixture(scope="module")
def abusive(spark):
    """Documents of which a third holds insults, some with endings that occur once."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for doc_id in range(420):
        words = prose(rng, int(rng.integers(1, 200)))
        words = [f"{chr(97 + int(w[1:]) % 26)}{chr(97 + int(w[1:]) // 26)}en" for w in words]
        toxic = int(doc_id % 3 == 0)
        for _ in range(toxic * 2):
            words.insert(int(rng.integers(len(words) + 1)), "zwurp" + prose(rng, 1)[0].replace("w", "q"))
        rows.append((doc_id, " ".join(words), "xx" if toxic else "yy", "s", 0))
        labels.append((doc_id, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_told_on_held_out_rows(spark, abusive):
    docs, labels = abusive
    network = toxicity.train(docs, labels, SMALL)
    rows = toxicity.score(docs, network).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    # Labels of held-out rows change nothing, and so do the other columns.
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    bare = docs.selectExpr("doc_id", "text", "'zz' AS lang")
    again = toxicity.score(bare, toxicity.train(bare, flipped, SMALL)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in again) == sorted((r["doc_id"], r["score"]) for r in rows)


def test_windows_cover_long_texts(abusive):
    docs, labels = abusive
    network = toxicity.train(docs, labels, SMALL)
    clean = "aben cden " * 3000
    base = network.scores([clean])[0]
    for at in (0, 100, 2999):
        words = clean.split()
        words.insert(2 * at, "zwurpq1")
        assert network.scores([" ".join(words)])[0] > base
    assert np.isfinite(network.scores([None, "", "...", clean])).all()


def test_window_scores_do_not_depend_on_the_batch(abusive):
    docs, labels = abusive
    network = toxicity.train(docs, labels, SMALL)
    texts = [r["text"] for r in docs.limit(30).collect()] + [None, "", "zwurpq5"]
    together = network.scores(texts)
    assert np.allclose(together, [network.scores([t])[0] for t in texts], atol=1e-5)


def test_gradients():
    """Backpropagation against differences of the loss."""
    settings = toxicity.Settings(hidden=3, attention=3, word_buckets=16, piece_buckets=16, word_dim=2, piece_dim=2)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._parameters(settings, rng).items()}
    net = toxicity.Network(settings, np.zeros(16), np.zeros(16), p)
    lengths, target = np.array([5, 3, 1]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(3, 5, p["fW"].shape[0]))

    def loss():
        gates = np.concatenate([x @ p["fW"] + p["fb"], x @ p["bW"] + p["bb"]], axis=2)
        z = net.window_logits(gates, lengths)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    g, _ = toxicity._gradients(net, x, lengths, target)
    for name in g:
        flat = p[name].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3, name


def test_toxicity_of_odd_texts(spark, abusive):
    network = toxicity.train(*abusive, SMALL)
    rows = toxicity.score(edge_documents(spark), network).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_documents(spark), network).count() == 0
    assert toxicity.train(abusive[0], abusive[1].limit(0), SMALL) is None
    assert {r["score"] for r in toxicity.score(edge_documents(spark), None).collect()} == {0.0}
    kept = toxicity.keep_clean(edge_documents(spark), network)
    assert kept.columns == edge_documents(spark).columns and kept.count() <= len(EDGE)


def test_languages_are_told_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    other = docs.selectExpr(
        "doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 'qq', lang) AS lang", "'zz' AS source"
    )
    again = langid.identify(docs, langid.train(other)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_languages_of_odd_texts(spark, folder):
    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = {r["doc_id"]: r for r in langid.identify(edge_documents(spark), model).collect()}
    for doc_id, text in EDGE:
        letters = any(map(str.isalpha, text or ""))
        assert (rows[doc_id]["lang_pred"] == "und") == (not letters)
        assert rows[doc_id]["lang_pred"] in {"und", *model.languages} and 0 <= rows[doc_id]["score"] <= 1
    none = langid.train(edge_documents(spark).selectExpr("doc_id", "text", "CAST(null AS string) AS lang"))
    assert {r["lang_pred"] for r in langid.identify(edge_documents(spark), none).collect()} == {"und"}
    assert langid.identify(no_documents(spark), model).count() == 0


def test_pipeline_against_its_parts(spark, folder, tmp_path):
    """Each stage's rows follow from the operator's decision on each document by itself."""
    os.symlink(f"{folder}/labels.parquet", tmp_path / "labels.parquet")
    source = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame(
        [(900_001 + k, t, None, "s", 0) for k, (_, t) in enumerate(EDGE)], source.schema
    )
    source.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "ngram_join", "packing"]
    tables, current = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        before, current = current, spark.read.parquet(str(tmp_path / f"out{k}"))
        tables[name] = (before, current)
        if name != "packing":
            assert current.columns == docs.columns
    rows = {n: ({r["doc_id"]: r["text"] for r in b.collect()}, {r["doc_id"] for r in a.select("doc_id").collect()})
            for n, (b, a) in tables.items() if n != "packing"}
    network = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    before, after = rows["toxicity"]
    assert after == {i for i, t in before.items() if network.scores([t])[0] < 0.3}
    before, after = rows["language_id"]
    model = langid.train(tables["language_id"][0])
    named = {i: model.predict([t]) for i, t in before.items()}
    assert after == {i for i, (n, s) in named.items() if n[0] != "und" and s[0] >= model.limit}
    before, after = rows["ngram_join"]
    assert after == {i for i, (_, c) in jaccard_components(before).items() if i == c}
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = (Tokenizer.from_file(path), byte_tokens.encoder(bpe.read_definition(path)))
    texts = {i: [before[i]] for i in after}
    check_packing(tables["packing"][1].collect(), texts, coder)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == tables["packing"][1].count()
