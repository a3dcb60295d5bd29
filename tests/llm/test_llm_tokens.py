"""Encoding, token counts and packing against the tokenizers library and plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import EDGE, by_id, edge_documents, no_documents
from tokenizers import Tokenizer

from tidymill.llm import bpe, byte_tokens, packing, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), bpe.codec(bpe.read_definition(WORD))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE), byte_tokens.encoder(bpe.read_definition(BYTE))


ALPHABET = "aAbzÉİΣσſßﬀ①½ 中あ한👍🏽́̈‍\u0085\x1c\x1f\t\n'sTLl.,!?#<|>0123٣ｱ　Ω"


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=ALPHABET, max_size=80))
def test_ids_are_those_of_the_library(word, byte, text):
    theirs, own = word
    ids = theirs.encode(text, add_special_tokens=False).ids
    found = np.frombuffer(own.encode(text), "<u4").tolist()
    assert found == ids
    assert own.decode(found) == theirs.decode(ids, skip_special_tokens=False)
    theirs, own = byte
    assert own.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [t for _, t in EDGE if t] + ["ab" * 5000, " " * 25000 + "x", "\n" * 21000, "!" * 999])
def test_ids_of_odd_texts(word, byte, text):
    theirs, own = word
    assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    theirs, own = byte
    assert own.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def naive_merges(symbols, ranks, made):
    symbols = list(symbols)
    while True:
        found = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [made[rank]]


@settings(max_examples=200, deadline=None)
@given(data=st.data())
def test_tree_gives_leftmost_lowest_merges(data):
    symbols = data.draw(st.lists(st.integers(0, 3), max_size=33))
    pairs = data.draw(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=8, unique=True))
    made = data.draw(st.lists(st.integers(4, 6), min_size=len(pairs), max_size=len(pairs)))
    ranks = {pair: i for i, pair in enumerate(pairs)}
    want = naive_merges(symbols, ranks, made)
    assert bpe.merge_symbols(symbols, ranks, made) == want
    if len(symbols) > 1 and pairs:
        order = sorted(range(len(pairs)), key=lambda i: pairs[i])
        codes = np.array([pairs[i][0] << 32 | pairs[i][1] for i in order])
        tables = np.array(order), np.array([made[i] for i in order])
        row = np.full((1, 33), -1, np.int64)
        row[0, : len(symbols)] = symbols
        merged = bpe.merge_many(row, codes, tables)[0]
        assert merged[merged >= 0].tolist() == want


def test_round_trip_of_documents(spark, word):
    theirs = word[0]
    want = []
    for doc_id, text in EDGE:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe.round_trip(edge_documents(spark), WORD).drop("n_words")
    assert by_id(got) == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert bpe.round_trip(no_documents(spark), WORD).count() == 0


def test_decoding_what_was_encoded(spark):
    docs = spark.createDataFrame([(1, "Hello  World"), (2, None), (3, "")], "doc_id long, text string")
    texts = by_id(bpe.decode(bpe.encode(docs, WORD), WORD))
    assert texts == [(1, "hello</w> world</w>"), (2, ""), (3, "")]


def test_token_counts(spark, byte):
    lengths = sorted(len(byte[0].encode(t or "", add_special_tokens=False).ids) for _, t in EDGE)
    docs = edge_documents(spark)
    table = token_counts.suffix_table(token_counts.histogram(token_counts.encoded_lengths(docs, BYTE))).cache()
    got = {r["length"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(lengths))
    for limit, row in got.items():
        assert row["n_docs"] == lengths.count(limit)
        assert row["docs_longer"] == sum(n > limit for n in lengths)
        assert row["tokens_longer"] == sum(n for n in lengths if n > limit)
        assert row["tokens_upto"] == sum(n for n in lengths if n <= limit)
        assert row["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert row["quantile"] == sum(n <= limit for n in lengths) / len(lengths)
    limits = [0, 3, 1000, 10**6]
    for row in token_counts.at_limits(table, limits).collect():
        assert row["truncated_total"] == sum(min(n, row["limit"]) for n in lengths)
    halves = {r["share"]: r["length"] for r in token_counts.quantiles(table, [0.5, 1.0]).collect()}
    assert halves == {0.5: lengths[(len(lengths) - 1) // 2], 1.0: lengths[-1]}
    empty = token_counts.histogram(token_counts.encoded_lengths(no_documents(spark), BYTE))
    assert token_counts.suffix_table(empty).count() == 0


def test_suffix_sums_over_many_blocks(spark):
    rows = [(k, 1 + k % 3) for k in [0, 1, 1023, 1024, 1025, 5000, 1 << 20, (1 << 20) + 1, 3 << 20]]
    got = token_counts.suffix_table(spark.createDataFrame(rows, "length long, n_docs long")).collect()
    for r in got:
        assert r["docs_longer"] == sum(n for k, n in rows if k > r["length"])
        assert r["tokens_longer"] == sum(k * n for k, n in rows if k > r["length"])


def naive_best_fit(lengths, window):
    free, at = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w, room in enumerate(free) if room >= lengths[i]]
        if fits:
            chosen = min(fits, key=lambda w: free[w])
        else:
            free.append(window)
            chosen = len(free) - 1
        at[i] = window - free[chosen]
        free[chosen] -= lengths[i]
    return sorted(free), at


@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    windows, offsets = packing.best_fit_decreasing(np.array(lengths, int), 16)
    used = {}
    for w, o, n in sorted(zip(windows.tolist(), offsets.tolist(), lengths)):
        assert used.get(w, 0) == o
        used[w] = o + n
    assert sorted(16 - u for u in used.values()) == naive_best_fit(lengths, 16)[0]


def check_packing(rows, documents, byte, window=1024):
    """Every id in one piece; sequences without gaps and not too long."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, texts in documents.items():
        ids = [np.append(byte[1].encode(t), 0).astype("<u4") for t in texts]
        assert len({len(i) for i in ids}) == 1
        own = sorted(pieces.pop(doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, ids))
        for r in own:
            part = ids[0][r["start"] : r["start"] + r["length"]]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert r["doc_tokens"] == len(ids[0])
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def test_packing_documents(spark, byte):
    documents = {}
    for doc_id, text in EDGE:
        documents.setdefault(doc_id, []).append(text)
    rows = packing.pack(edge_documents(spark), BYTE, group_pieces=20).collect()
    check_packing(rows, documents, byte)
    assert packing.pack(no_documents(spark), BYTE).count() == 0
    with_ids = packing.pack(edge_documents(spark), BYTE, with_ids=True).where("doc_id = 7").first()
    assert with_ids["ids"] == [*byte[1].encode("The cat sat on the mat.").tolist(), 0]


def test_little_padding(spark, folder):
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), BYTE).collect()
    tokens, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert sequences - 1 <= tokens / 1024 * 1.02 + 1
