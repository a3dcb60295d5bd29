"""Short cuts of text read side by side give the ids of those read one by one."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidymill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["stndha,", "Éréviai", "enieench", "Äeinpf", "▁▁▁x", "中文", "a\x00b", "\x00", "👍🏽", "é", "<s>", "0xA1", "q" * 40, "ab" * 30]


@pytest.fixture(scope="module")
def coder():
    return pieces.Codec(pieces.read_model(PATH))


def words(coder, n):
    rng, names = np.random.default_rng(7), list(coder.ids)
    return ["".join(names[i] for i in rng.integers(0, len(names), int(rng.integers(1, 5)))) for _ in range(n)]


def test_rows_are_the_cuts_read_alone(coder):
    cuts = [w for w in {*WORDS, *words(coder, 2000)} if len(w) <= pieces.LONGEST_CACHED]
    assert coder.read_rows(cuts) == [coder.cut_ids(cut) for cut in cuts]


def test_merges_taken_back_tell_compatible_pieces(coder):
    rng, ids = np.random.default_rng(3), [i for i in coder.ids.values()]
    told = 0
    alike = [i for i in ids if len(set(coder.names[i])) < 3]  # where merges tie
    pairs = [(a, a) for a in alike] + [(ids[a], ids[b]) for a, b in rng.integers(0, len(ids), (4000, 2))]
    pairs += [(alike[a], alike[b]) for a, b in rng.integers(0, len(alike), (4000, 2))]
    pairs += [(a, b) for a in alike for b in alike if {*coder.names[a], *coder.names[b]} < set("exao")]
    for left, right in pairs:
        found = coder.unmerged(left, right) if coder.whole(left) and coder.whole(right) else None
        pair = [coder.names[left], coder.names[right]]
        if found is not None:
            told += 1
            assert found is (pieces.merge("".join(pair), coder.scores) == pair), pair
    assert told > 3900


def test_texts_together_are_those_of_the_library(coder, monkeypatch):
    """Also when the remembered cuts are dropped on the way, and texts are cut into many lookups."""
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", " ".join(WORDS), "\n".join(WORDS)] + [" ".join(words(coder, 40)) for _ in range(30)]
    want = [theirs.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    for n in (pieces.CUTS_AT_ONCE, 50):
        monkeypatch.setattr(pieces, "CUTS_AT_ONCE", n)
        monkeypatch.setattr(pieces, "CACHED_CHUNKS", n)
        monkeypatch.setattr(pieces, "ROWS_AT_ONCE", 7)
        got = [np.frombuffer(raw, "<u4").tolist() for raw in coder.encode_all(texts, True, True)]
        assert got == want
    assert [coder.decode(ids) for ids in want] == [theirs.decode(ids) for ids in want]


def test_repeated_cuts_are_read_once_and_together(coder, monkeypatch):
    calls, read_rows = [], pieces.Codec.read_rows
    monkeypatch.setattr(pieces.Codec, "read_rows", lambda self, cuts: calls.append(len(cuts)) or read_rows(self, cuts))
    monkeypatch.setattr(coder, "cache", {})
    coder.encode_all(["xin yan xin", "yan xin zor", None])
    coder.encode_all(["zor yan"])
    assert calls == [4 if coder.prefix else 5] or sum(calls) == len(coder.cache)
