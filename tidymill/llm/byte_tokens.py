"""Ids of a public byte-level tokenizer, as packing and token counts need them.

The ids are those of the ``tokenizers`` library for the same JSON definition. ``tiktoken`` computes
them from the definition's own vocabulary, at about a quarter of the processor time; texts that its
pattern engine gives up on go to ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .bpe import byte_characters

# Fixed value: the pattern of the byte-level pre-tokenizer (``use_regex``).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 20_000  # characters without a break between a space and a letter


class Encoder:
    def __init__(self, definition: str):
        import tiktoken

        spec = json.loads(definition)
        of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
        if not plain or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("a byte-level definition without normalizer is needed")
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
        if [vocab[t] for t in merged] != sorted(vocab[t] for t in merged):
            raise ValueError("ids must rise with the rank of the merge")
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items()}
        self.fast = tiktoken.Encoding("definition", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.definition, self._whole = definition, None
        self.special = set(special)

    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.definition)
            self._whole.no_truncation()
            self._whole.no_padding()
        return self._whole

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens in the text
        become those tokens, as the library has it."""
        if not text:
            return np.zeros(0, "<u4")
        if len(text) < LONG_RUN or max(map(len, text.split(" "))) < LONG_RUN and " " * LONG_RUN not in text:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.special), "<u4")
        return np.array(self.whole().encode(text, add_special_tokens=False).ids, "<u4")


@functools.lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)
