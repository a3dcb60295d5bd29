"""Byte-pair encoding and decoding of whole documents, merges found by a segment tree.

A word is a row of symbols. The leaves of the tree hold the rank of each adjacent pair, together
with its place; every inner node holds the smaller of its two children. So the root is the
leftmost pair of lowest rank. Merging it changes three leaves (the merged pair, the pair before
it, the pair that vanished), each put right in a logarithmic number of steps. The word is done
when the root holds no pair.

The vocabulary is the JSON definition of a public tokenizer with word ends: NFC, lower case, white
space dropped, words split by its pattern, bytes as printable characters. The driver reads the
file and ships its text (a fixed size) with the task; executors need no such file. Documents are
mapped in place, without a shuffle, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._arrow import map_texts

CACHED_CHUNKS = 250_000  # chunks of text whose ids a worker remembers; it starts anew beyond
LONGEST_CACHED = 48
LONGEST_TOGETHER = 32  # pairs of a word that is merged together with others
WORDS_TOGETHER = 8192

_SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the pattern does not
_CHUNKS = regex.compile(r"[^\p{White_Space}]+")


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until no pair has a rank.

    ``ranks`` gives the rank of a pair of symbols, ``made`` the symbol that a rank makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    size = 1 << (n - 2).bit_length()
    none = len(made) * n  # above every key
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(leaf: int, key: int) -> None:
        node = size + leaf
        tree[node] = key
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def key(left: int, right: int) -> int:
        rank = ranks.get((symbols[left], symbols[right]))
        return none if rank is None else rank * n + left

    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        rank, at = divmod(tree[1], n)
        gone = following[at]
        symbols[at] = made[rank]
        symbols[gone] = -1
        after, before = following[gone], previous[at]
        following[at] = after
        put(at, key(at, after) if after < n else none)
        if after < n:
            previous[after] = at
        if gone < n - 1:
            put(gone, none)
        if before >= 0:
            put(before, key(before, at))
    return [s for s in symbols if s >= 0]


def merge_many(symbols: np.ndarray, codes: np.ndarray, made: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same for many words at once, one tree a row.

    ``symbols`` has a word a row, padded with -1, and as many columns as one more than a power of
    two; ``codes`` holds the codes ``left << 32 | right`` of the pairs in rising order, ``made`` the
    ranks and the symbols made, in the same order. Returns the symbols left, -1 in the places that vanished.
    """
    words, width = symbols.shape
    size = width - 1
    none = np.int64(1) << 62
    ranks, results = made

    def keys(left, right, place):
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = (codes[at] == code) & (left >= 0) & (right >= 0)
        return np.where(hit, (ranks[at] * width + place), none)

    symbols = np.concatenate([symbols, np.full((words, 1), -1, symbols.dtype)], axis=1)
    tree = np.full((words, 2 * size), none)
    tree[:, size:] = keys(symbols[:, :size], symbols[:, 1 : size + 1], np.arange(size))
    level = size
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    following = np.tile(np.arange(1, width + 2), (words, 1))
    previous = np.tile(np.arange(-1, width), (words, 1))
    result_of = np.zeros(int(ranks.max()) + 1, np.int64)
    result_of[ranks] = results
    row = np.flatnonzero(tree[:, 1] != none)
    while len(row):
        rank, at = np.divmod(tree[row, 1], width)
        gone = following[row, at]
        after, before = np.minimum(following[row, gone], width), previous[row, at]
        symbols[row, at] = result_of[rank]
        symbols[row, gone] = -1
        following[row, at] = after
        previous[row, after] = at
        leaves = np.stack([at, np.minimum(gone, size - 1), np.maximum(before, 0)]) + size
        # A pair that cannot be (nothing before, or the last place gone) puts its leaf's value back.
        tree[row, leaves[0]] = keys(symbols[row, at], symbols[row, after], at)
        tree[row, leaves[1]] = np.where(gone < size, none, tree[row, leaves[1]])
        tree[row, leaves[2]] = np.where(
            before >= 0, keys(symbols[row, np.maximum(before, 0)], symbols[row, at], before), tree[row, leaves[2]]
        )
        while leaves[0, 0] > 1:
            leaves >>= 1
            tree[row, leaves] = np.minimum(tree[row, 2 * leaves], tree[row, 2 * leaves + 1])
        row = row[tree[row, 1] != none]
    return symbols[:, :width]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1,
    else the next free one from U+0100 on (the usual byte-level alphabet)."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, free = [], 256
    for byte in range(256):
        if byte in printable:
            table.append(chr(byte))
        else:
            table.append(chr(free))
            free += 1
    return table


class Codec:
    """Encoder and decoder of one tokenizer definition."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for left, right in pairs:
            self.ranks.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        alphabet = byte_characters()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names[i] for i in range(max(names) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        codes = np.array([left << 32 | right for left, right in self.ranks], np.int64)
        order = np.argsort(codes)
        rank = np.array(list(self.ranks.values()), np.int64)[order]
        self.codes, self.results = codes[order], (rank, np.array(self.made, np.int64)[rank])
        self.bytes_inner, self.bytes_last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.cache: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        return np.array(merge_symbols(symbols, self.ranks, self.made), "<u4").tobytes()

    def words_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word: words of like length together, long ones one by one."""
        raws = [word.encode() for word in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        found = {words[i]: self.word_ids(words[i]) for i in np.flatnonzero(lengths > LONGEST_TOGETHER + 1)}
        size, least = 1, 0
        while size <= LONGEST_TOGETHER:
            chosen = np.flatnonzero((lengths > least) & (lengths <= size + 1))
            least, width = size + 1, size + 1
            for start in range(0, len(chosen), WORDS_TOGETHER):
                part = chosen[start : start + WORDS_TOGETHER]
                data = np.frombuffer(b"".join([raws[i] for i in part]), np.uint8)
                long = lengths[part]
                inside = np.arange(width) < long[:, None]
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[inside] = self.bytes_inner[data]
                ends = (np.arange(len(part)), long - 1)
                symbols[ends] = self.bytes_last[data[np.cumsum(long) - 1]]
                merged = merge_many(symbols, self.codes, self.results)
                alive = merged >= 0
                flat = merged[alive].astype("<u4").tobytes()
                stops = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
                begin = 0
                for i, stop in zip(part.tolist(), stops):
                    found[words[i]] = flat[begin:stop]
                    begin = stop
            size *= 2
        return found

    def _chunks(self, text: str) -> list[str]:
        """Runs without white space of a normalised text; no word crosses white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter where it matters: str.lower() looks at a sigma's neighbours.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return _CHUNKS.findall(text) if _SEPARATORS.search(text) else text.split()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        split = {chunk: self.word.findall(chunk) for chunk in chunks}
        ids = self.words_ids(list({word for words in split.values() for word in words}))
        return {chunk: b"".join([ids[word] for word in words]) for chunk, words in split.items()}

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        rows: list[list] = []
        for text in texts:
            row: list = []
            if text:
                for i, part in enumerate(self.marks.split(text)):
                    row.append(self.special[part].to_bytes(4, "little") if i % 2 else self._chunks(part))
            rows.append(row)
        cache = self.cache
        wanted = {chunk for row in rows for part in row if isinstance(part, list) for chunk in part}
        new = wanted.difference(cache)
        if len(cache) + len(new) > CACHED_CHUNKS:
            cache.clear()
            new = wanted
        learned = self._learn(new)
        kept = {chunk: ids for chunk, ids in learned.items() if len(chunk) <= LONGEST_CACHED}
        cache.update(kept)
        known = cache if len(kept) == len(learned) else cache | learned
        return [
            b"".join([p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in row]) for row in rows
        ]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """Names of the tokens with one space between them: the definition names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(definition: str) -> Codec:
    """One per worker process and definition, so that its cache outlives a task."""
    return Codec(definition)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<long>)`` of every whole text; null and empty texts give an empty array.

    One row per row read: repeated rows are encoded alike, a null ``doc_id`` stays null. Other
    columns of ``docs`` are not read.
    """
    definition = read_definition(path)

    def make():
        coder = codec(definition)

        def step(ids, texts):
            encoded = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in coder.encode_many(texts)]
            return {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(encoded, pa.list_(pa.int64()))}

        return step

    return map_texts(docs, "doc_id long, ids array<long>", make)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give null, no ids an empty text."""
    definition = read_definition(path)

    def run(batches):
        coder = codec(definition)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text and keep digests of both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_words``, one row per row read. Null and
    empty texts have no tokens and the digests of nothing.
    """
    definition = read_definition(path)

    def make():
        coder = codec(definition)

        def step(ids, texts):
            counts, raw_digests, text_digests, words = [], [], [], []
            for raw in coder.encode_many(texts):
                decoded = coder.decode(np.frombuffer(raw, "<u4").tolist())
                counts.append(len(raw) // 4)
                raw_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                words.append(decoded.count(coder.suffix))
            return {
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(raw_digests, pa.string()),
                "decoded_sha256": pa.array(text_digests, pa.string()), "n_words": pa.array(words, pa.int64()),
            }

        return step

    return map_texts(
        docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long", make
    )
