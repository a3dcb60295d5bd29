"""SentencePiece encoding and decoding of whole documents: merge-type models by backtracking.

The merge procedure joins the adjacent pair whose joined text is the best piece, the leftmost among
equals, until no pair makes a piece. Its result is also the only sequence of pieces in which every
two neighbours are compatible: merging their joined text gives just these two back. For in the whole
text and in the text of two neighbours alone the same merges happen in the same order until one of
them crosses a border, so a border falls in the one if and only if it falls in the other.

So a text is read from the left, with the longest piece at each place first (Aho-Corasick over the
reversed text gives them all in one pass), then its shorter prefixes. A piece is taken if it is
compatible with the one before. If none is, the place is marked in a bitfield as failed and the
last piece is taken back; as the pieces up to a place are unique, no place is tried again.

A text is cut where no piece reaches across (before a space mark, around characters that no piece
holds), and the ids of short cuts are remembered. Short cuts not yet known are read side by side, each
a row of numpy arrays that goes the same steps; the longest pieces at all their places come from walking
a trie from all places at once. Long cuts are read one by one. The model file is read by the driver and
its bytes (a fixed size) go with the task. Documents are mapped in place, without a shuffle.

Whether two pieces are compatible is told by taking their last merges back, the latest first: neither
may have been left waiting by a better pair across the border. This needs pieces that are merged from
better ones and have a score of their own; for any others the merge procedure itself is run.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import math
import re
from array import array
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import map_texts

SPACE = "▁"
CACHED_CHUNKS = 250_000  # cuts of text whose ids a worker remembers; it starts anew beyond
LONGEST_CACHED = 48
CACHED_PAIRS = 1_000_000
CUTS_AT_ONCE = 1 << 18  # cuts looked up together
ROWS_AT_ONCE = 1 << 15  # short cuts read side by side
LONGEST_LISTED = 4096  # characters of a text whose matches are listed at once
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # kinds of piece in the model file


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tidymill_one_byte", _one_byte)


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a short text by the merge procedure itself."""
    symbols = list(text)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


class _Trie:
    """Steps of a trie of whole numbers for many places at once: a hash table of (node, code)."""

    def __init__(self, words: dict[tuple[int, ...], int], codes: int):
        children: dict[int, int] = {}
        self.word = [-1]  # the word that ends at a node
        for word, number in words.items():
            node = 0
            for code in word:
                key = node * codes + code
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(self.word)
                    self.word.append(-1)
            self.word[node] = number
        self.word, self.codes = np.array(self.word), codes
        self.bits = max(4, (4 * len(children)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys, nodes = (np.fromiter(part, np.int64, len(children)) for part in (children.keys(), children.values()))
        slots = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            free = free[np.unique(slots[free], return_index=True)[1]]  # one key a slot, the others go on
            self.keys[slots[free]], self.nodes[slots[free]] = keys[free], nodes[free]
            keys, nodes, slots = (np.delete(part, free) for part in (keys, nodes, slots))
            slots = (slots + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes, 0 for none."""
        keys = nodes * self.codes + codes
        slots = self._slot(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.nodes[slots], 0)
        late = np.flatnonzero((held != keys) & (held >= 0))
        while len(late):
            slots[late] = (slots[late] + 1) & (1 << self.bits) - 1
            held = self.keys[slots[late]]
            same = held == keys[late]
            found[late[same]] = self.nodes[slots[late[same]]]
            late = late[~same & (held >= 0)]
        return found

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """The longest word that starts at each place, -1 for none."""
        best = np.full(len(codes), -1)
        at, nodes, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            nodes = self.step(nodes, codes[at + depth])
            at, nodes = at[nodes > 0], nodes[nodes > 0]
            word = self.word[nodes]
            best[at[word >= 0]] = word[word >= 0]
            depth += 1
            inside = at + depth < len(codes)
            if not inside.all():
                at, nodes = at[inside], nodes[inside]
        return best


class Codec:
    """Encoder and decoder of one model of the merge type with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        plain = normalizer.name == "identity" and not normalizer.precompiled_charsmap
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a model of the merge type with byte fallback is needed")
        if not plain or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("a model that takes texts as they are is needed")
        kinds = [p.type for p in proto.pieces]
        if {*kinds} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("pieces defined by users are not supported")
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, kinds)) if kind == _NORMAL}
        self.byte_ids = [self.names.index(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.kinds = kinds
        self.controls = {i for i, kind in enumerate(kinds) if kind == _CONTROL}
        self.table = [
            (trainer.unk_surface if kind == _UNKNOWN else name.replace(SPACE, " ")).encode()
            for name, kind in zip(self.names, kinds)
        ]
        for b, i in enumerate(self.byte_ids):
            self.table[i] = bytes([b])
        self.lengths = [len(n) for n in self.names]
        self.shorter = [next((self.ids[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in self.ids), -1)
                        for n in self.names]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, i in self.ids.items():
            self.automaton.add_word(name[::-1], i)
        self.automaton.make_automaton()
        self.characters = held = {c for name in self.ids for c in name}
        if any(c not in self.ids for c in held):
            raise ValueError("every character of a piece must be a piece")
        across = any(b == SPACE != a for name in self.ids for a, b in zip(name, name[1:]))
        loose = re.escape("".join(c for c in "\n\t\r\x0b\x0c" if c not in held))
        self.cuts = re.compile(".+" if across or not loose else f"{SPACE}+[^{SPACE}{loose}]*|[{loose}]|[^{SPACE}{loose}]+", re.S)
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        counts = Counter(score for name, score in self.scores.items() if len(name) > 1)
        self.tied = {score for score, count in counts.items() if count > 1}
        numbers = {c: i + 1 for i, c in enumerate(sorted(held))}  # 0: a character that no piece holds
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in numbers]] = [*numbers.values()]
        self.trie = _Trie({tuple(numbers[c] for c in n): i for n, i in self.ids.items()}, len(numbers) + 1)
        self.length_of, self.shorter_of = np.array(self.lengths), np.array(self.shorter)
        self.is_control = np.array([kind == _CONTROL for kind in kinds])
        self.bytes_of = pa.array(self.table, pa.large_binary())

    def last_merge(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that are merged last into this one; None if merging its text does not end so, if
        one of the two is no better than the whole, or if other pieces are as good."""
        if piece not in self.halves:
            name, scores, found = self.names[piece], self.scores, None
            symbols = list(name)
            while len(symbols) > 2:
                both = [scores.get(a + b, -math.inf) for a, b in zip(symbols, symbols[1:])]
                at = both.index(max(both))
                if both[at] == -math.inf:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 2 and scores[name] not in self.tied and all(len(x) == 1 or scores[x] > scores[name] for x in symbols):
                found = self.ids[symbols[0]], self.ids[symbols[1]]
            self.halves[piece] = found
        return self.halves[piece]

    def unmerged(self, left: int, right: int) -> bool | None:
        """``compatible`` by taking merges back; None where that does not tell."""
        names, scores, lengths = self.names, self.scores, self.lengths
        limit, first = -math.inf, False  # a pair across the border must not be better, or as good if ``first``
        while True:
            across = scores.get(names[left] + names[right], -math.inf)
            if across > limit or (first and across == limit):
                return False
            of_left = scores[names[left]] if lengths[left] > 1 else math.inf
            of_right = scores[names[right]] if lengths[right] > 1 else math.inf
            if of_left == of_right == math.inf:
                return True
            in_left = of_left < of_right  # the later merge; of two alike the right one
            halves = self.last_merge(left if in_left else right)
            if halves is None:
                return None
            limit, first = min(of_left, of_right), not in_left
            left, right = (halves[1], right) if in_left else (left, halves[0])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two; ``left`` -1: the piece alone."""
        found = self.unmerged(left, right) if left >= 0 and self.whole(left) and self.whole(right) else None
        if found is None:
            pair = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            found = merge("".join(pair), self.scores) == pair
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = found
        return found

    def longest(self, text: str):
        """The longest piece that starts with the last, the last but one, ... character of the text."""
        found = self.automaton.iter(text[::-1])  # the longest comes first at each place
        if len(text) <= LONGEST_LISTED:
            return dict([*found][::-1])
        pieces = array("i", bytes(4 * len(text)))
        for place, piece in found:
            if not pieces[place]:
                pieces[place] = piece
        return pieces

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of characters that all are pieces. Places are counted from the end of the text."""
        lengths, shorter, pairs, longest = self.lengths, self.shorter, self.pairs, self.longest(text)
        left = len(text)
        failed = bytearray(left // 8 + 1)
        ids: list[int] = []
        last, piece = -1, longest[left - 1]
        while left:
            after = left - lengths[piece]
            fits = not failed[after >> 3] >> (after & 7) & 1
            if fits:
                fits = pairs.get(last << 32 | piece)
                if fits is None:
                    fits = self.compatible(last, piece)
            if fits:
                ids.append(piece)
                left, last = after, piece
                if left:
                    piece = longest[left - 1]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                failed[left >> 3] |= 1 << (left & 7)
                piece = ids.pop()
                left += lengths[piece]
                last = ids[-1] if ids else -1
        return ids

    def whole(self, piece: int) -> bool:
        """Whether merging the text of a piece is known to give the piece by merges of better ones."""
        return self.lengths[piece] == 1 or self.last_merge(piece) is not None

    def cut_ids(self, text: str) -> bytes:
        """Ids of one cut; characters that are no piece become the pieces of their bytes."""
        own = self.characters
        if own.issuperset(text):
            return np.array(self.backtrack(text), "<u4").tobytes()
        ids, start = [], 0
        for i, c in enumerate(text):
            if c not in own:
                if start < i:
                    ids += self.backtrack(text[start:i])
                ids += [self.byte_ids[b] for b in c.encode()]
                start = i + 1
        if start < len(text):
            ids += self.backtrack(text[start:])
        return np.array(ids, "<u4").tobytes()

    def read_rows(self, cuts: list[str]) -> list[bytes]:
        """``cut_ids`` of short cuts, side by side: one row each of the piece to try, the pieces taken, and
        the places that failed as bits of a number."""
        pairs, trie, length_of, shorter_of = self.pairs, self.trie, self.length_of, self.shorter_of
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\0".join([*cuts, ""]).encode("utf-32-le"), "<u4")
        codes = self.numbers[points].astype(np.int64)
        codes[starts + sizes] = 0  # between the cuts
        # every cut has one place without a number behind it, others more
        holders, counts = np.unique(np.searchsorted(starts, np.flatnonzero(codes == 0), "right") - 1, return_counts=True)
        odd = holders[counts > 1]
        longest = trie.longest(codes)
        rows = len(cuts)
        taken = np.zeros((rows, int(sizes.max())), "<u4")
        n_taken, used, failed = (np.zeros(rows, np.int64) for _ in range(3))
        last, piece = np.full(rows, -1), longest[starts]
        live = np.setdiff1d(np.arange(rows), odd, assume_unique=True)
        while len(live):
            p, here = piece[live], used[live]
            after = here + length_of[p]
            keys = (last[live] << 32 | p).tolist()
            fits = list(map(pairs.get, keys))
            if None in fits:
                new = {key: self.compatible(key >> 32, key & 0xFFFFFFFF) for key in {
                    key for key, fit in zip(keys, fits) if fit is None}}
                fits = [new[key] if fit is None else fit for key, fit in zip(keys, fits)]
            fits = np.array(fits, bool) & (failed[live] >> after & 1 == 0)
            rows_on, p_on, after_on = live[fits], p[fits], after[fits]
            taken[rows_on, n_taken[rows_on]] = p_on
            n_taken[rows_on] += 1
            used[rows_on], last[rows_on] = after_on, p_on
            piece[rows_on] = longest[starts[rows_on] + after_on]
            rest, lesser = live[~fits], shorter_of[p[~fits]]
            piece[rest] = lesser
            back = rest[lesser < 0]
            if len(back):
                failed[back] |= 1 << used[back]
                n_taken[back] -= 1
                piece[back] = taken[back, n_taken[back]]
                used[back] -= length_of[piece[back]]
                last[back] = np.where(n_taken[back] > 0, taken[back, n_taken[back] - 1].astype(np.int64), -1)
            live = live[used[live] < sizes[live]]
        n_taken[odd] = 0
        joined = taken[np.arange(taken.shape[1]) < n_taken[:, None]].tobytes()
        ends = (4 * np.cumsum(n_taken)).tolist()
        found = [joined[a:b] for a, b in zip([0, *ends], ends)]
        for i in odd.tolist():
            found[i] = self.cut_ids(cuts[i])
        return found

    def ids_of(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut; those of short ones are remembered."""
        cache = self.cache
        new = {*cuts}.difference(cache)
        if not new:
            return [*map(cache.__getitem__, cuts)]
        if len(cache) + len(new) > CACHED_CHUNKS:
            cache.clear()
            new = {*cuts}
        short = [cut for cut in new if len(cut) <= LONGEST_CACHED]
        for start in range(0, len(short), ROWS_AT_ONCE):
            rows = short[start : start + ROWS_AT_ONCE]
            cache.update(zip(rows, self.read_rows(rows)))
        if len(short) == len(new):
            return [*map(cache.__getitem__, cuts)]
        long = {cut: self.cut_ids(cut) for cut in new if len(cut) > LONGEST_CACHED}
        return [cache[cut] if len(cut) <= LONGEST_CACHED else long[cut] for cut in cuts]

    def encode_all(self, texts: list[str | None], begin: bool = False, end: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        cuts, ends = [], []
        for text in texts:
            if text:
                cuts += self.cuts.findall(self.prefix + text.replace(" ", SPACE))
            ends.append(len(cuts))
        parts = []
        for start in range(0, len(cuts), CUTS_AT_ONCE):
            parts += self.ids_of(cuts[start : start + CUTS_AT_ONCE])
        head, tail = (i.to_bytes(4, "little") if wanted else b"" for i, wanted in ((self.begin, begin), (self.end, end)))
        return [b"".join([head, *parts[a:b], tail]) for a, b in zip([0, *ends], ends)]

    def encode(self, text: str | None, begin: bool = False, end: bool = False) -> bytes:
        """Ids of one text."""
        return self.encode_all([text], begin, end)[0]

    def decode(self, ids) -> str:
        """The text of any ids. Runs of byte pieces are read as UTF-8, each wrong byte as U+FFFD; the
        space mark that stands for the start of the text is left out."""
        ids = np.asarray(ids, np.int64)
        controls = self.is_control[ids]
        texts, start = [], 0
        for stop in [*np.flatnonzero(controls).tolist(), len(ids)]:  # a run of bytes ends at a control id
            if stop > start:
                names = self.bytes_of.take(pa.array(ids[start:stop]))
                texts.append(names.buffers()[2].to_pybytes().decode("utf-8", "tidymill_one_byte"))
            start = stop + 1
        text = "".join(texts)
        first = int(ids[controls.argmin()]) if not controls.all() else -1
        marked = self.prefix and first >= 0 and self.kinds[first] == _NORMAL and self.names[first][0] == SPACE
        return text[1:] if marked else text


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One per worker process and model, so that its caches outlive a task."""
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """``(doc_id, ids array<long>)`` of every whole text; null and empty texts have the begin and end
    ids only.

    One row per row read: repeated rows are encoded alike, a null ``doc_id`` stays null, an empty table
    gives an empty one. Other columns of ``docs`` are not read.
    """
    model = read_model(path)

    def make():
        coder = codec(model)

        def step(ids, texts):
            encoded = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in coder.encode_all(texts, begin, end)]
            return {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(encoded, pa.list_(pa.int64()))}

        return step

    return map_texts(docs, "doc_id long, ids array<long>", make)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give null, no ids an empty text."""
    model = read_model(path)

    def run(batches):
        coder = codec(model)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """Encode and decode every whole text and keep digests of both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256, same_text``, one row per row read; the last
    tells whether decoding gives the text back (it does not if the text holds the space mark itself).
    """
    model = read_model(path)

    def make():
        coder = codec(model)

        def step(ids, texts):
            counts, raw_digests, text_digests, same = [], [], [], []
            for text, raw in zip(texts, coder.encode_all(texts, begin, end)):
                decoded = coder.decode(np.frombuffer(raw, "<u4"))
                counts.append(len(raw) // 4)
                raw_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == (text or ""))
            return {
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(raw_digests, pa.string()),
                "decoded_sha256": pa.array(text_digests, pa.string()), "same_text": pa.array(same, pa.bool_()),
            }

        return step

    return map_texts(
        docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean", make
    )
