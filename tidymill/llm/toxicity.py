"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs. A word is a run of letters, lower-cased. Its word input is an embedding of its hash, its
character input the mean of the embeddings of its hashed character pieces (three to five letters,
with marks at both ends). Each hash also carries a fixed weight of evidence: how much oftener it
stands in toxic training documents than in others, shrunk towards none; a word has its own and the
largest and smallest of its pieces. Pieces let a word that training never saw be judged by its stem.

Network. Two gated recurrent layers read a window of ``window`` words from either side; attention
weighs their states into one vector, and a logistic unit scores it. Windows overlap by
``window - stride`` words and cover the whole text; a document scores as its highest window does,
put on the scale of probabilities by a logistic fit.

Training runs on the driver over a bounded sample: about ``sample_each`` labelled documents of each
class, of each one slice of at most ``slice_chars`` characters. The evidence a training document
shows the network is counted on the other folds of the sample, so that the network meets words that
were never counted as it will later. After half the steps each document's window is the one that the
network itself scores highest, and those documents come oftener that it gets wrong.

Scoring maps whole texts in place, without a shuffle. The input side of both layers depends on the
word alone, so workers keep it by word, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import filter_rows, map_texts

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    word_buckets: int = 1 << 16
    piece_buckets: int = 1 << 17
    word_dim: int = 5
    piece_dim: int = 5
    hidden: int = 8
    attention: int = 8
    window: int = 32
    stride: int = 24
    sample_each: int = 3000
    slice_chars: int = 12_000
    steps: int = 400
    batch: int = 128
    rate: float = 0.01
    cached_words: int = 120_000


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PSEUDO_DOCS = 5
FOLDS = 5
EMBEDDING_RATE = 1.0
EVIDENCE = 3  # the word's own, the largest and the smallest of its pieces


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split() if text else []


def word_features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word, buckets of all its pieces, and the number of each word's pieces.

    A word is written as ``<word>``; pieces have three, four or five bytes of that.
    """
    marked = b"".join([b"<" + w + b">" for w in words]) + b"\0" * 5
    data = np.frombuffer(marked, np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    size = int(ends[-1])
    left = np.repeat(ends, lengths) - np.arange(size)  # bytes to the end of the word
    prime = np.uint64(0x100000001B3)
    rolling = data[:size] + np.uint64(1)
    for k in (1, 2):
        rolling = rolling * prime + data[k : k + size]
    codes, places = [], []
    for n in (3, 4, 5):
        if n > 3:
            rolling = rolling * prime + data[n - 1 : n - 1 + size]
        fits = np.flatnonzero(left >= n)
        mixed = (rolling[fits] ^ (rolling[fits] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        codes.append((mixed >> np.uint64(64 - s.piece_buckets.bit_length() + 1)).astype(np.int64))
        places.append(fits)
    places, codes = np.concatenate(places), np.concatenate(codes)
    order = np.argsort(places, kind="stable")
    places, codes = places[order], codes[order]
    # The whole word: a sum over its bytes, each mixed with its place.
    inside = (np.arange(size) - np.repeat(starts, lengths)).astype(np.uint64)
    mixed = (data[:size] + np.uint64(257) * (inside + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(mixed, starts) * np.uint64(0xD6E8FEB86659FD93)
    whole = (whole >> np.uint64(64 - s.word_buckets.bit_length() + 1)).astype(np.int64)
    return whole, codes, np.diff(np.searchsorted(places, np.append(starts, size)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Parameters; ``word_z`` and ``piece_z`` are the weights of evidence."""

    settings: Settings
    word_z: np.ndarray
    piece_z: np.ndarray
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    key: str = field(default="")

    def sealed(self) -> Network:
        self.key = hashlib.sha256(pickle.dumps((self.word_z, self.piece_z, self.p))).hexdigest()
        return self

    def vectors(self, whole: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vectors of words, given by their word buckets and the buckets of their pieces."""
        starts = np.cumsum(counts) - counts
        z = self.piece_z[codes]
        evidence = np.stack(
            [self.word_z[whole], np.maximum.reduceat(z, starts), np.minimum.reduceat(z, starts)], axis=1
        )
        mean = np.add.reduceat(self.p["piece"][codes], starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([evidence, self.p["word"][whole], mean], axis=1).astype(np.float32)

    def project(self, whole: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the gates of both layers get from each word: six times ``hidden`` numbers."""
        x = self.vectors(whole, codes, counts)
        return np.concatenate([x @ self.p[f"{d}W"] + self.p[f"{d}b"] for d in "fb"], axis=1)

    def states(self, gates: np.ndarray, direction: str, lengths: np.ndarray, keep: bool = False):
        """States at every place. ``gates`` is (windows, places, 3 * hidden) with the windows longest
        first, so that those with a word at a place come first."""
        h = self.settings.hidden
        windows, places = gates.shape[:2]
        recur, cand = self.p[f"{direction}U"], self.p[f"{direction}V"]
        out = np.zeros((places, windows, h), np.float32)
        state = np.zeros((windows, h), np.float32)
        steps = []
        for t in range(places) if direction == "f" else range(places - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # lengths above t
            if not live:
                continue
            before = state[:live]
            given = gates[:live, t]
            ru = sigmoid(given[:, : 2 * h] + before @ recur)
            r, u = ru[:, :h], ru[:, h:]
            c = np.tanh(given[:, 2 * h :] + (r * before) @ cand)
            after = before + u * (c - before)
            if keep:
                steps.append((t, live, before.copy(), r, u, c))
            state[:live] = after
            out[t, :live] = after
        return out, steps

    def pool(self, both: np.ndarray, lengths: np.ndarray):
        """Attention over places, and the window's logit."""
        places = both.shape[0]
        hidden = np.tanh(both @ self.p["A"])
        energy = hidden @ self.p["a"]
        energy[np.arange(places)[:, None] >= lengths[None, :]] = -1e9
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, both)
        return pooled @ self.p["o"] + self.p["c"][0], (hidden, weight, pooled)

    def window_logits(self, gates: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h3 = 3 * self.settings.hidden
        forward, _ = self.states(gates[:, :, :h3], "f", lengths)
        backward, _ = self.states(gates[:, :, h3:], "b", lengths)
        return self.pool(np.concatenate([forward, backward], axis=2), lengths)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability for each whole text; a text without words has the bare bias."""
        split = [words_of(text) for text in texts]
        table = _tables(self)
        table.reserve(split)
        best, _ = self.highest([table.rows(words) for words in split], table.values)
        return sigmoid(self.scale * best + self.shift)

    def highest(self, rows: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of the highest window of each text, and that window's number. A text is the row
        numbers of its words in ``values``, the projections."""
        s = self.settings
        counts = np.array([len(r) for r in rows], np.int64)
        windows = np.where(counts > s.window, -(-(counts - s.window) // s.stride) + 1, counts > 0)
        best, which = np.full(len(rows), self.p["c"][0], np.float32), np.zeros(len(rows), np.int64)
        if not windows.sum():
            return best, which
        flat = np.concatenate([*rows, np.zeros(s.window, np.int64)])
        begins = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(rows)), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = begins[owner] + number * s.stride
        length = np.minimum(begins[owner] + counts[owner] - start, s.window)
        order = np.argsort(-length, kind="stable")
        logits = np.empty(len(owner), np.float32)
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            places = start[part][:, None] + np.arange(int(length[part[0]]))
            logits[part] = self.window_logits(values[flat[places]], length[part])
        filled = np.flatnonzero(windows)
        firsts = (np.cumsum(windows) - windows)[filled]
        best[filled] = np.maximum.reduceat(logits, firsts)
        hits = np.flatnonzero(logits == best[owner])[::-1]
        which[owner[hits]] = number[hits]  # the first of equal windows
        return best, which


class Projections:
    """Rows of ``Network.project`` by word, kept from batch to batch up to a bound."""

    def __init__(self, network: Network):
        self.network, self.index = network, {}
        self.values = np.zeros((0, 6 * network.settings.hidden), np.float32)
        self.used = 0

    def reserve(self, texts: list[list[bytes]]) -> None:
        wanted = set().union(*texts)
        new = wanted.difference(self.index)
        if self.used + len(new) > self.network.settings.cached_words:
            self.index, self.used, new = {}, 0, wanted
        if not new:
            return
        names = list(new)
        if self.used + len(names) > len(self.values):
            grown = np.zeros((max(2 * len(self.values), self.used + len(names)), self.values.shape[1]), np.float32)
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            projected = self.network.project(*word_features(part, self.network.settings))
            self.values[self.used : self.used + len(part)] = projected
            self.index.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


_KEPT: dict[str, Projections] = {}


def _tables(network: Network) -> Projections:
    if network.key not in _KEPT:
        _KEPT.clear()
        _KEPT[network.key] = Projections(network)
    return _KEPT[network.key]


class Sample:
    """Labelled texts as numbers of words in one list, and the features of the words in that list."""

    def __init__(self, texts: list[str], labels: list[int], settings: Settings):
        self.index: dict[bytes, int] = {}
        self.docs, kept = [], []
        for text, label in zip(texts, labels):
            words = words_of(text)
            if words:
                index = self.index
                self.docs.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
                kept.append(label)
        self.toxic = np.array(kept, int)
        words, parts = list(self.index), []
        for at in range(0, len(words), 20_000):
            whole, codes, counts = word_features(words[at : at + 20_000], settings)
            parts.append((whole.astype(np.int32), codes.astype(np.int32), counts.astype(np.int32)))
        self.index = {}
        empty = [(np.zeros(0, np.int32),) * 3]
        self.whole, self.codes, self.counts = (np.concatenate(c) for c in zip(*(parts or empty)))
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = self.counts[words].astype(np.int64)
        places = np.repeat(self.starts[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.whole[words], self.codes[places], counts


def _evidence(sample: Sample, rows: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the shares of toxic and other documents that a bucket is in, as if ``PSEUDO_DOCS``
    more documents of the usual mix had it: buckets never seen have no evidence, rare ones little."""
    words, parts = np.zeros((2, settings.word_buckets)), np.zeros((2, settings.piece_buckets))
    for i in rows:
        whole, codes, _ = sample.features(np.unique(sample.docs[i]))
        words[sample.toxic[i], np.unique(whole)] += 1
        parts[sample.toxic[i], np.unique(codes)] += 1
    share = np.array([(sample.toxic[rows] == k).sum() for k in (0, 1)]) / max(1, len(rows))
    found = []
    for counts in (words, parts):
        shrunk = counts + PSEUDO_DOCS * share[:, None]
        found.append((np.log(shrunk[1] / shrunk[0]) - np.log(share[1] / share[0])).astype(np.float32))
    return found[0], found[1]


def _parameters(s: Settings, rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = EVIDENCE + s.word_dim + s.piece_dim

    def normal(*shape, by):
        return (rng.normal(0, 1, shape) / np.sqrt(by)).astype(np.float32)

    p = {"word": 0.1 * normal(s.word_buckets, s.word_dim, by=1), "piece": 0.1 * normal(s.piece_buckets, s.piece_dim, by=1)}
    for d in "fb":
        p[f"{d}W"] = normal(width, 3 * s.hidden, by=width)
        p[f"{d}b"] = np.zeros(3 * s.hidden, np.float32)
        p[f"{d}U"] = normal(s.hidden, 2 * s.hidden, by=s.hidden)
        p[f"{d}V"] = normal(s.hidden, s.hidden, by=s.hidden)
    p["A"] = normal(2 * s.hidden, s.attention, by=2 * s.hidden)
    p["a"] = normal(s.attention, by=s.attention)
    p["o"] = normal(2 * s.hidden, by=2 * s.hidden)
    p["c"] = np.zeros(1, np.float32)
    return p


def _gradients(net: Network, x: np.ndarray, lengths: np.ndarray, target: np.ndarray):
    """Gradients of the mean logistic loss over one batch of windows, and those of the inputs."""
    s, p = net.settings, net.p
    h = s.hidden
    steps, outs = {}, {}
    for d in "fb":
        outs[d], steps[d] = net.states(x @ p[f"{d}W"] + p[f"{d}b"], d, lengths, keep=True)
    both = np.concatenate([outs["f"], outs["b"]], axis=2)
    logits, (hidden, attention, pooled) = net.pool(both, lengths)
    error = ((sigmoid(logits) - target) / len(target)).astype(np.float32)
    g = {"o": pooled.T @ error, "c": error.sum(keepdims=True)}
    d_pooled = error[:, None] * p["o"]
    d_both = attention[:, :, None] * d_pooled
    d_attention = np.einsum("tnk,nk->tn", both, d_pooled)
    d_energy = attention * (d_attention - (attention * d_attention).sum(axis=0))
    g["a"] = np.einsum("tn,tna->a", d_energy, hidden)
    d_hidden = d_energy[:, :, None] * p["a"] * (1 - hidden**2)
    g["A"] = np.einsum("tnk,tna->ka", both, d_hidden)
    d_both += d_hidden @ p["A"].T
    d_x = np.zeros_like(x)
    for i, d in enumerate("fb"):
        d_out = d_both[:, :, i * h : (i + 1) * h]
        g |= {f"{d}{n}": np.zeros_like(p[f"{d}{n}"]) for n in "WbUV"}
        d_state = np.zeros((x.shape[0], h), np.float32)
        for t, live, before, r, u, c in reversed(steps[d]):
            d_after = d_state[:live] + d_out[t, :live]
            d_c = d_after * u * (1 - c**2)
            d_u = d_after * (c - before) * u * (1 - u)
            d_reset = d_c @ p[f"{d}V"].T
            d_r = d_reset * before * r * (1 - r)
            d_gate = np.concatenate([d_r, d_u, d_c], axis=1)
            g[f"{d}V"] += (r * before).T @ d_c
            g[f"{d}U"] += before.T @ d_gate[:, : 2 * h]
            g[f"{d}W"] += x[:live, t].T @ d_gate
            g[f"{d}b"] += d_gate.sum(axis=0)
            d_x[:live, t] += d_gate @ p[f"{d}W"].T
            d_state[:live] = d_after * (1 - u) + d_reset * r + d_gate[:, : 2 * h] @ p[f"{d}U"].T
    return g, d_x


def _train_network(folds: list[Network], sample: Sample, fold: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Adam over windows; ``folds`` share their parameters and differ in evidence. Returns the logit
    of each document's highest window."""
    s, p = folds[0].settings, folds[0].p
    docs, toxic = sample.docs, sample.toxic
    centre = np.zeros(len(docs), int)
    for i, words in enumerate(docs):
        x = folds[fold[i]].vectors(*sample.features(words))
        centre[i] = x[:, :EVIDENCE].max(axis=1).argmax()
    groups = [np.flatnonzero(toxic == k) for k in (0, 1)]
    odds = [np.full(len(group), 1 / len(group)) for group in groups]
    small = [k for k in p if k not in ("word", "piece")]
    first, second = ({k: np.zeros_like(p[k]) for k in small} for _ in range(2))
    for step in range(1, s.steps + 1):
        if step == s.steps // 2:
            logits, centre = _highest(folds, sample, fold)
            miss = np.abs(sigmoid(logits) - toxic) + 0.02
            odds = [miss[group] / miss[group].sum() for group in groups]
        chosen = np.concatenate([rng.choice(group, s.batch // 2, p=o) for group, o in zip(groups, odds)])
        windows = []
        for i in chosen:
            words = docs[i]
            at = centre[i] if toxic[i] or rng.random() < 0.7 else int(rng.integers(len(words)))
            begin = max(0, min(at - int(rng.integers(s.window)), len(words) - s.window))
            windows.append(words[begin : begin + s.window])
        lengths = np.array([len(w) for w in windows])
        order = np.argsort(-lengths, kind="stable")
        lengths, owners = lengths[order], chosen[order]
        windows = [windows[i] for i in order]
        real = np.arange(lengths[0]) < lengths[:, None]
        x = np.zeros((len(windows), int(lengths[0]), p["fW"].shape[0]), np.float32)
        places = []
        for f, net in enumerate(folds):
            rows = np.flatnonzero(fold[owners] == f)
            if len(rows):
                own = np.zeros_like(real)
                own[rows] = real[rows]
                found = sample.features(np.concatenate([windows[r] for r in rows]))
                x[own] = net.vectors(*found)
                places.append((own, *found))
        g, d_x = _gradients(folds[0], x, lengths, toxic[owners].astype(np.float32))
        rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
        for k in small:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        for own, whole, codes, counts in places:
            d_words = d_x[own]
            np.add.at(p["word"], whole, -EMBEDDING_RATE * d_words[:, EVIDENCE : EVIDENCE + s.word_dim])
            d_pieces = d_words[:, EVIDENCE + s.word_dim :] / counts[:, None]
            np.add.at(p["piece"], codes, -EMBEDDING_RATE * np.repeat(d_pieces, counts, axis=0))
    return _highest(folds, sample, fold)[0]


def _highest(folds: list[Network], sample: Sample, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each document's highest window, and the middle word of that window."""
    docs = sample.docs
    logits, middle = np.zeros(len(docs)), np.zeros(len(docs), int)
    for f, net in enumerate(folds):
        own = np.flatnonzero(fold == f)
        for at in range(0, len(own), 200):
            part = own[at : at + 200]
            words, places = np.unique(np.concatenate([docs[i] for i in part]), return_inverse=True)
            rows = np.split(places, np.cumsum([len(docs[i]) for i in part])[:-1])
            logits[part], number = net.highest(rows, net.project(*sample.features(words)))
            half = np.array([min(net.settings.window, len(docs[i])) // 2 for i in part])
            middle[part] = number * net.settings.stride + half
    return logits, middle


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Network | None:
    """Train on texts and their labels; null if either class is missing."""
    sample = Sample(texts, labels, settings)
    if len(set(sample.toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(6)
    fold = np.zeros(len(sample.docs), int)
    for k in (0, 1):  # each class evenly over the folds
        own = rng.permutation(np.flatnonzero(sample.toxic == k))
        fold[own] = np.arange(len(own)) % FOLDS
    parameters = _parameters(settings, rng)

    def network(rows: np.ndarray) -> Network:
        return Network(settings, *_evidence(sample, rows, settings), parameters)

    folds = [network(np.flatnonzero(fold != f)) for f in range(FOLDS)]
    logits = _train_network(folds, sample, fold, rng)
    final = network(np.arange(len(sample.docs)))
    # The scale: a logistic fit of the labels on the highest windows, by gradient descent.
    for _ in range(800):
        miss = sigmoid(final.scale * logits + final.shift) - sample.toxic
        final.scale -= 0.05 * float((miss * logits).mean())
        final.shift -= 0.2 * float(miss.mean())
    return final.sealed()


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """The bounded training sample: slices of texts and their labels (0 or 1)."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    toxic = toxic.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in toxic.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, settings.sample_each / n))])
    drawn = toxic.where(draw < share[F.col("toxic")])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spare = F.greatest(F.length("text") - settings.slice_chars + 1, F.lit(1))
    place = (F.pmod(F.xxhash64("doc_id", F.lit(2)), spare) + 1).cast("int")
    part = F.substring("text", place, F.lit(settings.slice_chars)).alias("part")
    # At most about two settings.sample_each short rows, whatever the tables' size.
    rows = texts.where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", part)
    found = sorted((r["doc_id"], r["toxic"], r["part"]) for r in rows.collect())
    return [r[2] for r in found], [r[1] for r in found]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    return fit(*sample(docs, labels, settings), settings)


def score(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null texts and texts without words get the score of no evidence. Without a network (no labelled
    rows of both kinds) every score is 0. Repeated rows get equal scores; other columns are not read.
    """

    def make():
        def step(ids, texts):
            found = scores(network, texts)
            return {"doc_id": pa.array(ids, pa.int64()), "score": pa.array(found, pa.float64())}

        return step

    found = map_texts(docs, "doc_id long, score double", make)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def scores(network: Network | None, texts: list[str | None]) -> np.ndarray:
    if network is None:
        return np.zeros(len(texts))
    return network.scores(texts).astype(np.float64)


def keep_clean(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns kept."""

    def make():
        return lambda texts: (scores(network, texts) < threshold).tolist()

    return filter_rows(docs, make)
