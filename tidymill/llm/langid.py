"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the three- and four-byte pieces of lower-cased words, hashed into a fixed number of
buckets. Training (numpy, stochastic gradient descent on the driver) sees a bounded sample: about
``Settings.sample_rows`` labelled documents in all, the same number for each language as far as it
has them, of each one slice of ``Settings.slice_chars`` characters at a hashed place. Prediction
reads every whole text where it lies, without a shuffle: a document's logits are the mean of its
subwords' embeddings times the weights, so the product of the two tables is made once and shipped.

Confidence is calibrated with a temperature on a part of the sample that training does not see. The
rejection limit is the score that all but ``Settings.reject_share`` of those texts reach.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import filter_rows, map_texts

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dimension: int = 16
    sample_rows: int = 12_000
    slice_chars: int = 600
    epochs: int = 3
    least_steps: int = 600
    batch: int = 32
    rate: float = 0.3
    calibration_share: float = 0.2
    reject_share: float = 0.001
    limit_at_most: float = 0.4


# Bytes outside ASCII belong to letters here; ASCII is letters or a gap.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_GAP = b"    "


def subwords(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the subwords at each byte of all texts (``buckets`` where there is none), for both
    lengths, and the place where each text begins."""
    raws = [((text or "").lower().encode() + _GAP).translate(_LETTERS) for text in texts]
    starts = np.zeros(len(raws), np.int64)
    np.cumsum([len(r) for r in raws[:-1]], out=starts[1:])
    data = np.frombuffer(b" " + b"".join(raws) + _GAP, np.uint8).astype(np.uint32)
    size = len(data) - 5
    first, second, third, fourth = (data[k : k + size] for k in range(4))
    shift = np.uint32(32 - buckets.bit_length() + 1)
    three = first | second << np.uint32(8) | third << np.uint32(16)
    four = three | fourth << np.uint32(24)
    three = ((three * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
    four = ((four ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> shift).astype(np.int64)
    gap = np.uint32(32)
    three[second == gap] = buckets
    four[(second == gap) | (third == gap)] = buckets
    return three, four, starts


class Model:
    """Fitted tables: ``table`` has a row per bucket (the last is zero) and a column per language."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, limit: float):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.limit = temperature, limit

    def logits(self, texts: list[str | None]) -> np.ndarray:
        buckets = len(self.table) - 1
        three, four, starts = subwords(texts, buckets)
        counts = np.add.reduceat((three < buckets).astype(np.int64) + (four < buckets), starts)
        columns = [
            np.add.reduceat(column[three] + column[four], starts)
            for column in np.ascontiguousarray(self.table.T)
        ]
        return np.stack(columns, axis=1) / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([has_letter(t) for t in texts], bool)
        if not self.languages or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        chances = softmax(self.logits(texts) / self.temperature)
        best = chances.argmax(axis=1)
        names = [self.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
        return names, np.where(known, chances[np.arange(len(texts)), best], 0.0)


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Train on texts and their languages; nothing else is looked at."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((settings.buckets + 1, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(10)
    target = np.array([languages.index(label) for label in labels])
    order = rng.permutation(len(texts))
    held = order[: int(len(texts) * settings.calibration_share)]
    used = order[len(held) :]
    embeddings = rng.normal(0, 0.1, (settings.buckets + 1, settings.dimension)).astype(np.float32)
    embeddings[-1] = 0
    weights = rng.normal(0, 0.3, (settings.dimension, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    per_epoch = -(-len(used) // settings.batch)
    epochs = max(settings.epochs, -(-settings.least_steps // per_epoch))
    steps, total = 0, epochs * per_epoch
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for start in range(0, len(shuffled), settings.batch):
            rows = shuffled[start : start + settings.batch]
            # A random part of each slice, so that short texts are learned as well.
            cuts = []
            for i in rows:
                length = int(rng.integers(12, max(13, len(texts[i]) + 1)))
                at = int(rng.integers(0, max(1, len(texts[i]) - length + 1)))
                cuts.append(texts[i][at : at + length])
            three, four, starts = subwords(cuts, settings.buckets)
            index = np.concatenate([three, four])
            of = np.tile(np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(three)))), 2)
            keep = index < settings.buckets
            index, of = index[keep], of[keep]
            share = 1 / np.maximum(np.bincount(of, minlength=len(rows)), 1).astype(np.float32)
            mean = np.stack(
                [np.bincount(of, embeddings[index, d], len(rows)) for d in range(settings.dimension)], axis=1
            ).astype(np.float32) * share[:, None]
            error = softmax(mean @ weights + bias).astype(np.float32)
            error[np.arange(len(rows)), target[rows]] -= 1
            rate = settings.rate * (1 - steps / total)
            back = error @ weights.T
            weights -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0)
            np.add.at(embeddings, index, -rate * (back * share[:, None])[of])
            steps += 1
    model = Model(languages, (embeddings @ weights).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    sample = held if len(held) >= 20 else used
    logits = model.logits([texts[i] for i in sample])
    right = np.arange(len(sample)), target[sample]
    grid = np.geomspace(0.2, 5, 40)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[right] + 1e-12).mean()))
    chances = softmax(logits / model.temperature)
    scores = np.sort(chances.max(axis=1)[chances.argmax(axis=1) == right[1]])
    if len(scores):
        # A text in two languages may give each one half, and is kept.
        model.limit = float(min(scores[int(len(scores) * settings.reject_share)], settings.limit_at_most))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[str]]:
    """The bounded training sample: slices of texts and their languages."""
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    each = settings.sample_rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    spare = F.greatest(F.length("text") - settings.slice_chars + 1, F.lit(1))
    place = (F.pmod(F.xxhash64("doc_id", F.lit(2)), spare) + 1).cast("int")
    rows = usable.where(draw < share[F.col("lang")]).select(
        "doc_id", "lang", F.substring("text", place, F.lit(settings.slice_chars)).alias("part")
    ).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["part"]))
    return [r["part"] for r in rows], [r["lang"] for r in rows]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(*sample(docs, settings), settings)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every row if
    no labelled row was there to learn from. Repeated rows get equal results; other columns are not read.
    """

    def make():
        def step(ids, texts):
            names, scores = model.predict(texts)
            low = [name == UNKNOWN or score < model.limit for name, score in zip(names, scores)]
            return {
                "doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()), "rejected": pa.array(low, pa.bool_()),
            }

        return step

    found = map_texts(docs, "doc_id long, lang_pred string, score double, rejected boolean", make)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is told with enough confidence, all columns kept."""

    def make():
        def keep(texts):
            names, scores = model.predict(texts)
            return [name != UNKNOWN and score >= model.limit for name, score in zip(names, scores)]

        return keep

    return filter_rows(docs, make)
