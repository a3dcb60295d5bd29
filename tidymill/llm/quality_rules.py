"""Quality rules learned from labelled statistics, as ordered Spark conditions.

Statistics of a text are expressions on its row: no shuffle, and nothing for a hot source or a group
of copies to gather in. Repeated word windows are found by sorting one 64-bit number per window, a
hash in its upper bits and the place in the lower ones, so that equal windows lie next to each other;
with ``m`` windows the hash keeps 64 - log2(m) bits.

A decision list is learned by sequential covering on a bounded sample of labelled rows
(``Settings.sample_rows``, drawn by a hash, each class alike as far as it has rows). A rule is grown
on two thirds of the rows by adding the threshold with the best information gain, then pruned on the
rest; rows it covers are taken out and the next rule is sought, until a rule is no longer precise
enough. The list becomes one chain of conditions, the first that holds deciding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import once

SPACE = " \t\n\x0b\f\r"
FEATURES = [
    "n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line",
]


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 12_000
    thresholds: int = 32  # per feature and step, at quantiles of the rows still covered
    longest: int = 3  # conditions of a rule
    precision: float = 0.95  # on the pruning rows
    least_rows: int = 3  # bad rows that a rule must cover in either part
    most_rules: int = 12


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # greater than the threshold, or else at most that
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the contract's counts and the features of every row.

    Null texts, and texts without words, have no words; their shares are 0. Other columns of ``docs``
    are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    trimmed = F.btrim("text", F.lit(SPACE))
    none = F.array().cast("array<string>")
    with_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""
    rows = rows.select(
        "doc_id", once(F.when(trimmed == "", none).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).alias("words"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), with_word).alias("lines"),
    )
    m = F.greatest(F.size("words") - 2, F.lit(0))
    rows = rows.select(
        "doc_id", "words", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        m.alias("m"), F.greatest(F.ceil(F.log2(m + 1)), F.lit(1)).cast("int").alias("bits"),
    )
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.withColumn("windows", once(F.sort_array(F.transform(
        F.slice("words", F.lit(1), F.col("m")),
        lambda w, i: F.call_function("shiftleft", window(w, i), F.col("bits")).bitwiseOR(i.cast("long")),
    ))))
    top = lambda x: F.call_function("shiftright", x, F.col("bits"))
    beside = lambda x, i: F.coalesce(top(F.get("windows", i)) == top(x), F.lit(False))
    rows = rows.withColumn("again", F.filter("windows", lambda x, i: beside(x, i - 1) | beside(x, i + 1)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    rows = rows.withColumn("again", once(F.transform("again", place)))
    covered = F.array_union(
        F.array_union("again", F.transform("again", lambda p: p + 1)), F.transform("again", lambda p: p + 2)
    )
    rows = rows.withColumn("n_repeat_words", F.size(covered).cast("long"))
    words = F.greatest("n_words", F.lit(1)).cast("double")
    lines = F.greatest("n_lines", F.lit(1)).cast("double")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"), (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_distinct") / words).alias("distinct_share"), (F.col("n_words") / lines).alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _grow(values: np.ndarray, bad: np.ndarray, settings: Settings) -> list[Condition]:
    """Add the condition with the best information gain until only bad rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < settings.longest and not bad[covered].all():
        hits, total = int(bad[covered].sum()), int(covered.sum())
        best, best_gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            own = values[covered, f]
            distinct = np.unique(own)
            if len(distinct) < 2:
                continue
            cuts = np.quantile(own, np.linspace(0, 1, settings.thresholds), method="lower")
            at = np.unique(np.minimum(np.searchsorted(distinct, cuts), len(distinct) - 2))
            for threshold in (distinct[at] + distinct[at + 1]) / 2:  # midway to the next value
                for above in (True, False):
                    condition = Condition(name, above, float(threshold))
                    inside = condition.holds(own)
                    p, n = int(bad[covered][inside].sum()), int(inside.sum())
                    if p and n < total:
                        gain = p * (math.log2(p / n) - math.log2(hits / total))
                        if gain > best_gain:
                            best, best_gain = condition, gain
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(values[:, FEATURES.index(best.feature)])
    return rule


def _covers(rule: list[Condition], values: np.ndarray) -> np.ndarray:
    inside = np.ones(len(values), bool)
    for condition in rule:
        inside &= condition.holds(values[:, FEATURES.index(condition.feature)])
    return inside


def _worth(rule: list[Condition], values: np.ndarray, bad: np.ndarray) -> float:
    inside = _covers(rule, values)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(values: np.ndarray, bad: np.ndarray, settings: Settings = Settings()) -> list[list[Condition]]:
    """Ordered rules for bad rows by sequential covering; ``values`` has the columns FEATURES."""
    grown = np.random.default_rng(8).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    rules: list[list[Condition]] = []
    while len(rules) < settings.most_rules:
        grow, prune = left & grown, left & ~grown
        if bad[grow].sum() < settings.least_rows or bad[prune].sum() < settings.least_rows:
            break
        rule = _grow(values[grow], bad[grow], settings)
        # Of all shorter beginnings of the rule, the best on rows it was not grown on; the shortest of equals.
        choices = [rule[:k] for k in range(1, len(rule) + 1)]
        if not choices:
            break
        rule = max(choices, key=lambda r: (_worth(r, values[prune], bad[prune]), -len(r)))
        inside = _covers(rule, values)
        p, n = bad[inside & prune].sum(), (inside & prune).sum()
        if p < settings.least_rows or p < settings.precision * n:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of a bounded sample of labelled rows."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull())
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, len(FEATURES))), np.zeros(0, bool)
    each = settings.sample_rows / 2
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) / (1 << 30)
    drawn = marked.where(draw < share[F.col("quality")])  # about sample_rows short rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(F.broadcast(drawn), texts["doc_id"] == drawn["id"]).select("doc_id", "text", "quality")
    # The label goes along in place of the id, so that the statistics need no join.
    rows = statistics(chosen.select(F.col("quality").alias("doc_id"), "text")).select("doc_id", *FEATURES).collect()
    found = sorted(tuple(r) for r in rows)
    return np.array([r[1:] for r in found], float).reshape(-1, len(FEATURES)), np.array([r[0] == 0 for r in found], bool)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    return learn(*labelled_sample(docs, labels, settings), settings)


def verdict(rules: list[list[Condition]]) -> Column:
    """True unless a rule holds: one ordered chain of conditions."""
    chain = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and the
    other features of every row. Repeated rows get equal results."""
    found = statistics(docs).withColumn("base_failed", base_failed())
    found = found.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[f for f in FEATURES if f != "n_words"],
    )
