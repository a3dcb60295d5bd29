"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Documents are tokenized where they are read and counted by length; partial counts combine before
the shuffle, so a hot length or source is one row per task. From then on work depends on the number
of distinct lengths only. Suffix sums go over three levels of 1024 lengths, 1024 blocks and the rest,
each a window over one block, so no window holds more than 1024 rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import write_out
from ._arrow import map_texts
from .bpe import read_definition
from .byte_tokens import encoder

BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, length)`` in tokens of every whole text; null and empty texts have length 0."""
    definition = read_definition(path)

    def make():
        coder = encoder(definition)

        def step(ids, texts):
            lengths = [len(coder.encode(text)) for text in texts]
            return {"doc_id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int64())}

        return step

    return map_texts(docs, "doc_id long, length long", make)


def histogram(lengths: DataFrame) -> DataFrame:
    """``(length, n_docs)``, one row per distinct length."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def written_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram as a written table, so that later steps do not tokenize again."""
    return write_out(histogram(lengths), "lengths")


def _suffix(table: DataFrame, key: str, columns: list[str], level: int = 0) -> DataFrame:
    """Add, for each column, its sum over all rows with a larger ``key`` (``<column>_after``)."""
    if level == 2:
        own = Window.partitionBy(F.lit(0)).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"{c}_after": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    block = f"__block{level}"
    table = table.withColumn(block, F.floor(F.col(key) / BLOCK).cast("long"))
    blocks = _suffix(table.groupBy(block).agg(*[F.sum(c).alias(c) for c in columns]), block, columns, level + 1)
    blocks = blocks.select(F.col(block), *[F.col(f"{c}_after").alias(f"__{c}_blocks") for c in columns])
    own = Window.partitionBy(block).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    inner = table.withColumns({f"{c}_after": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    joined = inner.join(blocks, block)
    sums = {f"{c}_after": F.col(f"{c}_after") + F.col(f"__{c}_blocks") for c in columns}
    return joined.withColumns(sums).drop(block, *[f"__{c}_blocks" for c in columns])


def suffix_table(counts: DataFrame) -> DataFrame:
    """One row per distinct length, with the answers for a context limit of that many tokens.

    ``n_docs, n_tokens``: documents and tokens of that length; ``docs_longer, tokens_longer``: of
    larger lengths; ``docs_upto, tokens_upto``: up to the limit, itself included;
    ``truncated_total``: tokens left when every document is cut at the limit; ``quantile``: share of
    documents up to the limit. An empty table gives an empty one.
    """
    table = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    sums = _suffix(table, "length", ["n_docs", "n_tokens"])
    totals = table.agg(F.sum("n_docs").alias("__docs"), F.sum("n_tokens").alias("__tokens"))
    sums = sums.join(F.broadcast(totals), how="cross")  # one row
    return sums.select(
        "length", "n_docs", "n_tokens",
        F.col("n_docs_after").alias("docs_longer"), F.col("n_tokens_after").alias("tokens_longer"),
        (F.col("__docs") - F.col("n_docs_after")).alias("docs_upto"),
        (F.col("__tokens") - F.col("n_tokens_after")).alias("tokens_upto"),
        (F.col("__tokens") - F.col("n_tokens_after") + F.col("length") * F.col("n_docs_after")).alias("truncated_total"),
        ((F.col("__docs") - F.col("n_docs_after")) / F.col("__docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, docs_longer, tokens_upto, truncated_total)`` for any context limits, from the suffix
    table: a limit between two lengths has the documents longer than the lower one."""
    found = []
    for limit in limits:
        longer = F.col("length") > limit
        found.append(table.agg(
            F.lit(limit).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
            F.coalesce(F.sum(F.when(~longer, F.col("n_tokens"))), F.lit(0)).alias("tokens_upto"),
        ))
    result = found[0]
    for rows in found[1:]:
        result = result.unionByName(rows)
    return result.withColumn("truncated_total", F.col("tokens_upto") + F.col("limit") * F.col("docs_longer"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least that share of documents stays within."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    fits = table.select("length", "quantile", asked).where(F.col("quantile") >= F.col("share"))
    return fits.groupBy("share").agg(F.min("length").alias("length"))
