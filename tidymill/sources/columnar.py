"""Parquet scans, batches and sinks, and what a set of files holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.refs import col, cols
from .delimited import TextFormat, detect_format, scan as scan_delimited

# Predicate operators and codecs a caller may name.
CODECS = ("snappy", "gzip", "zstd", "none")
_TESTS: dict[str, Callable] = {
    "=": lambda c, v: c == v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
}


def scan(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None,
    filters: Sequence[tuple] | None = None,
) -> DataFrame:
    """Read Parquet with a column list and ``[("c", ">", 100)]`` predicates; both reach the scan."""
    df = spark.read.parquet(path)
    for name, operator, value in filters or []:
        df = df.where(_TESTS[operator](col(name), value))
    return df.select(*cols(columns)) if columns else df


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Run a pandas function over pieces of ``chunk_rows`` rows (the last of a partition has fewer),
    on the executors. Smaller Arrow batches are put together, larger ones cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            while len(batch):
                part, batch = batch.iloc[:chunk_rows - rows], batch.iloc[chunk_rows - rows:]
                held.append(part)
                rows += len(part)
                if rows == chunk_rows:
                    yield function(pd.concat(held, ignore_index=True))
                    held, rows = [], 0
        if held:
            yield function(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


def write(
    df: DataFrame, path: str, codec: str = "snappy", max_rows_per_file: int | None = None,
    mode: str = "errorifexists",
) -> str:
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    writer = df.write.mode(mode).option("compression", codec)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)
    return path


def convert_delimited(
    spark: SparkSession, source: str, target: str, encoding: str | None = None, separator: str | None = None,
    codec: str = "snappy", schema: T.StructType | str | None = None,
) -> str:
    """Delimited text to Parquet. Encoding and separator are detected unless they are given; whether fields
    hold line breaks is looked up in any case. Types are inferred without a ``schema``."""
    found = detect_format(spark, source)
    fmt = TextFormat(encoding or found.encoding, separator or found.separator, found.multi_line)
    return write(scan_delimited(spark, source, schema=schema, fmt=fmt), target, codec)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, bytes, rows and column count."""
    df = spark.read.parquet(path)
    files = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows")).withColumn(
        "columns", F.lit(len(df.columns))
    )


def table_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, rows, columns, bytes and the schema as text."""
    schema = spark.read.parquet(path).schema
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return file_info(spark, path).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("columns").alias("columns"),
        F.sum("bytes").alias("bytes"), F.lit(types).alias("schema"),
    )
