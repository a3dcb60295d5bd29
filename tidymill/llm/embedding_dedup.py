"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, and
distributed connected components.

Vectors are compared only under equal labels. Copies of one vector are one class, counted and not
paired. Every class gets one key per table, the signs of its products with random hyperplanes. The
number of signs grows with the logarithm of the number of classes, so that buckets stay small, and
the number of tables follows from it: enough that a pair at the limit shares a key with probability
``recall`` (closer pairs with more). Cosines are computed in double precision for all pairs of a
bucket, so no link is wrong, and with the tables' keys at hand a pair counts in the first table only
in which it meets.

A bucket larger than ``BLOCK`` is cut into blocks by a hash, and each pair of blocks is a unit of its
own; units are dealt over as many shards as their rows ask for. A shard returns, for each vector, its
number of new links and one edge to the smallest vector it hangs together with: no list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import connected_components
from ..scratch import write_out

UNNAMED = 1 << 62
COSINE = 0.93
RECALL = 0.99
BLOCK = 512
SHARD_ROWS = 4000
CLASSES_PER_BUCKET = 64


def plan_tables(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs per key and number of tables for that many classes."""
    signs = min(30, max(6, math.ceil(math.log2(max(classes, 1) / CLASSES_PER_BUCKET + 1)) + 2))
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def hyperplanes(dimension: int, count: int) -> np.ndarray:
    return np.random.default_rng(9).normal(size=(dimension, count))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, digest, label, vector`` of the vectors that can link: label not null, components all
    there and finite, not all zero. The digest stands for label and vector."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    form = "<f4" if single else "<f8"
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    ).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))

    def run(batches):
        for batch in batches:
            rows = []
            for vec_id, label, values in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                vector = np.array(values, form) + 0.0  # one zero
                if len(vector) and np.isfinite(vector).all() and vector.any():
                    raw = vector.astype(form).tobytes()
                    rows.append((vec_id, xxhash.xxh3_128_digest(label.encode() + b"\0" + raw), label, raw))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["vec_id", "digest", "label", "vector"]
            )

    return source.mapInArrow(run, "vec_id long, digest binary, label string, vector binary")


def _keys(classes: DataFrame, signs: int, tables: int, form: str) -> DataFrame:
    """``rep, label, members, vector, keys``: one 32-bit key per table. Vectors of another length
    never share a label's bucket, as the length is part of the label."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            raws = batch.column("vector").to_pylist()
            keys = [b""] * len(raws)
            sizes = np.array([len(r) for r in raws])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                matrix = np.frombuffer(b"".join([raws[i] for i in own]), form).reshape(len(own), -1).astype(float)
                plane = planes.setdefault(matrix.shape[1], hyperplanes(matrix.shape[1], signs * tables))
                bits = (matrix @ plane > 0).reshape(len(own), tables, signs)
                for i, row in zip(own, (bits @ weights).astype("<i4")):
                    keys[i] = row.tobytes()
            labels = [f"{label}/{size}" for label, size in zip(batch.column("label").to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(labels), batch.column("members"), batch.column("vector"),
                 pa.array(keys, pa.binary()),
                 pa.array([np.frombuffer(k, "<i4").tolist() for k in keys], pa.list_(pa.int32()))],
                names=["rep", "label", "members", "vector", "keys", "key"],
            )

    schema = "rep long, label string, members long, vector binary, keys binary, key array<int>"
    return classes.select("rep", "label", "members", "vector").mapInArrow(run, schema)


def _compare(cosine: float, form: str):
    def unit_links(table: int, apart: bool, sides: np.ndarray, vectors: np.ndarray, keys: np.ndarray):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        close = unit @ unit.T >= cosine
        np.fill_diagonal(close, False)
        if apart:  # two blocks: what lies within either has a unit of its own
            close &= sides[:, None] != sides[None, :]
        fresh = close.copy()
        rows, columns = np.nonzero(close)
        if table:
            fresh[rows, columns] = (keys[rows, :table] != keys[columns, :table]).all(axis=1)
        return close, fresh

    def smallest(close: np.ndarray, reps: np.ndarray) -> np.ndarray:
        """The smallest name each row hangs together with."""
        names = reps.copy()
        while True:
            lower = np.minimum(names, np.where(close, names[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lower == names).all():
                return names
            names = lower

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for unit, part in frame.groupby(["label", "table", "bucket", "low", "high"], sort=False):
            if len(part) < 2:
                continue
            vectors = np.frombuffer(b"".join(part["vector"]), form).reshape(len(part), -1).astype(float)
            keys = np.frombuffer(b"".join(part["keys"]), "<i4").reshape(len(part), -1)
            reps, members = part["rep"].to_numpy(), part["members"].to_numpy()
            close, fresh = unit_links(int(unit[1]), unit[3] != unit[4], part["side"].to_numpy(), vectors, keys)
            linked = np.flatnonzero(close.any(axis=1))
            if len(linked):
                root, links = smallest(close, reps), fresh @ members
                found += zip(reps[linked].tolist(), root[linked].tolist(), links[linked].tolist())
        return pd.DataFrame(found, columns=["rep", "root", "links"])

    return run


def links_of_classes(classes: DataFrame, cosine: float, recall: float, form: str) -> DataFrame:
    """``rep, root, links``: some rows for each linked class, whose links add up."""
    count = classes.count()
    signs, tables = plan_tables(count, cosine, recall)
    keyed = write_out(_keys(classes, signs, tables, form), "keys")
    placed = keyed.select("rep", "label", F.posexplode("key").alias("table", "bucket"))
    bucket = ["label", "table", "bucket"]
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.hash("rep", F.lit(5)), F.col("blocks"))
    units = placed.join(sizes, bucket).withColumn("blocks", blocks).withColumn("side", side)
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", *bucket, "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")
    )
    units = write_out(units, "units")
    shards = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64(*bucket, "low", "high"), F.lit(shards)).alias("shard")
    full = units.join(keyed.select("rep", "members", "vector", "keys"), "rep").select("*", shard)
    return full.groupBy("shard").applyInPandas(_compare(cosine, form), "rep long, root long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Vectors that are null, zero or hold null or non-finite components, or whose label is null, link
    with nothing; so do vectors of different lengths. Rows with one vector and label are linked copies,
    a repeated ``vec_id`` among them. A vector without an id links and is linked like any other but names
    no component, so one that hangs together with no id has none; ids are taken to be below 2**62. Other
    columns are not read; an empty table gives an empty one.
    """
    kind = vectors.schema["embedding"].dataType
    form = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = write_out(usable_vectors(vectors), "vectors")
    # A class without an id gets a name above all ids, so that it is no component's smallest.
    unnamed = F.xxhash64("digest").bitwiseAND(UNNAMED - 1).bitwiseOR(UNNAMED)
    classes = write_out(
        rows.groupBy("digest").agg(
            F.coalesce(F.min("vec_id"), unnamed).alias("rep"), F.count(F.lit(1)).alias("members"), F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        ), "classes",
    )
    found = write_out(links_of_classes(classes, cosine, recall, form), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.select("digest", "rep", "members").join(counts, "rep", "left").join(
        groups, F.col("rep") == F.col("node"), "left"
    ).select(
        F.col("digest").alias("of"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "rep").alias("component"),
    ).withColumn("component", F.when(F.col("component") < UNNAMED, F.col("component")))
    linked = rows.select("vec_id", "digest").join(result, F.col("digest") == F.col("of"))
    # Every row of the input, linked or not; a repeated id has its rows' results in any order.
    lone = usable_rows_left_out(vectors, form)
    done = linked.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    done = done.unionByName(lone.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def usable_rows_left_out(vectors: DataFrame, form: str) -> DataFrame:
    """The rows that cannot link."""
    kind = "float" if form == "<f4" else "double"
    limit = F.lit(math.inf).cast(kind)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    embedding = F.col("embedding").cast(f"array<{kind}>")
    usable = (
        F.col("label").cast("string").isNotNull() & embedding.isNotNull() & F.forall(embedding, fine)
        & F.exists(embedding, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(usable, F.lit(False)).alias("usable"))
    return rows.where(~F.col("usable"))
