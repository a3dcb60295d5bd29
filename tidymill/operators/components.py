"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..scratch import write_out

# With so few edges the rounds take longer than their work: the driver follows the edges instead.
FEW_EDGES = 10_000
# So few rows become part of a plan; more are written, as plans are copied and printed.
LISTED_ROWS = 500


def _is_star_forest(edges: DataFrame) -> bool:
    """True when each node has one parent at most, and no parent has a parent."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")),
    )
    roles = edges.select(F.inline(ends)).groupBy("node").agg(
        F.sum("child").alias("up"), F.max("parent").alias("down")
    )
    return roles.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both_ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both_ways.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"))
    smallest = smallest.select("centre", F.least("centre", "m").alias("m"))
    larger = both_ways.where(F.col("v") > F.col("u"))
    return larger.join(smallest, F.col("u") == F.col("centre")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"))
    moved = (
        edges.join(smallest, F.col("u") == F.col("centre"))
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(smallest.select(F.col("centre").alias("u"), F.col("m").alias("v"))).distinct()


def _followed(edges: list) -> list[tuple]:
    """(node, component) of a few edges (larger, smaller)."""
    smaller = {}

    def root(node):
        while node in smaller:
            smaller[node] = smaller.get(smaller[node], smaller[node])
            node = smaller[node]
        return node

    for u, v in edges:
        u, v = sorted((root(u), root(v)))
        if u != v:
            smaller[v] = u
    return [(node, root(node)) for node in {n for edge in edges for n in edge}]


def plain_value(node):
    return node.asDict(recursive=True) if isinstance(node, Row) else node


def small_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A table of few rows that the driver knows, as part of the plan; no job and no file is needed."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return spark.sql("SELECT 1").select(F.inline(listed))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """Rows ``(node, component)`` for every node that has an edge; the component is named after
    its smallest node.

    Each round is written out, which cuts the lineage. A node's neighbours are never gathered:
    rounds only take minima, which combine on the map side, and join them back. Up to ``few`` edges
    are followed on the driver, which sees no more than that; for nodes of texts and whole numbers only.
    """
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = write_out(first.where(F.col("u") != F.col("v")).distinct(), "components")
    if few:
        known = current.limit(few + 1).collect()
        if len(known) <= few:
            kind = current.schema["u"].dataType.simpleString()
            found = [{"node": plain_value(n), "component": plain_value(c)} for n, c in _followed(known)]
            rows = small_table(edges.sparkSession, found, f"node:{kind},component:{kind}")
            return rows if len(found) <= LISTED_ROWS else write_out(rows, "components")
    while not _is_star_forest(current):
        current = write_out(_small_star(_large_star(current).distinct()), "components")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
