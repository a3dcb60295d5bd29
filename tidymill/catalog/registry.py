"""The given tables, views with defects derived from them, and the list of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch_path

# Views with defects; the same SQL runs on Spark and on the checking engine.
VIEWS = {
    "dirty_customer": """
        SELECT c_custkey, c_nationkey,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    WHEN c_custkey % 7 = 0 THEN 'N/A'
                    WHEN c_custkey % 5 = 0 THEN concat('  ', lower(c_mktsegment), ' ')
                    ELSE c_mktsegment END AS segment,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
               CASE WHEN c_custkey % 17 = 0 THEN 'abc'
                    WHEN c_custkey % 3 = 0
                    THEN replace(CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING), '.', ',')
                    ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) END AS acctbal_text,
               CAST(NULL AS DOUBLE) AS empty_col,
               CAST(c_custkey + 10000000000 AS BIGINT) AS code_like
        FROM customer""",
    "dup_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 0 AS copy_no FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice, o_orderpriority,
               1 AS copy_no
        FROM orders WHERE o_orderkey % 10 = 0""",
    "exact_copies": """
        SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0""",
    "date_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 9 = 0 THEN 'bad'
                    WHEN o_orderkey % 2 = 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
                                                        lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/',
                                                        CAST(year(o_orderdate) AS STRING))
                    ELSE concat(CAST(year(o_orderdate) AS STRING), '-',
                                lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-',
                                lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END AS date_text
        FROM orders""",
    "typo_part": """
        SELECT p_partkey, p_name,
               CASE WHEN p_partkey % 9 = 0 THEN concat(substr(p_name, 1, length(p_name) - 1), 'x')
                    WHEN p_partkey % 14 = 0 THEN concat(' ', upper(p_name))
                    ELSE p_name END AS name
        FROM part""",
    "partial_nation": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0",
    "money_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('R$ ', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING))
                    WHEN o_orderkey % 3 = 1 THEN concat(CAST(o_custkey AS STRING), '%')
                    ELSE concat('1.', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ',50') END AS amount
        FROM orders""",
}

# Base tables each view reads.
VIEW_SOURCES = {
    "dirty_customer": ["customer"], "dup_orders": ["orders"], "exact_copies": ["orders"],
    "date_text": ["orders"], "typo_part": ["part"], "partial_nation": ["nation"], "money_text": ["orders"],
}


class Tables:
    """``tables.orders`` reads a given table, ``tables.dirty_customer`` builds a derived one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sources = {source: getattr(self, source) for source in VIEW_SOURCES[name]}
        sql = VIEWS[name]
        for source in sources:
            sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
        return self.spark.sql(sql, **sources)

    def fresh_path(self, label: str) -> str:
        return scratch_path(self.spark, label)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register a query; ``{dirty_customer}`` and the like in the SQL stand for the views."""
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    if sql is not None:
        for view, text in VIEWS.items():
            sql = sql.replace("{" + view + "}", f"({text})")
    QUERIES[name] = Query(run, sql)
