"""Positions found by counting, against sorting."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidymill.operators import order, selection


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "SAMPLE", 60)
    monkeypatch.setattr(selection, "CUTS", 3)
    monkeypatch.setattr(order, "TOP_K_LIMIT", 5)


def made(spark, n=900):
    rng = random.Random(7)
    rows = [
        (rng.choice([None, 1.5, float("nan"), -0.0, 0.0, rng.random()]), rng.choice([None, "", "é", "a'b", "z"]),
         rng.choice([None, datetime.date(2024, 1, rng.randrange(1, 28))]), Decimal(rng.randrange(5)) / 4, rng.randrange(40))
        for _ in range(n)
    ] + [(2.0, "same", None, Decimal(1), 3)] * (n // 3)
    return spark.createDataFrame(rows, "x double, s string, d date, m decimal(10,2), i int").repartition(5)


def told(r):
    return str(tuple(r)).replace("-0.0", "0.0")  # the two zeros are equal in an order


ORDERS = [["x"], [("s", "desc"), "x"], [("d", "desc"), ("m", "asc"), ("i", "desc")], ["i", "s", "d", "x", "m"]]


@pytest.mark.parametrize("order_by", ORDERS)
def test_first_last_and_nth_are_those_of_a_sort(spark, small, order_by):
    df = made(spark)
    whole = [told(r) for r in df.orderBy(*order.total_order(df, order_by)).collect()]
    for n in (301, 650, 1200):
        assert [told(r) for r in order.keep_first_n(df, n, order_by).collect()] == whole[:n]
        assert [told(r) for r in order.keep_last_n(df, n, order_by).collect()] == whole[-n:]
    narrow = [str(r["i"]) for r in df.select(*dict.fromkeys([c if isinstance(c, str) else c[0] for c in order_by] + ["i"]))
              .orderBy(*order.total_order(df.select(*dict.fromkeys([c if isinstance(c, str) else c[0] for c in order_by] + ["i"])),
                                          order_by)).collect()]
    for position in (7, 1200):
        assert str(order.index_at(df, "i", position, order_by).first()[0]) == narrow[position - 1]
    assert order.index_at(df, "i", 1201, order_by).first()[0] is None


def test_the_table_is_neither_sorted_nor_written(spark, folder, small, monkeypatch):
    monkeypatch.setattr(order, "write_out", None)
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_extendedprice", "l_orderkey")
    found = order.keep_first_n(df, 2500, ["l_extendedprice"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Filter") < plan.index("FileScan")
    assert found.count() == 2500
    assert selection.row_at(df, selection.order_keys(df, ["l_extendedprice"]), 10**9) is None
    worst = found.agg(F.max("l_extendedprice")).first()[0]
    assert df.where(F.col("l_extendedprice") < worst).count() < 2500 <= df.where(F.col("l_extendedprice") <= worst).count()
