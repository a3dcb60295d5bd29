import random

import pytest
from pyspark.sql import functions as F

from tidymill.operators import dedup, order


def test_positions(spark, one):
    df = one(["x", "y", "x", "y"])
    assert sorted(r["position"] for r in order.match_positions(df, "y", "v", ["id"]).collect()) == [1, 3]
    assert order.match_positions(df, "y", "v", ["id"], first=True).first()[0] == 1
    assert order.match_positions(df, "z", "v", ["id"], first=True).first()[0] is None
    assert order.index_at(df, "v", 2, ["id"]).first()[0] == "y"
    assert order.index_at(df, "v", 9, ["id"]).first()[0] is None
    assert order.index_at(df, "v", 0, ["id"]).first()[0] is None


def test_global_row_index_with_ties_and_nulls(spark):
    random.seed(4)
    rows = [(i, random.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = order.global_row_index(df, [("v", "desc"), "id"], partitions=5).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["row_index"])] == want


def test_large_n_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("k"), F.col("id").alias("x"))
    small = [order.keep_first_n(df, 40, ["k"]).collect(), order.keep_last_n(df, 40, ["k"]).collect(),
             order.index_at(df, "x", 100, ["k"]).collect()]
    monkeypatch.setattr(order, "TOP_K_LIMIT", 5)
    assert [order.keep_first_n(df, 40, ["k"]).collect(), order.keep_last_n(df, 40, ["k"]).collect(),
            order.index_at(df, "x", 100, ["k"]).collect()] == small
    assert [r["k"] for r in small[1]] == list(range(260, 300))


def test_sort_nulls_last_both_ways(one):
    df = one([2, None, 1], "int")
    assert [r["v"] for r in order.sort_rows(df, ["v"]).collect()] == [1, 2, None]
    assert [r["v"] for r in order.sort_rows(df, ["v", "zz"], ascending=False).collect()] == [2, 1, None]


def test_running_total_and_rank(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,), (2.0,)], "v double")
    got = sorted((r["v"], r["rank"]) for r in order.average_rank(df, "v").collect() if r["v"])
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_order_by_is_needed(one):
    with pytest.raises(ValueError):
        order.keep_first_n(one(["a"]), 1, [])


def test_mark_duplicates(one):
    df = one(["Ana", " ana ", "Bia", None, None])
    marked = dedup.mark_duplicates(df, ["id"]).orderBy("id").collect()
    assert [r["_duplicata"] for r in marked] == [False, True, False, False, True]
    exact = dedup.mark_duplicates(df, ["id"], ["v"], normalise=False).orderBy("id").collect()
    assert [r["_duplicata"] for r in exact] == [False, False, False, False, True]


def test_mark_and_drop_agree(spark):
    random.seed(6)
    rows = [(i % 50, i, random.choice(["a", "A ", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id int, v string")
    kept = dedup.drop_duplicates_normalized(df, ["id"], ["g", "v"])
    marked = dedup.mark_duplicates(df, ["id"], ["g", "v"]).where(~F.col("_duplicata")).drop("_duplicata")
    assert sorted(kept.collect(), key=str) == sorted(marked.collect(), key=str)
    assert kept.columns == df.columns


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 3)], "k string, id int")
    assert sorted(map(tuple, dedup.drop_duplicates_exact(df, ["k"], ["id"]).collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, dedup.drop_duplicates_keep_last(df, ["id"], ["k"]).collect())) == [("a", 3), ("b", 3)]
    assert dedup.count_duplicate_rows(df.unionAll(df.limit(1))).first()[0] == 1
