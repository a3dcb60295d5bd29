import pytest
from pyspark.sql import functions as F

from tidymill.operators import lookup


@pytest.fixture
def tables(spark):
    table = spark.createDataFrame([(1,), (2,), (9,), (None,)], "k int")
    ref = spark.createDataFrame([(1, "a", 1), (2, "c", 3), (2, "b", 2), (None, "n", 4)], "k2 int, v string, ord int")
    return table, ref


def rows(df, *names):
    return sorted(((tuple(r[n] for n in names)) for r in df.collect()), key=str)


def test_first_match_by_order(tables):
    table, ref = tables
    out = lookup.vlookup(table, "k", ref, "k2", "v", "-", order_by=["ord"])
    assert rows(out, "k", "v_procv") == [(1, "a"), (2, "b"), (9, "-"), (None, "-")]
    safe = lookup.vlookup(table, "k", ref, "k2", "v", "-", order_by=["ord"], null_safe=True)
    assert rows(safe, "k", "v_procv") == [(1, "a"), (2, "b"), (9, "-"), (None, "n")]


def test_duplicate_policies(tables):
    table, ref = tables
    assert lookup.vlookup(table, "k", ref, "k2", "v", on_duplicate="all").count() == 5
    with pytest.raises(Exception, match="more than once"):
        lookup.vlookup(table, "k", ref, "k2", "v", on_duplicate="error").collect()
    with pytest.raises(ValueError):
        lookup.vlookup(table, "k", ref, "k2", "v", on_duplicate="some")


def test_default_that_does_not_fit_stays_null(tables):
    table, ref = tables
    out = lookup.vlookup(table, "k", ref, "k2", "ord", "", order_by=["ord"])
    assert rows(out, "k", "ord_procv") == [(1, 1), (2, 2), (9, None), (None, None)]


def test_lookup_aggregate(tables):
    table, ref = tables
    for func, expected in (("soma", 5), ("contagem", 2), ("media", 2.5), ("mediana", 2.5), ("min", 2), ("max", 3)):
        out = lookup.vlookup_agg(table, "k", ref, "k2", "ord", func)
        assert dict(rows(out, "k", f"ord_{func}"))[2] == expected
        assert dict(rows(out, "k", f"ord_{func}"))[9] is None


def test_index_match(spark):
    df = spark.createDataFrame([(1, 2, "A"), (2, None, "B"), (3, 7, "C")], "id int, boss int, name string")
    out = lookup.index_match_column(df, "name", "boss", "id", ["id"])
    assert rows(out, "id", "name_indice") == [(1, "B"), (2, None), (3, None)]
    assert rows(lookup.index_match_value(df, "name", 3, "id", ["id"]), "name_indice") == [("C",)] * 3
    assert rows(lookup.index_match_value(df, "name", 8, "id", ["id"]), "name_indice") == [(None,)] * 3


def test_joins_against_pandas(spark):
    import pandas as pd

    left = pd.DataFrame({"k": [1, 2, 2, 4], "x": [1, 2, 3, 4], "s": list("abcd")})
    right = pd.DataFrame({"k": [2, 2, 3], "s": list("efg")})
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    clean = lambda t: tuple(None if v is None or v != v else v for v in t)
    for how in ("inner", "left", "right", "outer"):
        want = left.merge(right, on="k", how=how)
        got = lookup.equi_join(l, r, "k", how)
        assert got.columns == list(want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(
            map(clean, want.astype(object).itertuples(index=False)), key=lambda t: str(
                tuple(int(v) if isinstance(v, float) else v for v in t)))


def test_null_keys_in_full_join(spark):
    l = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    r = spark.createDataFrame([(None, 3), (2, 4)], "k int, y int")
    assert lookup.equi_join(l, r, "k", "outer").count() == 3
    assert lookup.equi_join(l, r, "k", "outer", null_safe=True).count() == 2


def test_hot_key_is_split_and_rows_stay(spark):
    """A key with most rows: the adaptive skew join splits it, nothing is lost."""
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
        ref = spark.range(60000).select(F.col("id").alias("k2"), (F.col("id") * 2).alias("v"))
        out = lookup.vlookup(table, "k", ref, "k2", "v")
        result = out.agg(F.count("*"), F.sum("x"), F.count_if(F.col("v_procv") == F.col("k") * 2))
        assert tuple(result.collect()[0]) == (60000, sum(range(60000)), 60000)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionFactor")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for key, value in old.items():
            spark.conf.set(key, value)
