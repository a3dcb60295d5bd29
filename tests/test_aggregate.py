import math
import random

import numpy as np
import pandas as pd
import pytest

from tidymill.operators import aggregate, clean, correlation, quantiles


def scalar(df):
    return df.first()[0]


def test_sum_if_and_count_if(spark):
    df = spark.createDataFrame([("Sim ", 1.0), ("sim", None), ("nao", 4.0), (None, 8.0)], "c string, v double")
    assert scalar(aggregate.sum_if(df, "v", "c", " SIM ")) == 1.0
    assert scalar(aggregate.sum_if(df, "v", "v", ">=4")) == 12.0
    assert scalar(aggregate.sum_if(df, "v", "c", "talvez")) == 0.0
    assert scalar(aggregate.count_if(df, "c", "!=sim")) == 1


def test_harmonic_mean(one):
    df = one([1.0, 2.0, 4.0, 0.0, -3.0, None], "double")
    assert scalar(aggregate.harmonic_mean(df, "v")) == pytest.approx(3 / 1.75)
    assert scalar(aggregate.harmonic_mean(one([-1.0, None], "double"), "v")) == 0.0


def test_empty_columns_aggregate(one):
    df = one(["x", None])
    assert scalar(aggregate.col_sum(df, "v")) == 0.0
    assert scalar(aggregate.col_max(df, "v")) is None
    assert aggregate.column_stats(df, "v").first()["n"] == 0


def test_group_functions_match_pandas(spark):
    random.seed(1)
    rows = [(random.choice("abc"), random.choice([1.0, 2.0, 3.5, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    frame = pd.DataFrame(rows, columns=["g", "v"])
    for func in ("sum", "mean", "count", "min", "max", "median", "std", "var", "nunique"):
        got = {r["g"]: r["v"] for r in aggregate.group_aggregate(df, "g", "v", func).collect()}
        want = frame.groupby("g")["v"].agg(func).to_dict()
        assert got == pytest.approx(want)


def test_first_and_last_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None)], "g string, o int, v string")
    assert aggregate.group_aggregate(df, "g", "v", "first", ["o"]).first()["v"] == "x"
    assert aggregate.group_aggregate(df, "g", "v", "last", ["o"]).first()["v"] == "y"


def test_quantiles(spark):
    random.seed(2)
    rows = [(random.choice(["a", "b", None]), random.choice([None, 1.0, 7.0, random.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    frame = pd.DataFrame(rows, columns=["g", "v"])
    got = quantiles.exact_quantiles(df, ["v"], [0.1, 0.25, 0.5]).first()["q"]
    assert got == pytest.approx(list(frame["v"].quantile([0.1, 0.25, 0.5])))
    grouped = quantiles.exact_quantiles(df, ["v"], [0.25, 0.5], ["g"]).collect()
    want = frame.groupby("g", dropna=False)["v"].quantile([0.25, 0.5])
    for row in grouped:
        key = row["g"] if row["g"] is not None else np.nan
        part = frame[frame["g"].isna()] if row["g"] is None else frame[frame["g"] == key]
        assert row["q"] == pytest.approx(list(part["v"].quantile([0.25, 0.5])))
    assert len(grouped) == len(want) / 2


def tau_b(a, b):
    agree = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(len(a)) for j in range(i))
    na = sum(a[i] != a[j] for i in range(len(a)) for j in range(i))
    nb = sum(b[i] != b[j] for i in range(len(b)) for j in range(i))
    return agree / math.sqrt(na * nb)


def test_correlations(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, 150).astype(float), rng.integers(0, 9, 150).astype(float)
    b = b + a / 3
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    ranks = pd.DataFrame({"a": a, "b": b}).rank()
    assert scalar(correlation.corr_pearson(df, "a", "b")) == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert scalar(correlation.corr_spearman(df, "a", "b")) == pytest.approx(ranks.corr().iloc[0, 1])
    for block_rows in (10**6, 40, 7):
        assert scalar(correlation.corr_kendall(df, "a", "b", block_rows=block_rows)) == pytest.approx(tau_b(a, b))


def test_correlation_corner_cases(spark):
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    single = same.limit(1)
    for method in ("pearson", "spearman", "kendall"):
        assert scalar(correlation.correlate(same, "a", "b", method)) is None
        assert scalar(correlation.correlate(single, "a", "b", method)) == 0.0


def test_concordant_weight_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        x, y, w = rng.integers(0, 8, n), rng.integers(0, 8, n), rng.integers(1, 4, n)
        want = sum(w[p] * w[q] for p in range(n) for q in range(n) if x[q] < x[p] and y[q] < y[p])
        assert correlation.concordant_weight(x, y, w) == want


def test_fill_nulls(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", float("nan")), ("b", 3.0), ("a", None), (None, 8.0)], "v string, x double")
    assert [r["v"] for r in clean.fill_null_mode(df, ["v"]).where("x = 8").collect()] == ["a"]
    filled = clean.fill_null_median(df, ["x"]).select("x").collect()
    assert sorted(r["x"] for r in filled) == [1.0, 3.0, 3.0, 3.0, 8.0]
    steps = clean.fill_nulls(df, {"v": "moda", "x": 0.0, "nope": "moda"})
    assert steps.where("v is null or x is null").count() == 0
    assert clean.fill_nulls(df, {"v": "remover_linha", "x": "remover_linha"}).count() == 2
    with pytest.raises(TypeError):
        clean.fill_null_constant(df, {"x": "text"})


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, 2), (1, 3, 2), (1, 3, 2)], "a int, b int, c int")
    assert clean.drop_empty_columns(df, 0.5).columns == ["a", "c"]
    assert clean.drop_empty_columns(df).columns == ["a", "b", "c"]
    assert clean.drop_empty_columns(df.limit(0)).columns == ["a", "b", "c"]


def test_unify_values(one, values):
    df = one(["sp ", "S. PAULO", "RJ", None])
    assert values(clean.unify_values(df, "v", {"SAO PAULO": ["SP", "S. Paulo"]})) == ["SAO PAULO", "SAO PAULO", "RJ", None]
    chained = {"SP": ["s. paulo"], "SAO PAULO": ["SP"]}
    assert values(clean.unify_values(df, "v", chained)) == ["SAO PAULO", "SAO PAULO", "RJ", None]


def test_replace_values(one, values):
    df = one(["n/a ", "N/A", "x", None])
    assert values(clean.replace_values(df, ["v"], {"N/A": ""})) == ["n/a ", "", "x", None]
    assert values(clean.replace_values(df, ["v"], {"N/A": ""}, normalise=True)) == ["", "", "x", None]
    table = df.sparkSession.createDataFrame([("x", None), ("N/A", "z")], "old string, new string")
    assert values(clean.replace_values(df, ["v"], table)) == ["n/a ", "z", None, None]


def test_outliers(one):
    df = one([1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None], "double")
    assert [r["v"] for r in clean.outliers_iqr(df, "v").collect()] == [100.0]
    assert clean.outliers_iqr(df.where("v is null"), "v").count() == 0


def test_count_distinct_treats_nan_as_null(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, None), (float("nan"), "a")], "x double, s string")
    got = {r["column"]: r["n_distinct"] for r in aggregate.group_count_distinct(df).collect()}
    assert got == {"x": 1, "s": 1}
    empty = {r["column"]: r["n_distinct"] for r in aggregate.group_count_distinct(df.limit(0)).collect()}
    assert empty == {"x": 0, "s": 0}


def test_distinct_values_of_all_kinds(spark):
    """Numbers are counted as numbers; their texts, zeros, NaN and nulls are as before."""
    df = spark.sql("""SELECT * FROM VALUES
        (1, -0.0D, 'a', 1.50BD, float('0.1')), (1, 0.0D, NULL, 1.50BD, float('nan')),
        (NULL, double('NaN'), 'a', NULL, NULL), (-7, 1e20D, '1', 2.00BD, float('0.1')) AS t(i, x, s, d, f)""")
    got = {(r["column"], r["value"], r["n"]) for r in aggregate.distinct_values(df, df.columns).collect()}
    assert got == {
        ("i", "1", 2), ("i", "-7", 1), ("x", "0.0", 2), ("x", "1.0E20", 1), ("s", "a", 2), ("s", "1", 1),
        ("d", "1.50", 2), ("d", "2.00", 1)} | {r for r in got if r[0] == "f"}
    assert {n for c, _, n in got if c == "f"} == {2}
