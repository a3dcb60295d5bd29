"""Exact quantiles against pandas; sketches within their error."""

import random

import pandas as pd
import pytest

from tidymill.operators import aggregate, clean, quantiles


def made(n=6000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        g = rng.choice(["hot"] * 6 + ["a", "b", None])
        v = rng.choice([5.0, 5.0, 7.0, rng.gauss(0, 100), rng.gauss(0, 100), None, float("nan")]) if g == "hot" else rng.random()
        rows.append((g, v, i % 7))
    return rows + [("same", 1.5, 1)] * 900 + [("two", 1.0, 1)] * 500 + [("two", 2.0, 1)] * 500 + [("none", None, None)]


PROBS = [0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 1.0]


@pytest.mark.parametrize("most", [40, 1 << 18])  # by a distributed sort, and group by group
def test_quantiles_are_exact_on_either_side(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "GROUP_VALUES", most)
    rows = made()
    frame = pd.DataFrame(rows, columns=["g", "v", "w"])
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(6)
    got = {(r["g"], r["column"]): r["q"] for r in quantiles.exact_quantiles(df, ["v", "w"], PROBS, ["g"]).collect()}
    want = {}
    for g, part in frame.groupby("g", dropna=False):
        for c in ("v", "w"):
            if part[c].notna().any():
                want[None if pd.isna(g) else g, c] = list(part[c].quantile(PROBS))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key]), key
    assert quantiles.exact_quantiles(df, ["v"], [0.5]).first()["q"][0] == pytest.approx(frame["v"].median())
    assert quantiles.exact_quantiles(df.limit(0), ["v"], [0.5]).collect() == []


def test_sketches_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id % 3 AS g", "CAST(pow(id % 66667, 1.5) AS double) AS v")
    frame = df.toPandas()
    for row in quantiles.sketched_quantiles(df, ["v"], [0.25, 0.5, 0.9], ["g"]).collect():
        part = frame[frame["g"] == row["g"]]["v"]
        for p, value in zip([0.25, 0.5, 0.9], row["q"]):
            assert abs((part <= value).mean() - p) <= quantiles.FINE_RANK_ERROR
    medians = {r["g"]: r["v"] for r in aggregate.group_aggregate(df, "g", "v", "median", approx=True).collect()}
    for g, part in frame.groupby("g")["v"]:
        assert abs((part <= medians[g]).mean() - 0.5) <= quantiles.FINE_RANK_ERROR
    low, high = clean.iqr_limits(df, "v", approx=True)
    exact = clean.iqr_limits(df, "v")
    assert low == pytest.approx(exact[0], rel=0.05) and high == pytest.approx(exact[1], rel=0.05)
