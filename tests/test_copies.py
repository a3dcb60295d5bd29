"""Equal rows by digests."""

from pyspark.sql import functions as F

from tidymill.operators import copies, dedup, lineage, profile, validate

ROWS = [(1, "a", 1.0), (1, "a", 1.0), (None, "a", 0.0), (None, "a", -0.0), (1, None, float("nan")), (1, None, float("nan")),
        (None, "x", None), (None, None, None), (2, "x", None)]


def counted(df, **kw):
    rows, repeated = copies.count_copies(df, **kw)
    return tuple(df.sparkSession.range(1).select(rows, repeated).first())


def test_copies_are_those_of_grouping(spark):
    df = spark.createDataFrame(ROWS, "i int, s string, d double")
    by_groups = df.groupBy(*df.columns).count()
    want = (len(ROWS), len(ROWS) - by_groups.count())
    assert counted(df) == want == (9, 3)
    assert dedup.count_duplicate_rows(df).first()[0] == 3
    assert counted(df.limit(0)) == (0, 0)
    moved = spark.createDataFrame([(None, "x"), ("x", None), (None, None), ("", None), (None, "")], "a string, b string")
    assert counted(moved) == (5, 0)


def test_unlike_rows_with_one_digest_stay_apart(spark):
    df = spark.createDataFrame(ROWS, "i int, s string, d double")
    assert counted(df, digests=lambda df: [F.lit(7).cast("long"), F.lit(9).cast("long")]) == (9, 3)


def test_what_is_shuffled_does_not_grow_with_the_row(spark, tmp_path):
    spark.range(2000).select("id", F.repeat(F.lit("wide"), 500).alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows, repeated = copies.count_copies(df)
    result = spark.range(1).select(rows, repeated)
    assert tuple(result.first()) == (2000, 0)
    plan = result._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert any("__digest0" in line and "text" not in line for line in exchanges)
    # Whole rows are grouped below a join with the digests that occur twice.
    wide = plan[plan.index(next(line for line in exchanges if "text" in line)):]
    assert "LeftSemi" in wide


def test_maps_are_grouped_whole(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 1 AS i UNION ALL SELECT map('a', 1), 1 UNION ALL SELECT map('a', 2), 1")
    assert counted(df) == (3, 1)


def test_snapshot_with_bytes(spark, folder):
    df = spark.read.parquet(f"{folder}/nation.parquet")
    found = {r["metric"]: r["value"] for r in lineage.initial_snapshot(df, sizes=True).where("column IS NULL").collect()}
    assert found["rows"] == "25" and int(found["bytes"]) > 500 and found["duplicates"] == "0"
    made = spark.createDataFrame([(1,)], "i int")
    assert {r["metric"]: r["value"] for r in lineage.initial_snapshot(made, sizes=True).collect()}["bytes"] is None
    assert validate.validate_table(df, ["n_name"], 3).where("NOT passed").isEmpty()
    assert profile.profile_row_duplicates(df.union(df.limit(2))).first()["n_rows"] == 2
