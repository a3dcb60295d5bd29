"""What a scan leaves to the end, and what it asks the driver for."""

from pyspark.sql import functions as F

from tidymill.operators import components, fuzzy, profile


def test_issues_of_other_checks_are_ready_before_the_end(spark, monkeypatch):
    """All that spellings do not need is written as issues, so the last step only adds those of spellings."""
    written, write_out = {}, profile.write_out

    def kept(df, label):
        written[label] = write_out(df, label)
        return written[label]

    monkeypatch.setattr(profile, "write_out", kept)
    df = spark.range(60).selectExpr("id", "IF(id % 9 = 0, 'n/a', concat('name ', id % 5)) AS name")
    issues = profile.scan_table(df)
    found = {r["category"] for r in issues.collect()}
    assert {r["category"] for r in written["issues"].collect()} == found - {"FUZZY_MATCH"} and "FUZZY_MATCH" in found
    assert "Range" not in issues._jdf.queryExecution().optimizedPlan().toString()  # the rows themselves


def test_a_summary_sorts_nothing(spark):
    df = spark.range(60).selectExpr("id", "IF(id % 9 = 0, 'n/a', concat('name ', id % 5)) AS name")
    issues = profile.scan_table(df)
    summary = profile.issue_summary(issues)
    assert "Sort" not in summary._jdf.queryExecution().optimizedPlan().toString()
    rows = issues.collect()
    want = {("total", "total"): len(rows)}
    for r in rows:
        for kind in ("severity", "category"):
            want[kind, r[kind]] = want.get((kind, r[kind]), 0) + 1
    assert {(r["kind"], r["name"]): r["n"] for r in summary.collect()} == want
    assert profile.issue_summary(issues.where("false")).count() == 0


def test_sizes_of_largest_nodes_are_not_written(spark, monkeypatch):
    labels, write_out = [], fuzzy.write_out
    monkeypatch.setattr(fuzzy, "write_out", lambda df, label: labels.append(label) or write_out(df, label))
    odd = ["AB'\"\\", "ABé", "X😀", "X😀Y", "Q"]
    values = spark.createDataFrame([(c, v, 1) for c in ("c", "d 'é\"") for v in odd], "column string, value string, n int")
    found = sorted((r["column"], r["members"]) for r in fuzzy.group_sizes(values).collect())
    assert found == [(c, n) for c in ("c", "d 'é\"") for n in (1, 2, 2)]
    assert "places" in labels and "rest" in labels and "largest" not in labels


def test_few_components_become_part_of_the_plan(spark, monkeypatch):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("é'\"", "😀\\")], "a string, b string")
    want = {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("é'\"", "é'\""), ("😀\\", "é'\"")}
    for listed, scans in ((components.LISTED_ROWS, 0), (2, 1)):
        monkeypatch.setattr(components, "LISTED_ROWS", listed)
        got = components.connected_components(df, few=10)
        assert {tuple(r) for r in got.collect()} == want
        assert got._jdf.queryExecution().analyzed().toString().lower().count("relation [") - got._jdf.queryExecution().analyzed().toString().count("OneRowRelation [") == scans
    assert components.small_table(spark, [], "x:int").count() == 0
    assert components.small_table(spark, [{"x": 1}], "x:int").select(F.sum("x")).first()[0] == 1


def test_texts_of_numbers_count_as_before_without_being_tried(spark):
    """Digits are upper, lower and title case alike and hold no inner spaces, also before line ends."""
    cells = ["12", "-1,5", " 7\r\n", "7.5  ", "8\x85\x85", "7  7", "7\n\n7", "AB", "ab", "Ab  C", "٣", "1.", ""]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    got = profile.column_metrics(df, text=True).first()
    texts = [c.strip() for c in cells]
    assert got["n_numeric"] == 5 and got["n_inner"] == 3
    assert got["n_upper"] == sum(t == t.upper() for t in texts) and got["n_lower"] == sum(t == t.lower() for t in texts)
    assert got["n_title"] == sum(t == t.title() for t in texts)
