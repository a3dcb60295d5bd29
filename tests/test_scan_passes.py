"""What a scan writes and shuffles on the way."""

from pyspark.sql import functions as F

from tidymill.operators import copies, fuzzy, profile


def table(spark):
    """A number column, a code, and amounts as text with a few words; one row comes twice."""
    rows = spark.range(400).selectExpr(
        "id", "id % 7 AS few", "CAST(id AS double) / 8 AS part", "DATE'2024-01-01' AS day",
        "CASE WHEN id % 50 = 0 THEN 'n/a' ELSE CAST(100 + id AS string) END AS amount")
    return rows.union(rows.limit(1))


def test_a_scan_writes_the_values_of_texts_only(spark, monkeypatch):
    written, write_out = {}, profile.write_out

    def kept(df, label):
        written[label] = write_out(df, label)
        return written[label]

    monkeypatch.setattr(profile, "write_out", kept)
    found = {(r["category"], r["column"]): r["n_rows"] for r in profile.scan_table(table(spark)).collect()}
    columns = {r["column"] for label in ("scan-values", "values") for r in written[label].select("column").collect()}
    assert columns == {"amount", "day"}
    assert all(written[label].count() <= 5 for label in ("number-metrics", "text-metrics", "copies", "digests"))
    assert found == {
        ("DUPLICATAS", profile.ALL_COLUMNS): 1, ("DUPLICATA_COLUNA", "few"): 394, ("DUPLICATA_COLUNA", "day"): 400,
        ("TIPO_NUMERO_TEXTO", "id"): 400, ("TIPO_TEXTO_NUMERO", "amount"): 392, ("TEXTO_CASO", "amount"): 392,
        ("VALOR_SUSPEITO", "amount"): 9, ("FUZZY_MATCH", "amount"): 392}


def test_sizes_of_groups_come_from_a_small_table(spark, monkeypatch):
    """The values are counted by their first characters once; the groups are put together from these counts."""
    written, write_out = {}, fuzzy.write_out

    def kept(df, label):
        written[label] = write_out(df, label)
        return written[label]

    monkeypatch.setattr(fuzzy, "write_out", kept)
    values = spark.range(100, 5000).select(F.lit("c").alias("column"), F.concat("id", F.lit(".5")).alias("value"), F.lit(2).alias("n"))
    values = values.union(spark.sql("SELECT 'c', 'XYZ', 1"))
    sizes = fuzzy.group_sizes(values)
    assert sorted((r["members"], r["n"]) for r in sizes.collect()) == [(1, 1), (4900, 9800)]
    assert written["places"].count() == 91 and written["places"].agg(F.sum("size")).first()[0] == 4901
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # the values themselves


def test_codes_tell_first_characters_apart(spark):
    texts = ["", "A", "AB", "ABC", "BA", "\0A", "A\0", "\0", "é", "😀", "😀A", "A😀", "\U0010ffff\U0010ffff\U0010ffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    codes = {r[0] for r in df.select(fuzzy._start_code(F.col("t"), 3)).collect()}
    assert len(codes) == len(texts) and min(codes) == 0


def test_kept_digests_change_no_count(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "b")]

    def keep(df):
        df.write.parquet(path)
        return spark.read.parquet(path)

    for i, same in enumerate((copies.digest_columns, lambda df: [F.lit(7).cast("long"), F.lit(9).cast("long")])):
        path = str(tmp_path / str(i))
        counts = copies.count_copies(spark.createDataFrame(rows, "i int, s string"), same, keep)
        assert tuple(spark.range(1).select(*counts).first()) == (6, 3)
    unlike = spark.createDataFrame([(None, "x"), ("x", None), (None, None)], "a string, b string")
    assert unlike.select(*copies.digest_columns(unlike)).distinct().count() == 3


def test_main_values_that_share_a_bigram_are_kept(spark):
    """Texts without any character of the others are left out; those with one are looked at by bigrams."""
    main = spark.createDataFrame(
        [("c", v, "m") for v in ("x😀y", "😀", "ab.", "ba", "123", "")] + [("d", "ab", "m")],
        "column string, value string, node string")
    rest = spark.createDataFrame([("c", v) for v in ("😀y", "b.", "")], "column string, value string")
    assert {tuple(r) for r in fuzzy._sharing(main, rest).collect()} == {("c", "x😀y", "m"), ("c", "ab.", "m")}
