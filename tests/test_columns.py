import pytest

from tidymill.functions import dates
from tidymill.functions.dates import spark_pattern
from tidymill.functions.text import java_replacement
from tidymill.operators import columns as c


def test_parse_br_number(one, values):
    df = one(["1.234,56", "1234,56", "1234.56", " 1 234,5 ", "", "abc", None, "1d", "-0,5"])
    assert values(c.parse_br_number(df, ["v"])) == [1234.56, 1234.56, 1234.56, 1234.5, None, None, None, None, -0.5]


def test_format_br_number(one, values):
    df = one([1234567.89, 0.5, None, 0.125], "double")
    assert values(c.format_br_number(df, ["v"])) == ["1.234.567,89", "0,50", None, "0,12"]
    texts = one(["1.234,56", "x"])
    assert values(c.format_br_number(texts, ["v"])) == ["1.234,56", None]


def test_format_then_parse_is_identity(one, values):
    numbers = [0.0, 1.25, -9876543.21, 1e7, 999999.99]
    df = one(numbers, "double")
    assert values(c.parse_br_number(c.format_br_number(df, ["v"]), ["v"])) == numbers


def test_text_to_number(one, values):
    assert values(c.text_to_number(one(["1.234,56", "x", None]), "v")) == [1234.56, None, None]
    assert values(c.text_to_number(one([1234.56, float("nan")], "double"), "v")) == [1234.56, None]


def test_text_slices(one):
    df = one(["abcdef", None])
    for result, expected in (
        (c.left_text(df, "v", 2, "r"), "ab"), (c.right_text(df, "v", 2, "r"), "ef"),
        (c.mid_text(df, "v", 2, 3, "r"), "bcd"), (c.text_length(df, "v", "r"), 6),
        (c.right_text(df, "v", 0, "r"), ""), (c.substitute_text(df, "v", "cd", ".", "r"), "ab.ef"),
    ):
        assert [r["r"] for r in result.orderBy("id").collect()] == [expected, None]
    with pytest.raises(ValueError):
        c.mid_text(df, "v", 0, 1)


def test_round_half_even(one):
    df = one([2.5, 0.125, float("nan"), None], "double")
    assert [r["v_arred"] for r in c.round_number(df, "v").orderBy("id").collect()] == [2.0, 0.0, None, None]
    assert [r["v_arred"] for r in c.round_number(df, "v", 2).orderBy("id").collect()] == [2.5, 0.12, None, None]


def test_number_to_text(one):
    df = one([1234.5, None, 0.256], "double")
    for mask, expected in (("{:,.2f}", ["1,234.50", "", "0.26"]), ("{:.1%}", ["123450.0%", "", "25.6%"]),
                           ("{:.0f} un", ["1234 un", "", "0 un"])):
        assert [r["v_formatado"] for r in c.number_to_text(df, "v", mask).orderBy("id").collect()] == expected
    whole = one([7, None], "bigint")
    assert [r["v_formatado"] for r in c.number_to_text(whole, "v", "{:05d}").orderBy("id").collect()] == ["00007", ""]
    with pytest.raises(ValueError):
        c.number_to_text(df, "v", "{:>10}")


def test_trim_takes_all_unicode_space(one, values):
    assert values(c.upper_trim_text(one(["  ana \t", " é", None]), ["v"])) == ["ANA", "É", None]
    assert values(c.lower_trim_text(one([" AnA "]), ["v"])) == ["ana"]


def test_concat_keeps_separators(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "x string, y string, z double")
    assert c.concat_columns(df, ["x", "y", "nope", "z"], "-").first()["concat"] == "a--1.0"


def test_float_text(one, values):
    df = one([10000000.0, 1.5, 12345678.9, 0.0005, None], "double")
    assert values(c.cast_text(df, ["v"])) == ["10000000.0", "1.5", "12345678.9", "0.0005", None]


def test_regex(one, values):
    assert java_replacement(r"\2 $ \1") == r"$2 \$ $1"
    assert values(c.replace_regex(one(["ab12"]), ["v"], r"([a-z]+)(\d+)", r"\2\1")) == ["12ab"]
    found = c.extract_regex(one(["ab12", "zz", None]), ["v"], r"(\d+)", "n")
    assert [r["n"] for r in found.orderBy("id").collect()] == ["12", None, None]


def test_dates(one, values):
    assert spark_pattern("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"
    df = one(["2020-01-05", "5/1/2020", "2020-01-05 10:11:12", "31/02/2020", "x", None])
    got = [str(v) if v else None for v in values(c.cast_date(df, ["v"]))]
    assert got == ["2020-01-05 00:00:00", "2020-01-05 00:00:00", "2020-01-05 10:11:12", None, None, None]
    assert values(c.format_dates(df, ["v"]))[:2] == ["05/01/2020", "05/01/2020"]


def test_dates_in_a_gap_of_the_zone(spark, one, values):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = one(["04/11/2018", "2018-11-04 00:30:00", "4 Nov 2018", "30/02/2018"])
        got = [str(v) if v else None for v in values(c.cast_date(df, ["v"], [*dates.DATE_FORMATS, "d MMM yyyy"]))]
        assert got == ["2018-11-04 00:00:00", "2018-11-04 00:30:00", "2018-11-04 00:00:00", None]
        assert values(c.format_dates(df, ["v"]))[0] == "04/11/2018"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_float_text_keeps_all_digits(one, values):
    df = one([0.00012345678901234567, 0.0001234567890123457, -0.0001, 0.00025, 12345678.901234567], "double")
    assert values(c.cast_text(df, ["v"])) == [
        "0.00012345678901234567", "0.0001234567890123457", "-0.0001", "0.00025", "12345678.901234567"]


def test_date_formats_with_letters(one, values):
    df = one(["05 Jan 2020", "5.1.2020", "2020-01-05T01:02:03"])
    got = values(c.cast_date(df, ["v"], ["dd MMM yyyy", "d.M.yyyy", "yyyy-M-d'T'HH:mm:ss"]))
    assert [str(v) for v in got] == ["2020-01-05 00:00:00", "2020-01-05 00:00:00", "2020-01-05 01:02:03"]


def test_expression_with_aggregate(one):
    df = one([1.0, 2.0, 6.0], "double")
    out = c.add_expression_column(df, "d", "v - m", {"m": "avg(v)"})
    assert out.columns == ["id", "v", "d"]
    assert [r["d"] for r in out.orderBy("id").collect()] == [-2.0, -1.0, 3.0]
    with pytest.raises(ValueError):
        c.add_expression_column(df, "d", "sum(v) over ()")


def test_if_else(one):
    df = one([5, None, 1], "int")
    out = c.if_else(df, "v > 2", "hi", 0)
    assert [r["resultado_se"] for r in out.orderBy("id").collect()] == ["hi", "0", "0"]


def test_column_order_and_names(one):
    df = one(["a"])
    assert c.reorder_columns(df, ["v", "zz", "v"]).columns == ["v", "id"]
    assert c.rename_columns(df, {"v": "w", "zz": "y"}).columns == ["id", "w"]
    assert c.drop_columns(df, ["zz", "v"]).columns == ["id"]
    assert [c.snake_case(n) for n in ("Nome da Escola", "Ano/Série (%)")] == ["nome_da_escola", "anoserie_"]
    with pytest.raises(ValueError):
        c.snake_case_columns(df.toDF("A b", "a  b"))


def test_names_with_dots(spark):
    df = spark.createDataFrame([(" x ",)], "`a.b c` string")
    assert c.upper_trim_text(df, ["a.b c"]).first()[0] == "X"


def test_criteria(one):
    df = one(["10", "11", " SIM", "sim ", None, "-7"])
    count = lambda crit, **k: c.filter_criterion(df, "v", crit, **k).count()
    assert count(">10") == 1 and count("<=10") == 2 and count(">-5") == 2 and count(" sim ") == 2
    assert count("!=sim") == 3 and count("!=sim", null_matches_ne=True) == 4 and count(10) == 1
    numbers = one([3.0, 4.0, None], "double")
    assert c.filter_criterion(numbers, "v", "!=3").count() == 1
    assert c.filter_criterion(numbers, "v", "3").count() == 1
