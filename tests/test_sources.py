import glob
from datetime import datetime

import pytest

from tidymill.sources import columnar, delimited, reporting


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("name,text,encoding,expected", [
    ("semi", "id;nome\n1;José\n", "utf-8", (delimited.UTF8, ";")),
    ("comma", "id,nome\n1,José\n", "utf-8", (delimited.UTF8, ",")),
    ("latin", "id;nome\n1;José\n", "latin-1", (delimited.LATIN1, ";")),
    ("late", "id;nome\n" + "1;abc\n" * 50000 + "2;José\n", "latin-1", (delimited.LATIN1, ";")),
    ("tab", "id\tnome\n1\tx\n", "utf-8", (delimited.UTF8, "\t")),
    ("pipe", "id|nome\n1|x\n", "utf-8", (delimited.UTF8, "|")),
    ("bom", "﻿id;nome\n1;x\n", "utf-8", (delimited.UTF8, ";")),
    ("single", "id\n1\n2\n", "utf-8", (delimited.UTF8, ";")),
    ("quoted", '"a;b",c\n1,2\n', "utf-8", (delimited.UTF8, ",")),
])
def test_detect(spark, tmp_path, name, text, encoding, expected):
    fmt = delimited.detect_format(spark, write(tmp_path / f"{name}.csv", text, encoding))
    assert (fmt.encoding, fmt.separator) == expected


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.detect_format(spark, write(tmp_path / "e.csv", ""))


def test_scan_names_ragged_lines_and_types(spark, tmp_path):
    path = write(tmp_path / "r.csv", "﻿ id ; nome;\n01;a;x\n2;b;y;extra\nz;c\n")
    df = delimited.scan(spark, path)
    assert df.columns == ["id", "nome", "_c2"]
    assert [tuple(r) for r in df.collect()] == [("01", "a", "x"), ("2", "b", "y"), ("z", "c", None)]
    assert delimited.list_columns(spark, path) == ["id", "nome", "_c2"]
    typed = delimited.scan(spark, path, ["id"], {"id": "numero"})
    assert [r["id"] for r in typed.collect()] == [1.0, 2.0, None]
    codes = delimited.scan(spark, write(tmp_path / "t.csv", "id;n\n01;1\n02;2\n"), types={"id": "texto"})
    assert [tuple(r) for r in codes.collect()] == [("01", 1), ("02", 2)]


def test_latin1_content(spark, tmp_path):
    path = write(tmp_path / "l.csv", "id;nome\n1;Educação\n", "latin-1")
    assert delimited.scan(spark, path).first()["nome"] == "Educação"


def test_bi_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "Educação")], "`Código` int, `Nome da Escola` string")
    path = reporting.write_bi_csv(df, str(tmp_path), "aprovacao", datetime(2024, 1, 2, 3, 4))
    assert path.endswith("aprovacao_20240102_0304.csv")
    raw = open(glob.glob(path + "/part-*")[0], "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfcodigo,nome_da_escola")
    assert delimited.scan(spark, path).columns == ["codigo", "nome_da_escola"]
    with pytest.raises(Exception):
        reporting.write_bi_csv(df, str(tmp_path), "aprovacao", datetime(2024, 1, 2, 3, 4))


def test_parquet(spark, tmp_path):
    path = columnar.write(spark.range(100).coalesce(1), str(tmp_path / "p"), "gzip", max_rows_per_file=30)
    assert len(glob.glob(path + "/*.gz.parquet")) == 4
    info = columnar.table_info(spark, path).first()
    assert (info["files"], info["rows"], info["columns"], info["schema"]) == (4, 100, 1, "id bigint")
    got = columnar.scan(spark, path, ["id"], [("id", ">", 97), ("id", "!=", 98)])
    assert [r["id"] for r in got.collect()] == [99]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,97)" in plan
    sizes = columnar.map_batches(spark.range(25).coalesce(1), lambda f: f.assign(id=len(f)).head(1), "id bigint", 10)
    assert [r["id"] for r in sizes.collect()] == [10, 10, 5]
    with pytest.raises(ValueError):
        columnar.write(spark.range(1), str(tmp_path / "q"), "lzma")


def test_convert(spark, tmp_path):
    source = write(tmp_path / "c.csv", "id;nome\n1;José\n", "latin-1")
    target = columnar.convert_delimited(spark, source, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(1, "José")]


def test_preview(spark):
    df = spark.createDataFrame([(2, None), (1, 10000000.0)], "id int, x double")
    assert [tuple(r) for r in reporting.preview(df, ["id"]).collect()] == [("1", "10000000.0"), ("2", "")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'id;nome;v\n1;"duas\nlinhas; com ""aspas""";10\n2;x;20\n')
    fmt = delimited.detect_format(spark, path)
    assert fmt.multi_line and fmt.separator == ";"
    assert [tuple(r) for r in delimited.scan(spark, path).collect()] == [(1, 'duas\nlinhas; com "aspas"', 10), (2, "x", 20)]
    assert not delimited.detect_format(spark, write(tmp_path / "p.csv", 'id;n\n1;"a;b"\n')).multi_line


def test_written_line_breaks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'c "d", e')], "id int, n string")
    path = reporting.write_bi_csv(df, str(tmp_path), "x")
    assert sorted(tuple(r) for r in delimited.scan(spark, path).collect()) == [(1, "a\nb"), (2, 'c "d", e')]


def test_separators_of_the_first_file(spark, tmp_path):
    for k in range(8):
        write(tmp_path / f"f{k}.csv", ("a,b,c\n" if k == 0 else "x|y\n") * 9)
    counts = {r["separator"]: r["n"] for r in delimited.count_separators(spark, str(tmp_path)).collect()}
    assert counts == {";": 0, ",": 10, "\t": 0, "|": 0}


def test_batches_of_the_asked_size(spark):
    df = spark.range(0, 25_000, 1, 1)
    sizes = columnar.map_batches(df, lambda f: f.iloc[:1].assign(id=len(f)), "id bigint", 12_000)
    assert sorted(r["id"] for r in sizes.collect()) == [1000, 12_000, 12_000]
