"""Quoted text with line breaks, read in splits, against Python's csv module and unsplit reading."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from tidymill.sources import columnar, delimited, records


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, n=60):
    rng = random.Random(seed)
    parts = ["a", "b;c", '"', "\n", "é", ",", "\n\n", ' "q" ', "x" * 150, ";", "\r\n", '""']
    return [(str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))), rng.choice(["y", "z;z", "w\nw"]))
            for i in range(n)]


def text_of(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", quoting=quoting, lineterminator=end)
    writer.writerow(["id", "body\nof text", "last"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,quoting,end", [
    (0, csv.QUOTE_MINIMAL, "\n"), (1, csv.QUOTE_ALL, "\n"), (2, csv.QUOTE_MINIMAL, "\r\n"), (3, csv.QUOTE_ALL, "\r\n"),
])
def test_records_over_many_splits(spark, tmp_path, small_splits, seed, quoting, end):
    rows = made(seed)
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_bytes(text_of(rows[20 * i : 20 * i + 20], quoting, end).encode())
    fmt = delimited.TextFormat(delimited.UTF8, ";", True)
    df = delimited.scan(spark, str(tmp_path), schema="id int, body string, last string", fmt=fmt)
    assert df.rdd.getNumPartitions() > 8  # in splits
    found = sorted(tuple(r) for r in df.collect())
    assert [(i, body or "", last) for i, body, last in found] == [(int(i), body, last) for i, body, last in rows]
    if end == "\n":  # unsplit reading leaves a return at the end of each record
        unsplit = spark.read.options(header=True, sep=";", escape='"', multiLine=True).schema(df.schema).csv(str(tmp_path))
        assert found == sorted(tuple(r) for r in unsplit.collect())


def test_stray_quotes_stay_in_their_line(spark, tmp_path, small_splits):
    body = 'id;size;note\n1;5" pipe;a\n2;12";"b\nc"\n3;x"y;"d;""e"\n' + "".join(f'{i};7";n{i}\n' for i in range(4, 40))
    (tmp_path / "s.csv").write_text(body)
    fmt = delimited.detect_format(spark, str(tmp_path))
    rows = delimited.scan(spark, str(tmp_path), schema="id int, size string, note string", fmt=fmt).collect()
    want = [(1, '5" pipe', "a"), (2, '12"', "b\nc"), (3, 'x"y', 'd;"e')] + [(i, '7"', f"n{i}") for i in range(4, 40)]
    assert sorted(tuple(r) for r in rows) == want


def test_types_latin1_mark_and_blank_lines(spark, tmp_path, small_splits):
    (tmp_path / "l.csv").write_bytes('\n id ;nome\n1;"Educa\nção"\n\n2;b\n3\n4;c;more\n'.encode("latin-1"))
    df = delimited.scan(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string"] and df.columns == ["id", "nome"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "Educa\nção"), (2, "b"), (3, None), (4, "c")]
    typed = delimited.scan(spark, str(tmp_path), ["id"], {"id": "texto"})
    assert sorted(r["id"] for r in typed.collect()) == ["1", "2", "3", "4"]
    target = columnar.convert_delimited(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == sorted(tuple(r) for r in df.collect())


def test_one_record_over_several_splits(spark, tmp_path, small_splits):
    long = "line\n" * 200
    (tmp_path / "r.csv").write_text(f'id;"bo\ndy"\n1;"{long}"\n2;"x\ny"\n3;"{long}"')
    df = delimited.scan(spark, str(tmp_path), schema="id int, body string", fmt=delimited.TextFormat("UTF-8", ";", True))
    assert sorted(tuple(r) for r in df.collect()) == [(1, long), (2, "x\ny"), (3, long)]


def machine(text, separator, inside):
    """Character by character: inside a quoted field after the line?"""
    i, at_start = 0, not inside
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
            at_start = False
        elif c == '"' and at_start:
            inside, at_start = True, False
        else:
            at_start = c == separator
        i += 1
    return inside


def test_bits_of_well_formed_lines():
    rng = random.Random(1)
    for _ in range(300):
        rows = [[("".join(rng.choice('ab";\n') for _ in range(rng.randrange(5)))) for _ in range(3)] for _ in range(4)]
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="\n").writerows(rows)
        lines = out.getvalue().split("\n")[:-1]
        array = pa.array([line.encode() for line in ["skipped", *lines]], pa.binary()).slice(1)
        bits = records.states(*records.events(array, ord(";")), len(lines), 0)
        want, bit = [0], False
        for line in lines:
            bit = machine(line, ";", bit)
            want.append(int(bit))
        assert bits.tolist() == want
        back = records.states(np.zeros(0, np.int64), np.zeros(0, np.int8), 3, 1)
        assert back.tolist() == [1, 1, 1, 1]
