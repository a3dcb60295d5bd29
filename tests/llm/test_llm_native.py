"""Operators made of Spark expressions against SQL on another engine and plain Python."""

import collections
import gzip
import pathlib

import duckdb
import numpy as np
import pytest
from llm_cases import EDGE, LONG, by_id, edge_documents, no_documents

from tidymill.llm import licenses, quality_rules, warc

LICENSED = [
    (20, "Released under the MIT License. Under the MIT license, cc by nc cc by nc"),
    (21, "SPDX-License-Identifier: GPL-2.0-or-later\nThis program is free software; you can redistribute it and/or modify "
         "it under the terms of the GNU General Public License"),
    (22, "licensed under the Apache License, Version 2.0 and CC-BY-NC-SA 4.0, all rights reserved"),
    (23, "the mit of a license"), (24, "bsd 3 clause license bsd license BSD-2-Clause"), (25, "cc by nc éapache license version 2"),
    (26, "gpl " * 300 + "under the terms of the gnu lesser general public license version 2.1 " * 40),
    (27, LONG + " Under the MIT License " + LONG + " apache license version 2"), (28, "under the mit license"), (28, "under the mit license"),
]


def sql_rows(sql, table, columns, rows):
    db = duckdb.connect()
    db.execute(f"CREATE TABLE {table} ({columns})")
    if rows:
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return names, sorted((tuple(r) for r in found.fetchall()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_license_detection_agrees_with_sql(spark):
    rows = EDGE + LICENSED
    names, want = sql_rows(licenses.detection_sql(), "documents", "doc_id BIGINT, text VARCHAR", rows)
    got = licenses.detect(edge_documents(spark, rows)).select(*names)
    assert by_id(got) == want
    named = {r[0]: dict(zip(names, r)) for r in want}
    assert named[20]["n_base"] == 4 and named[20]["base_labels"] == "cc-by-nc,mit"
    assert (named[20]["first_word"], named[20]["last_word"]) == (1, 12)
    assert named[27]["base_labels"] == "apache-2,mit" and named[1]["labels"] == "" and named[1]["n_words"] == 0
    assert by_id(licenses.detect(no_documents(spark))) == []


def test_license_rules():
    assert len(licenses.RULES) >= 300
    for rule in licenses.RULES:
        assert all(w.isalnum() and w == w.lower() for w in rule.needs)
        assert len(rule.pattern.split()) <= licenses.BLOCK


def test_longer_and_higher_license_matches_win(spark):
    found = {r["doc_id"]: r["detections"] for r in licenses.detect(edge_documents(spark, LICENSED[:5])).collect()}
    assert [(d["label"], d["priority"]) for d in found[21]][0] == ("gpl-2+", 60)
    assert {d["label"] for d in found[22]} >= {"apache-2", "cc-by-nc-sa", "proprietary"}
    assert "cc-by" not in {d["label"] for d in found[22]}
    assert found[23] == []


PAGES = [
    (1, "http://a.b/c d\n", '<!DOCTYPE html><html lang="en"><head><title> A &amp;amp; B\n</title><script>x="<p>"</script></head>'
     '<body><p>One<br>two &lt;3 &copy;<!-- no --> <A HREF="/x?a&amp;b">link</A><div>3 < 4</div></body></html>'),
    (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", "<script>never closed <p>text"),
    (6, "é", "<p>É中</p>" * 5000), (None, "n", "<b>x</b>"), (3, "u", ""),
]


def test_warc_derivatives_agree_with_sql(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, text string, links string")
    records = warc.derive(warc.responses(pages)).cache()
    names, want = sql_rows(warc.derivatives_sql(), "pages", "page_id BIGINT, url VARCHAR, html VARCHAR", PAGES)
    got = records.selectExpr("*", "sha2(CAST(record AS BINARY), 256) AS record_sha256").select(*names)
    assert by_id(got) == want
    assert records.count() == 2 * len(PAGES)
    text = {r["page_id"]: r["block"] for r in records.where("warc_type = 'conversion'").collect()}
    assert text[1] == "One\ntwo <3 © link\n3 < 4" and text[2] == "" and text[4] == "plain text only"
    first = records.where("page_id = 1 AND warc_type = 'metadata'").first()
    assert "title: A &amp; B\r\n" in first["block"] and "outlink: /x?a&b\r\n" in first["block"] and first["n_links"] == 1
    source = warc.responses(pages).where("page_id = 1").first()
    assert f"WARC-Refers-To: {source['record_id']}\r\n" in first["record"]
    assert f"WARC-Source-Payload-Digest: {source['payload_digest']}\r\n" in first["record"]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_pages_of_adjacent_block_tags(spark):
    pages = [
        (1, "u", "a" + "<br>" * 100_000 + "b"), (2, "u", "<table>" + "<tr><td> </td><td></td></tr>\n" * 17_000 + "</table>"),
        (3, "u", "a <p> &nbsp; </p> <p>b&nbsp;<br> c" + "\n" * 100_000),
    ]
    records = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).cache()
    names, want = sql_rows(warc.derivatives_sql(), "pages", "page_id BIGINT, url VARCHAR, html VARCHAR", pages)
    assert by_id(records.selectExpr("*", "sha2(CAST(record AS BINARY), 256) AS record_sha256").select(*names)) == want
    text = {r["page_id"]: r["block"] for r in records.where("warc_type = 'conversion'").collect()}
    assert text == {1: "a\nb", 2: "", 3: "a\nb\nc"}


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages))
    warc.write_records(records.coalesce(1), str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(tmp_path / "out").glob("*.gz"))
    at, seen = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        start = at + len(head) + 4
        at = start + int(fields["Content-Length"]) + 4
        assert head.startswith(b"WARC/1.1\r\n") and data[at - 4 : at] == b"\r\n\r\n"
        seen.append(fields["WARC-Record-ID"])
    assert sorted(seen) == sorted(r["record_id"] for r in records.collect())


def counts(text):
    words = (text or "").encode().split()
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(again),
    )


def test_quality_statistics(spark):
    rows = EDGE + LICENSED + [(30, "a b a b a b a b"), (31, "a a a a a"), (32, "q\n\nq\n \nq\nx\x0by\x1cz"), (33, "é|< a b c d a b c")]
    got = quality_rules.judge(edge_documents(spark, rows), [])
    want = []
    for doc_id, text in rows:
        n = counts(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want.append((doc_id, *n, failed, not failed))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert by_id(got.select(*columns)) == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert quality_rules.judge(no_documents(spark), []).count() == 0


def test_decision_list_finds_what_is_planted():
    rng = np.random.default_rng(1)
    values = rng.random((3000, len(quality_rules.FEATURES)))
    symbols, repeats = quality_rules.FEATURES.index("symbol_share"), quality_rules.FEATURES.index("repeat_share")
    bad = (values[:, symbols] > 0.8) | ((values[:, repeats] > 0.7) & (values[:, 0] < 0.4))
    noisy = bad ^ (rng.random(3000) < 0.01)
    rules = quality_rules.learn(values, noisy, quality_rules.Settings(precision=0.9))
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules._covers(rule, values)
    assert (found == bad).mean() > 0.97
    assert quality_rules.learn(values[:0], bad[:0]) == [] and quality_rules.learn(values, np.zeros(3000, bool)) == []


def test_verdicts_are_the_learned_rules(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rule = [quality_rules.Condition("symbol_share", True, 0.1), quality_rules.Condition("n_words", False, 300.0)]
    rows = quality_rules.judge(docs, [rule]).collect()
    assert rows and all(
        r["kept"] == (not r["base_failed"] and not (r["symbol_share"] > 0.1 and r["n_words"] <= 300)) for r in rows
    )
    learned = quality_rules.train(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, learned).where("NOT base_failed").collect()}
    good = [kept[r["doc_id"]] for r in labels.where("quality = 1").collect() if r["doc_id"] in kept]
    assert np.mean(good) > 0.97
    assert quality_rules.train(docs, labels.limit(0)) == []


@pytest.mark.parametrize("text", ["", "a", "MIT license"])
def test_words_of_short_texts(spark, text):
    row = licenses.detect(edge_documents(spark, [(1, text)])).first()
    assert row["n_words"] == len(text.split()) and row["score"] == (0.6 if "MIT" in text else 0.0)
