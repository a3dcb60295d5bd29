"""WARC derivatives of odd pages: expectations written by hand, SQL next to them, and pages that never close a tag."""

import time

import duckdb
import pytest

from tidymill.llm import warc

# html, links, text, title, language
PAGES = [
    ('<a data-href="wrong" href="right">x</a>', ["right"], "x", "", ""),
    ("<a href='one'>1</a> <A HREF=two>2</A> <a\nhref = \"three\" >3</a><a class=k href=/four?a=b&amp;c=d>4</a>",
     ["one", "two", "three", "/four?a=b&c=d"], "1 2 34", "", ""),
    ('<a title="see href=no" href="yes">x</a><a title=\'a href="no2"\'>y</a><abbr href="no3">z</abbr>', ["yes"], "xyz", "", ""),
    ('<a href="first" href="second">x</a><a href="">empty</a><a name="n">none</a>', ["first", ""], "xemptynone", "", ""),
    ('<!-- <a href="hidden">h</a> --><script>"<a href=\'s\'>"</script><a/href="slash">t</a>', ["slash"], "t", "", ""),
    ("caf&eacute; &#8217;q&#x2019; &amp;lt; &nosuch; &#0; &#55296; &#x1F44D; a&b & &copy &#160;|&nbsp;|&Eacute;&Alpha;",
     [], "café ’q’ &lt; &nosuch; � � 👍 a&b & &copy | |ÉΑ", "", ""),
    ("<HTML data-lang='no' LANG='pt&#45;BR'><Title lang=x> T &mdash; 1\n</Title><p>body", [], "body", "T — 1", "pt-BR"),
    ("<html lang=de><title>never closed <p>x", [], "", "never closed <p>x", "de"),
    ("shown<script>never closed <p>x", [], "shown", "", ""), ("shown<!-- never closed", [], "shown", "", ""),
    ("shown<a href='cut", [], "shown", "", ""), ("1 < 2 <3", [], "1 < 2 <3", "", ""),
]


def records_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return warc.derive(warc.responses(pages))


def test_pages_by_hand_and_by_sql(spark):
    rows = [(i, "u", p[0]) for i, p in enumerate(PAGES)]
    records = records_of(spark, rows).cache()
    texts = {r["page_id"]: r["block"] for r in records.where("warc_type = 'conversion'").collect()}
    fields = {r["page_id"]: r["block"].split("\r\n") for r in records.where("warc_type = 'metadata'").collect()}
    for i, (html, links, text, title, language) in enumerate(PAGES):
        assert (html, texts[i]) == (html, text)
        assert (html, [f[9:] for f in fields[i] if f.startswith("outlink: ")]) == (html, links)
        assert f"title: {title}" in fields[i] and f"languages-html: {language}" in fields[i]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    found = db.execute(warc.derivatives_sql())
    names = [d[0] for d in found.description]
    got = records.selectExpr("*", "sha2(CAST(record AS BINARY), 256) AS record_sha256").select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("part", ["<!--", "<a ", "<script ", "<script>", "</script", "<title", "<title>", "<html ", "<p", "&#", "& ",
                                  "<a href=", '<a href="', "<a x=", "<a " + "y" * 50, "<a =\"'"])
def test_pages_that_never_close_take_linear_time(spark, part):
    page = part * (1_000_000 // len(part))
    started = time.perf_counter()
    assert records_of(spark, [(1, "u", "a" + page)]).select("block").collect()
    assert time.perf_counter() - started < 20
    one = "<a " + "z" * 1_000_000 + ">" if part == "<a " else "<a " + "k=v " * 250_000 + "href=x>"
    assert records_of(spark, [(1, "u", one)]).select("n_links").first()[0] == (0 if part == "<a " else 1)
