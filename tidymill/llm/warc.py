"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

All of it is expressions on a row, so there is no shuffle and no group, and a page costs what its own
size costs. Record ids are made from the content (a version-3 style id from an MD5 digest), so a task
that runs again after a lost executor makes the same records. Both derivatives name their response
(``WARC-Refers-To``), its address and date, and the digest of its payload; the metadata record also
holds its HTTP headers, title, language and links.

Text is what stands outside comments, scripts, styles and the title; block tags end a line, other tags
vanish, character references are decoded. Links and the language are attributes of their tags, in double
quotes, single quotes or none. What is never closed (a comment, a script, a tag) goes on to the end of
the page, so every pattern passes over a page once, whatever it holds. A ``>`` ends a tag even in quotes.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import once

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

END = r"[^>]*(?:>|\z)"  # the rest of a tag
_RAW = "|".join(rf"<{name}\b.*?(?:</{name}{END}|\z)" for name in ("script", "style", "noscript", "title"))
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}"
BLOCKS = (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|article|section|header|footer|nav|main|aside"
          rf"|form|blockquote|pre|figure|body|html|head)\b{END}")
TAGS = rf"<[A-Za-z/!?]{END}"
ANCHORS = rf"(?i)<a[ \t\n\f\r/]{END}"
TITLE = rf"(?is)<title\b{END}(.*?)(?:</title|\z)"
ROOT = rf"(?i)<html\b{END}"
# An attribute with its value, so that what stands inside a value is not taken for one. A name starts where
# no name goes on before it, which an engine of linear time need not be told.
NAME = r"[^ \t\n\f\r\"'>/=]"
ATTRIBUTE = rf"{NAME}+[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"[^\"]*\"|'[^']*'|[^ \t\n\f\r\"'>]+)"
# A character reference without its ampersand: decimal, hexadecimal or by name.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
# Names of the standard library's table, a no-break space as a space.
CHARACTERS = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
RECORD_COLUMNS = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest"]


def _character(reference: Column) -> Column:
    """The character of a reference such as ``#8217``, ``#x2019`` or ``eacute``; null if it names none."""
    number = F.when(
        reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 8), 16, 10)
    ).otherwise(F.substring(reference, 2, 8)).cast("long")
    valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    numeric = F.when(number == 160, " ").when(valid, wide).otherwise("\ufffd")
    names = F.create_map(*[F.lit(x) for pair in sorted(CHARACTERS.items()) for x in pair])
    usual = F.when(reference == "amp", "&").when(reference == "lt", "<").when(reference == "gt", ">")
    usual = usual.when(reference == "quot", '"').when(reference == "nbsp", " ")  # before the search of the table
    return usual.when(F.startswith(reference, F.lit("#")), numeric).otherwise(F.try_element_at(names, reference))


def _decoded(text: Column) -> Column:
    """Character references decoded, each once. An ampersand that begins none stays."""

    def part(piece: Column) -> Column:
        reference = F.regexp_extract(piece, REFERENCE, 1)
        found = F.when(reference != "", _character(reference))
        rest = F.substring(piece, F.length(reference) + 2, F.length(piece))
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), piece))

    rest = F.transform(F.slice(F.split(text, "&", -1), F.lit(2), F.lit(1 << 30)), part)
    return F.when(
        F.contains(text, F.lit("&")), F.concat(F.substring_index(text, "&", 1), F.array_join(rest, ""))
    ).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name in a tag, as it stands there without its quotes; null without one."""
    found = F.regexp_extract_all(tag, F.lit(rf"(?<!{NAME}){ATTRIBUTE}"), F.lit(0))
    own = F.filter(found, lambda x: F.lower(F.rtrim(F.substring_index(x, "=", 1), F.lit(" \t\n\f\r"))) == name)
    value = r"(?s)^[^=]*=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)'|(.*))$"
    return F.regexp_replace(F.get(own, F.lit(0)), value, "$1$2$3")


def _one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\x00-\x20\x7F]+", " "))


def shown(html: Column) -> Column:
    """The page without comments, scripts, styles and title."""
    return F.regexp_replace(html, HIDDEN, " ")


def untagged(shown_html: Column) -> Column:
    """What stands outside tags, a line end for each block tag."""
    lines = F.regexp_replace(F.regexp_replace(shown_html, r"[\x09-\x0D]+", " "), BLOCKS, "\n")
    return F.regexp_replace(lines, TAGS, "")


def plain_text(untagged_text: Column) -> Column:
    """The visible text, a line per block, spaces run together."""
    # No repeated group here: Java matches one recursively, and a large empty table would end the executor.
    text = F.regexp_replace(F.regexp_replace(_decoded(untagged_text), "  +", " "), " ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def digest(text: Column) -> Column:
    """``sha1:`` and the digest in base 32, as WARC writers have it."""
    hexadecimal = F.sha1(text.cast("binary"))
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
        F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records ``page_id, record_id, target_uri, date, http_headers, payload, payload_digest``
    of pages ``(page_id, url, html)``. A null page has an empty payload, a null address is empty."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _one_line(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("target_uri"), F.lit(date).alias("date"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", digest(F.col("payload")))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
    )
    name = record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("payload_digest"))
    return rows.withColumn("http_headers", headers).withColumn("record_id", name)


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: ``warc_type`` metadata and conversion.

    Returns ``page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_digest, n_links, block, record``; ``record`` is the whole record as it stands in
    a file. An empty page gives empty blocks of text and no links; repeated pages give the same records.
    """
    html, bare = F.col("payload"), F.col("bare")
    anchors = F.regexp_extract_all(bare, F.lit(ANCHORS), F.lit(0))
    links = F.filter(F.transform(anchors, lambda tag: _attribute(tag, "href")), lambda x: x.isNotNull())
    # Each is a column before it is decoded, which looks at its text several times.
    rows = source.withColumn("bare", once(shown(html))).withColumns({
        "untagged": once(untagged(bare)), "raw_title": once(F.regexp_extract(html, TITLE, 1)),
        "raw_language": once(F.coalesce(_attribute(F.regexp_extract(html, ROOT, 0), "lang"), F.lit(""))),
        "raw_links": once(links),
    }).select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers",
        F.col("payload_digest").alias("source_digest"), plain_text(F.col("untagged")).alias("text"),
        _one_line(_decoded(F.col("raw_title"))).alias("title"), _one_line(_decoded(F.col("raw_language"))).alias("language"),
        F.transform("raw_links", lambda x: _one_line(_decoded(x))).alias("links"),
    )
    line = lambda name: lambda value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat(
        line("title")(F.col("title")), line("languages-html")(F.col("language")),
        F.array_join(F.transform(F.split("http_headers", "\r\n"), line("source-http")), ""),
        F.array_join(F.transform("links", line("outlink")), ""),
    )
    rows = rows.withColumn("fields", fields)
    both = F.array(*[
        F.struct(F.lit(kind).alias("warc_type"), F.lit(media).alias("content_type"), F.col(block).alias("block"))
        for kind, media, block in (("metadata", "application/warc-fields", "fields"), ("conversion", "text/plain", "text"))
    ])
    rows = rows.withColumn("n_links", F.size("links").cast("long")).select(
        "page_id", "refers_to", "target_uri", "date", "source_digest", "n_links", F.inline(both)
    )
    rows = rows.withColumn("block_digest", digest(F.col("block")))
    rows = rows.withColumn("content_length", F.octet_length("block").cast("long"))
    rows = rows.withColumn("record_id", record_id(F.col("warc_type"), F.col("refers_to"), F.col("block_digest")))
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"),
             ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = [part for label, column in names for part in (F.lit(f"\r\n{label}: "), F.col(column).cast("string"))]
    record = F.concat(F.lit(VERSION), *head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n"))
    return rows.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length",
        "block_digest", "source_digest", "n_links", "block", record.alias("record"),
    )


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write whole records into files that hold nothing else, one per partition."""
    # A record ends in two line ends; the writer adds the second.
    rows = records.select(F.expr("left(record, length(record) - 2)").alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", compression).text(path)


def derivatives_sql(date: str = DATE) -> str:
    """What the query returns, as SQL on ``pages``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    names = f"map {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in sorted(CHARACTERS.items()))}}}"
    white = "chr(32) || chr(9) || chr(10) || chr(12) || chr(13)"

    def character(ref: str) -> str:
        number = (f"CASE WHEN regexp_matches({ref}, '^#[xX]') THEN CAST('0x' || substr({ref}, 3) AS BIGINT) "
                  f"WHEN {ref} LIKE '#%' THEN CAST(substr({ref}, 2) AS BIGINT) END")
        return (f"CASE WHEN {ref} NOT LIKE '#%' THEN names[{ref}] WHEN {number} = 160 THEN ' ' "
                f"WHEN ({number} > 0 AND {number} < 55296) OR ({number} > 57343 AND {number} <= 1114111) "
                f"THEN chr(CAST({number} AS INTEGER)) ELSE chr(65533) END")

    def decoded(text: str) -> str:
        ref = f"regexp_extract(q, {quote(REFERENCE)}, 1)"
        part = (f"CASE WHEN q.ref <> '' THEN coalesce({character('q.ref')} || substr(q.piece, length(q.ref) + 2), "
                "'&' || q.piece) ELSE '&' || q.piece END")
        pieces = f"[{{'piece': q, 'ref': {ref}}} for q in string_split({text}, '&')[2:]]"
        return (f"string_split({text}, '&')[1] || coalesce(list_aggregate([{part} for q in {pieces}], "
                "'string_agg', ''), '')")

    def attribute(tag: str, name: str) -> str:
        found = f"regexp_extract_all({tag}, {quote(ATTRIBUTE)})"
        own = f"[y for y in {found} if lower(rtrim(string_split(y, '=')[1], {white})) = '{name}'][1]"
        value = f"ltrim(regexp_replace({own}, '^[^=]*=', ''), {white})"
        return f"CASE WHEN left({value}, 1) IN (chr(34), chr(39)) THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"

    def one_line(text: str) -> str:
        return f"trim(regexp_replace({text}, '[\\x00-\\x20\\x7F]+', ' ', 'g'), ' ')"

    def b32(text: str) -> str:
        digits = f"[substr('{BASE32}', 1 + CAST((CAST('0x' || substr(sha1({text}), 1 + 10 * (i // 8), 10) AS BIGINT) >> " \
                 f"CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1) for i in range(32)]"
        return f"'sha1:' || list_aggregate({digits}, 'string_agg', '')"

    def uuid(text: str) -> str:
        return (f"'<urn:uuid:' || substr(md5({text}), 1, 8) || '-' || substr(md5({text}), 9, 4) || '-3' || "
                f"substr(md5({text}), 14, 3) || '-a' || substr(md5({text}), 18, 3) || '-' || substr(md5({text}), 21, 12) || '>'")

    replaced = lambda text, pattern, by: f"regexp_replace({text}, {quote(pattern)}, {by}, 'g')"
    text = replaced(replaced("bare", r"[\x09-\x0D]+", "' '"), BLOCKS, "chr(10)")
    text = decoded(replaced(text, TAGS, "''"))
    text = f"trim({replaced(replaced(text, ' +', quote(' ')), '( ?' + chr(92) + 'n ?)+', 'chr(10)')}, ' ' || chr(10))"
    end = "chr(13) || chr(10)"
    head = " || ".join(
        f"{end} || '{label}: ' || {column}" for label, column in (
            ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"),
            ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
            ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"),
            ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
            ("Content-Type", "content_type"), ("Content-Length", "content_length"),
        )
    )
    return f"""
WITH p AS (SELECT page_id, {one_line("coalesce(url, '')")} AS target_uri, '{date}' AS date,
                  coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, {b32("payload")} AS source_digest FROM p),
r AS (SELECT *, {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '-') || '|' || target_uri || '|' || source_digest")}
      AS refers_to, {replaced("payload", HIDDEN, "' '")} AS bare, {names} AS names FROM d),
t AS (SELECT page_id, refers_to, target_uri, date, source_digest, strlen(payload) AS size, {text} AS text,
        {one_line(decoded(f"regexp_extract(payload, {quote(TITLE)}, 1)"))} AS title,
        {one_line(decoded(f"coalesce({attribute(f'regexp_extract(payload, {quote(ROOT)})', 'lang')}, '')"))} AS language,
        [{one_line(decoded("x"))} for x in [{attribute("z", "href")} for z in
         regexp_extract_all(bare, {quote(ANCHORS)})] if x IS NOT NULL] AS links FROM r),
f AS (SELECT *, 'title: ' || title || {end} || 'languages-html: ' || language || {end} ||
        'source-http: HTTP/1.1 200 OK' || {end} || 'source-http: Content-Type: text/html; charset=utf-8' || {end} ||
        'source-http: Content-Length: ' || size || {end} ||
        coalesce(list_aggregate(['outlink: ' || x || {end} for x in links], 'string_agg', ''), '') AS fields FROM t),
b AS (SELECT page_id, refers_to, target_uri, date, source_digest, len(links) AS n_links, 'metadata' AS warc_type,
             'application/warc-fields' AS content_type, fields AS block FROM f
      UNION ALL
      SELECT page_id, refers_to, target_uri, date, source_digest, len(links), 'conversion', 'text/plain', text FROM f),
x AS (SELECT *, {b32("block")} AS block_digest, strlen(block) AS content_length FROM b),
y AS (SELECT *, {uuid("warc_type || '|' || refers_to || '|' || block_digest")} AS record_id FROM x)
SELECT page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
       source_digest, n_links,
       sha256('{VERSION}' || {head} || {end} || {end} || block || {end} || {end}) AS record_sha256
FROM y
"""
