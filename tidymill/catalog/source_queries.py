"""Files: written from the given tables into the shared folder, then read back."""

from pyspark.sql import functions as F

from ..operators import profile
from ..sources import columnar, delimited, reporting
from .registry import add

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _csv(t, df, separator=";", encoding="UTF-8", label="csv", **options):
    path = t.fresh_path(label)
    df.write.options(header=True, sep=separator, encoding=encoding, escape='"', **options).csv(path)
    return path


_AS_IT_IS = {"quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _bodies(t):
    """Whole texts, with the separators, quotes and line breaks they hold."""
    return t.documents.select("doc_id", "lang", "text")


_FORMATS = (("utf8_semicolon", ";", "UTF-8"), ("utf8_comma", ",", "UTF-8"), ("latin1_semicolon", ";", "ISO-8859-1"),
            ("utf8_tab", "\t", "UTF-8"), ("latin1_pipe", "|", "ISO-8859-1"))


def _detected(t):
    found = []
    for name, separator, encoding in _FORMATS:
        fmt = delimited.detect_format(t.spark, _csv(t, _bodies(t), separator, encoding, name, **_AS_IT_IS))
        found.append((name, fmt.encoding, fmt.separator, fmt.multi_line))
    return t.spark.createDataFrame(found, "file string, encoding string, separator string, multi_line boolean")


# Texts go over several lines, so each of the files has a quoted field that does.
add("csv_detect_format", _detected,
    " UNION ALL ".join(
        f"SELECT '{name}' AS file, '{encoding}' AS encoding, {'chr(9)' if s == chr(9) else repr(s)} AS separator, "
        "(SELECT max(CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END) = 1 FROM documents) AS multi_line"
        for name, s, encoding in _FORMATS))
add("csv_separator_by_count",
    lambda t: delimited.count_separators(t.spark, _csv(t, t.customer, "|"), 5),
    "SELECT * FROM (VALUES (';', 0), (',', 0), (chr(9), 0), ('|', 20)) AS v(separator, n)")
add("csv_scan",
    lambda t: delimited.scan(t.spark, _csv(t, t.customer), schema=_CUSTOMER),
    "SELECT * FROM customer")
add("csv_scan_inferred",
    lambda t: delimited.scan(t.spark, _csv(t, t.orders, ",")),
    "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, "
    "o_totalprice, o_orderdate, o_orderpriority FROM orders")


add("csv_scan_multiline",
    lambda t: delimited.scan(t.spark, _csv(t, t.documents.select("doc_id", "text"), label="quoted", **_AS_IT_IS),
                             schema="doc_id bigint, text string"),
    "SELECT doc_id, text FROM documents")
add("csv_scan_latin1",
    lambda t: delimited.scan(
        t.spark, _csv(t, t.nation.withColumn("n_name", F.concat("n_name", F.lit(" é ação"))), ";", "ISO-8859-1"),
        schema="n_nationkey int, n_name string, n_regionkey int"),
    "SELECT n_nationkey, n_name || ' é ação' AS n_name, n_regionkey FROM nation")
add("csv_scan_columns",
    lambda t: delimited.scan(t.spark, _csv(t, t.customer), ["c_name", "c_acctbal"],
                             {"c_name": "texto", "c_acctbal": "numero"}),
    "SELECT c_name, c_acctbal FROM customer")
add("csv_scan_typed",
    lambda t: delimited.scan(
        t.spark, _csv(t, t.dirty_customer.select("c_custkey", "acctbal_text", "code_like")),
        types={"c_custkey": "numero", "acctbal_text": "numero", "code_like": "texto"}),
    "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, TRY_CAST(trim(acctbal_text) AS DOUBLE) AS acctbal_text, "
    "CAST(code_like AS VARCHAR) AS code_like FROM {dirty_customer}")
add("csv_list_columns",
    lambda t: t.spark.createDataFrame(
        [(i, c) for i, c in enumerate(delimited.list_columns(
            t.spark, _csv(t, t.customer.withColumnRenamed("c_name", " c_name "))))], "place int, name string"),
    "SELECT * FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), "
    "(4, 'c_mktsegment')) AS v(place, name)")
add("parquet_scan",
    lambda t: columnar.scan(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"],
                            [("o_totalprice", ">", 300000.0), ("o_orderstatus", "in", ["F", "O"])]),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus IN ('F', 'O')")


def _chunk_total(frame):
    frame = frame.copy()
    frame["value"] = frame["value"] * 2
    return frame


add("parquet_batches",
    lambda t: columnar.map_batches(t.events.select("event_id", "value"), _chunk_total, "event_id bigint, value double", 1000),
    "SELECT event_id, value * 2 AS value FROM events")
add("parquet_sink",
    lambda t: t.spark.read.parquet(columnar.write(t.lineitem, t.fresh_path("parquet"), "zstd", 20000)),
    "SELECT * FROM lineitem")
add("csv_to_parquet",
    lambda t: t.spark.read.parquet(columnar.convert_delimited(
        t.spark, _csv(t, t.documents, label="documents", **_AS_IT_IS), t.fresh_path("converted")))
    .select(F.col("doc_id").cast("bigint"), "text", "lang", "source", F.col("n_chars").cast("bigint")),
    "SELECT doc_id, text, lang, source, n_chars FROM documents")
add("csv_to_parquet_latin1",
    lambda t: t.spark.read.parquet(columnar.convert_delimited(
        t.spark, _csv(t, t.customer, ";", "ISO-8859-1"), t.fresh_path("converted"), "ISO-8859-1", ";"))
    .select(F.col("c_custkey").cast("bigint"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "SELECT * FROM customer")
add("table_file_info",
    lambda t: columnar.table_info(t.spark, f"{t.folder}/lineitem.parquet").select(
        "files", "rows", "columns", (F.col("bytes") > 0).alias("has_bytes"), "schema"),
    "SELECT CAST(1 AS BIGINT) AS files, count(*) AS rows, 11 AS columns, true AS has_bytes, 'l_orderkey bigint, "
    "l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz' AS schema FROM lineitem")
add("bi_csv_sink",
    lambda t: delimited.scan(
        t.spark, reporting.write_bi_csv(
            t.nation.withColumnRenamed("n_name", "Nome da Nação"), t.fresh_path("export"), "nacoes"),
        schema="n_nationkey int, nome_da_nacao string, n_regionkey int"),
    "SELECT n_nationkey, n_name AS nome_da_nacao, n_regionkey FROM nation")
add("preview",
    lambda t: reporting.preview(t.dirty_customer.select("c_custkey", "segment", "acctbal_text"), ["c_custkey"]),
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(segment, '') AS segment, "
    "coalesce(acctbal_text, '') AS acctbal_text FROM {dirty_customer} ORDER BY CAST(c_custkey AS BIGINT) LIMIT 50")
add("preflight_sample",
    lambda t: profile.preflight_sample(t.dirty_customer.withColumnRenamed("code_like", "Unnamed: 6"), ["c_custkey"]),
    "SELECT 'unnamed_column' AS problem, 'Unnamed: 6' AS \"column\", CAST(NULL AS BIGINT) AS n_rows UNION ALL "
    "SELECT 'mostly_null_column', 'empty_col', count(*) FROM (SELECT * FROM {dirty_customer} ORDER BY c_custkey LIMIT 100) "
    "WHERE empty_col IS NULL")
