"""Columns, filters, text, numbers, dates and types."""

from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.refs import col
from ..functions.text import upper_trim
from ..operators import columns as c
from .registry import add

add("add_constant_column",
    lambda t: c.add_constant_column(t.nation, "source", "dw"),
    "SELECT *, 'dw' AS source FROM nation")
add("add_expression_column",
    lambda t: c.add_expression_column(
        t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount"), "net",
        "l_extendedprice * (1 - l_discount)"),
    "SELECT l_orderkey, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
add("add_expression_column_aggregate",
    lambda t: c.add_expression_column(
        t.orders.select("o_orderkey", "o_totalprice"), "above_mean",
        "round(o_totalprice - mean_price, 2)", {"mean_price": "avg(o_totalprice)"}),
    "SELECT o_orderkey, o_totalprice, "
    "round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS above_mean FROM orders")
add("rename_columns",
    lambda t: c.rename_columns(t.nation, {"n_name": "country", "absent": "x"}),
    "SELECT n_nationkey, n_name AS country, n_regionkey FROM nation")
add("drop_columns",
    lambda t: c.drop_columns(t.orders, ["o_totalprice", "absent", "o_orderdate"]),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
add("reorder_columns",
    lambda t: c.reorder_columns(t.customer, ["c_mktsegment", "absent", "c_custkey"]),
    "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
add("trim_column_names",
    lambda t: c.trim_column_names(t.nation.toDF(" n_nationkey", "n_name  ", "\tn_regionkey ")),
    "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("snake_case_columns",
    lambda t: c.snake_case_columns(t.nation.toDF("Código da Nação", " Nome (País) ", "Região/Chave")),
    "SELECT n_nationkey AS codigo_da_nacao, n_name AS nome_pais, n_regionkey AS regiaochave FROM nation")
add("filter_rows",
    lambda t: c.filter_rows(t.orders, "o_totalprice > 250000 AND o_orderstatus == 'F'"),
    "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
add("filter_sql",
    lambda t: c.filter_sql(t.lineitem, "l_shipdate >= DATE '1997-01-01' AND l_quantity < 10"),
    "SELECT * FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_quantity < 10")
add("if_else",
    lambda t: c.if_else(t.dirty_customer, "acctbal > 1000", "alto", "baixo", "faixa").select("c_custkey", "faixa"),
    "SELECT c_custkey, CASE WHEN acctbal > 1000 THEN 'alto' ELSE 'baixo' END AS faixa FROM {dirty_customer}")
add("criterion_predicate",
    lambda t: c.filter_criterion(t.dirty_customer, "segment", " building ").select("c_custkey", "segment"),
    "SELECT c_custkey, segment FROM {dirty_customer} WHERE upper(trim(segment)) = 'BUILDING'")
add("criterion_predicate_number",
    lambda t: c.filter_criterion(t.dirty_customer, "acctbal", ">=-100.5").select("c_custkey", "acctbal"),
    "SELECT c_custkey, acctbal FROM {dirty_customer} WHERE acctbal >= -100.5")

add("left_text",
    lambda t: c.left_text(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", 4),
    'SELECT c_custkey, c_mktsegment, "left"(c_mktsegment, 4) AS c_mktsegment_esquerda FROM customer')
add("right_text",
    lambda t: c.right_text(t.customer.select("c_custkey", "c_name"), "c_name", 5, "tail"),
    'SELECT c_custkey, c_name, "right"(c_name, 5) AS tail FROM customer')
add("mid_text",
    lambda t: c.mid_text(t.part.select("p_partkey", "p_name"), "p_name", 2, 3),
    "SELECT p_partkey, p_name, substr(p_name, 2, 3) AS p_name_meio FROM part")
add("text_length",
    lambda t: c.text_length(t.documents.select("doc_id", "text"), "text", "n").select("doc_id", "n"),
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
add("substitute_text",
    lambda t: c.substitute_text(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", " / ", "p"),
    "SELECT o_orderkey, o_orderpriority, replace(o_orderpriority, '-', ' / ') AS p FROM orders")
add("concat_columns",
    lambda t: c.concat_columns(t.dirty_customer, ["c_custkey", "segment", "absent", "acctbal_text"], "|", "label")
    .select("c_custkey", "label"),
    "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '|' || coalesce(segment, '') || '|' || acctbal_text AS label "
    "FROM {dirty_customer}")
add("text_to_number",
    lambda t: c.text_to_number(t.dirty_customer.select("c_custkey", "acctbal_text"), "acctbal_text", "number"),
    "SELECT c_custkey, acctbal_text, "
    "TRY_CAST(replace(replace(trim(acctbal_text), '.', ''), ',', '.') AS DOUBLE) AS number FROM {dirty_customer}")
add("number_to_text",
    lambda t: c.number_to_text(t.dirty_customer.select("c_custkey", "acctbal"), "acctbal", "R$ {:,.2f}", "shown"),
    "SELECT c_custkey, acctbal, CASE WHEN acctbal IS NULL THEN '' "
    "ELSE 'R$ ' || format('{:,.2f}', acctbal) END AS shown FROM {dirty_customer}")
add("round_number",
    lambda t: c.round_number(t.orders.selectExpr("o_orderkey", "o_totalprice / 7 AS price"), "price", 2)
    .select("o_orderkey", "price_arred"),
    "SELECT o_orderkey, round(o_totalprice / 7, 2) AS price_arred FROM orders")
add("round_columns",
    lambda t: c.round_columns(
        t.lineitem.selectExpr("l_orderkey", "l_extendedprice / 7 AS a", "l_quantity / 3 AS b"), ["a", "b"], 3),
    "SELECT l_orderkey, round(l_extendedprice / 7, 3) AS a, round(l_quantity / 3, 3) AS b FROM lineitem")
add("upper_trim_text",
    lambda t: c.upper_trim_text(t.dirty_customer.select("c_custkey", "segment"), ["segment"]),
    "SELECT c_custkey, upper(trim(segment)) AS segment FROM {dirty_customer}")
add("lower_trim_text",
    lambda t: c.lower_trim_text(t.dirty_customer.select("c_custkey", "segment"), ["segment"]),
    "SELECT c_custkey, lower(trim(segment)) AS segment FROM {dirty_customer}")
add("replace_regex",
    lambda t: c.replace_regex(
        t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], r"^(\d)-(.*)$", r"\2 (\1)"),
    r"SELECT o_orderkey, regexp_replace(o_orderpriority, '^(\d)-(.*)$', '\2 (\1)') AS o_orderpriority FROM orders")
add("extract_regex",
    lambda t: c.extract_regex(t.events.select("event_id", "props"), ["props"], r'"k":\s*(\d+)', "k")
    .select("event_id", "k"),
    r"""SELECT event_id, CASE WHEN regexp_matches(props, '"k":\s*(\d+)')
        THEN regexp_extract(props, '"k":\s*(\d+)', 1) END AS k FROM events""")
add("cast_number",
    lambda t: c.cast_number(t.dirty_customer.select("c_custkey", "acctbal_text"), ["acctbal_text"]),
    "SELECT c_custkey, TRY_CAST(trim(acctbal_text) AS DOUBLE) AS acctbal_text FROM {dirty_customer}")
add("cast_number_invalid_count",
    lambda t: c.invalid_counts(t.dirty_customer, {"acctbal_text": "numero", "segment": "numero"}),
    "SELECT 'acctbal_text' AS \"column\", count(*) AS n_invalid FROM {dirty_customer} "
    "WHERE acctbal_text IS NOT NULL AND TRY_CAST(trim(acctbal_text) AS DOUBLE) IS NULL UNION ALL "
    "SELECT 'segment', count(*) FROM {dirty_customer} "
    "WHERE segment IS NOT NULL AND TRY_CAST(trim(segment) AS DOUBLE) IS NULL")
_PARSED = ("coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))")
add("cast_date",
    lambda t: c.cast_date(t.date_text, ["date_text"]),
    f"SELECT o_orderkey, {_PARSED} AS date_text FROM {{date_text}}")
add("cast_text",
    lambda t: c.cast_text(t.customer.select("c_custkey", "c_acctbal"), ["c_custkey", "c_acctbal"]),
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer")
add("format_dates",
    lambda t: c.format_dates(t.date_text, ["date_text"], "%d/%m/%Y"),
    f"SELECT o_orderkey, strftime({_PARSED}, '%d/%m/%Y') AS date_text FROM {{date_text}}")
add("parse_br_number",
    lambda t: c.parse_br_number(t.dirty_customer.select("c_custkey", "acctbal_text"), ["acctbal_text"], 2),
    "SELECT c_custkey, round(TRY_CAST(replace(acctbal_text, ',', '.') AS DOUBLE), 2) AS acctbal_text "
    "FROM {dirty_customer}")
add("format_br_number",
    lambda t: c.format_br_number(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]),
    "SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS o_totalprice FROM orders")

_BIGRAMS = "list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2))"
_ROOT = ("CASE WHEN length({0}) > 2 THEN array_to_string(list_filter(string_split({0}, ''), "
         "lambda x, i: i = 1 OR x <> substr({0}, i - 1, 1)), '') ELSE {0} END")


def dice_sql(a: str, b: str) -> str:
    ga, gb = _BIGRAMS.format(a), _BIGRAMS.format(b)
    return (f"CASE WHEN {a} = {b} THEN 1.0 ELSE least(1.0, CAST(2 * len(list_filter({ga}, "
            f"lambda x: list_contains({gb}, x))) AS DOUBLE) / (len({ga}) + len({gb}))) END")


def edit_sql(a: str, b: str) -> str:
    return f"(1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"


def root_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {_ROOT.format(a)} = {_ROOT.format(b)} THEN 0.95 "
            + " ".join(
                f"WHEN least(length({a}), length({b})) >= {n} AND substr({a}, 1, {n}) = substr({b}, 1, {n}) THEN {s}"
                for n, s in ((4, 0.85), (3, 0.8), (2, 0.75)))
            + " ELSE 0.0 END")


def _scored(t, score):
    pairs = t.typo_part.select("p_partkey", upper_trim(col("name")).alias("a"), upper_trim(col("p_name")).alias("b"))
    return pairs.select("p_partkey", F.round(score(F.col("a"), F.col("b")), 6).alias("score"))


_PAIRS = "(SELECT p_partkey, upper(trim(name)) AS a, upper(trim(p_name)) AS b FROM {typo_part})"
for _name, _score, _sql in (
    ("bigram_similarity", similarity.bigram_similarity, dice_sql),
    ("edit_similarity", similarity.edit_similarity, edit_sql),
    ("root_similarity", similarity.root_similarity, root_sql),
):
    add(_name, lambda t, s=_score: _scored(t, s),
        f"SELECT p_partkey, round(CAST({_sql('a', 'b')} AS DOUBLE), 6) AS score FROM {_PAIRS}")
