"""Joins, lookups, aggregates, duplicates, order, nulls and value replacement."""

from pyspark.sql import functions as F

from ..operators import aggregate as a, clean, correlation, dedup, lookup, order
from .registry import add

_ORDERS_BY_CUSTOMER = "(SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders)"


def _orders(t):
    return t.orders.selectExpr("o_orderkey", "o_custkey AS c_custkey", "o_totalprice")


# ---- joins
add("equi_join_inner",
    lambda t: lookup.equi_join(_orders(t), t.customer, "c_custkey", "inner"),
    f"SELECT * FROM {_ORDERS_BY_CUSTOMER} JOIN customer USING (c_custkey)")
for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    add(f"equi_join_{_how}",
        lambda t, h=_how: lookup.equi_join(
            t.dirty_customer.selectExpr("c_custkey", "c_nationkey AS k", "segment AS name"),
            t.spark.sql("SELECT CAST(n_nationkey + 3 AS INT) AS k, n_name AS name FROM {n}", n=t.nation), "k", h),
        f"SELECT k, c_custkey, l.name AS name_x, r.name AS name_y FROM "
        f"(SELECT c_custkey, c_nationkey AS k, segment AS name FROM {{dirty_customer}}) l {_sql} JOIN "
        f"(SELECT CAST(n_nationkey + 3 AS INTEGER) AS k, n_name AS name FROM nation) r USING (k)")
add("equi_join_outer_split",
    lambda t: lookup.equi_join(
        t.dirty_customer.selectExpr("c_custkey", "c_nationkey AS k", "segment AS name"),
        t.spark.sql("SELECT CAST(n_nationkey + 3 AS INT) AS k, n_name AS name FROM {n}", n=t.nation), "k", "outer",
        split_hot=True),
    "SELECT k, c_custkey, l.name AS name_x, r.name AS name_y FROM "
    "(SELECT c_custkey, c_nationkey AS k, segment AS name FROM {dirty_customer}) l FULL JOIN "
    "(SELECT CAST(n_nationkey + 3 AS INTEGER) AS k, n_name AS name FROM nation) r USING (k)")
add("equi_join_null_safe",
    lambda t: lookup.equi_join(
        t.dirty_customer.select("c_custkey", "segment"),
        t.dirty_customer.groupBy("segment").agg(F.count("*").alias("n")), "segment", "inner", null_safe=True),
    "SELECT c_custkey, l.segment, n FROM {dirty_customer} l JOIN "
    "(SELECT segment, count(*) AS n FROM {dirty_customer} GROUP BY segment) r ON l.segment IS NOT DISTINCT FROM r.segment")
add("equi_join_semi",
    lambda t: lookup.equi_join(
        t.customer, t.partial_nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left_semi"),
    "SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM {partial_nation})")
add("equi_join_anti",
    lambda t: lookup.equi_join(
        t.customer, t.partial_nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left_anti"),
    "SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {partial_nation})")

# ---- lookups
add("vlookup",
    lambda t: lookup.vlookup(
        t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.partial_nation, "n_nationkey", "n_name", "-"),
    "SELECT c_custkey, c_nationkey, coalesce(n_name, '-') AS n_name_procv "
    "FROM customer LEFT JOIN {partial_nation} ON c_nationkey = n_nationkey")
add("vlookup_first_match",
    lambda t: lookup.vlookup(
        t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.supplier, "s_nationkey", "s_name",
        order_by=["s_suppkey"]),
    "SELECT c_custkey, c_nationkey, s_name_procv FROM customer LEFT JOIN "
    "(SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name_procv FROM supplier GROUP BY s_nationkey) "
    "ON c_nationkey = s_nationkey")
add("vlookup_all_matches",
    lambda t: lookup.vlookup(
        t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.supplier, "s_nationkey", "s_acctbal",
        on_duplicate="all"),
    "SELECT n_nationkey, n_name, s_acctbal AS s_acctbal_procv FROM nation "
    "LEFT JOIN supplier ON n_nationkey = s_nationkey")
add("vlookup_segment_revenue",
    lambda t: a.group_aggregate(
        lookup.vlookup(t.orders, "o_custkey", t.customer, "c_custkey", "c_mktsegment", "-")
        .where("o_totalprice > 100000"), "c_mktsegment_procv", "o_totalprice", "sum")
    .select("c_mktsegment_procv", F.round("o_totalprice", 2).alias("o_totalprice")),
    "SELECT coalesce(c_mktsegment, '-') AS c_mktsegment_procv, round(sum(o_totalprice), 2) AS o_totalprice "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
for _func, _sql in (("soma", "round(sum(s_acctbal), 2)"), ("media", "round(avg(s_acctbal), 4)"),
                    ("contagem", "count(s_acctbal)"), ("min", "min(s_acctbal)"), ("max", "max(s_acctbal)"),
                    ("mediana", "round(median(s_acctbal), 4)")):
    _english = {"soma": "sum", "media": "mean", "contagem": "count", "mediana": "median"}.get(_func, _func)
    _digits = {"soma": 2, "media": 4, "mediana": 4}.get(_func)
    add(f"vlookup_agg_{_english}",
        lambda t, f=_func, d=_digits: (
            lambda r: r.withColumn(f"s_acctbal_{f}", F.round(f"s_acctbal_{f}", d)) if d else r)(
            lookup.vlookup_agg(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey",
                               t.supplier, "s_nationkey", "s_acctbal", f)),
        f"SELECT c_custkey, c_nationkey, s_acctbal_{_func} FROM customer LEFT JOIN "
        f"(SELECT s_nationkey, {_sql} AS s_acctbal_{_func} FROM supplier GROUP BY s_nationkey) "
        f"ON c_nationkey = s_nationkey")
add("match_positions",
    lambda t: order.match_positions(t.orders, "1-URGENT", "o_orderpriority", ["o_totalprice", "o_orderkey"]),
    "SELECT position FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 "
    "AS position FROM orders) WHERE o_orderpriority = '1-URGENT'")
add("match_positions_first",
    lambda t: order.match_positions(t.orders, "1-URGENT", "o_orderpriority", ["o_totalprice", "o_orderkey"], first=True),
    "SELECT min(position) AS position FROM (SELECT o_orderpriority, row_number() OVER "
    "(ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders) WHERE o_orderpriority = '1-URGENT'")
add("index_at",
    lambda t: order.index_at(t.orders, "o_custkey", 42, ["o_totalprice", "o_orderkey"]),
    "SELECT o_custkey AS value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 41")
add("index_at_deep",
    lambda t: order.index_at(t.lineitem.select("l_extendedprice", "l_quantity", "l_orderkey", "l_partkey", "l_tax"),
                             "l_extendedprice", 30000, ["l_extendedprice"]),
    "SELECT max(v) AS value FROM (SELECT l_extendedprice AS v FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 29999)")
add("index_match_column",
    lambda t: lookup.index_match_column(
        t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", "o_custkey", "o_orderkey",
        ["o_orderkey"]),
    "SELECT a.o_orderkey, a.o_custkey, a.o_orderpriority, b.o_orderpriority AS o_orderpriority_indice "
    "FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_orderkey")
add("index_match_value",
    lambda t: lookup.index_match_value(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "P", "o_orderstatus", ["o_orderkey"]),
    "SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT arg_min(o_custkey, o_orderkey) FROM orders "
    "WHERE o_orderstatus = 'P') AS o_custkey_indice FROM orders")

# ---- aggregates
for _func, _sql, _digits in (
    ("sum", "round(sum(l_extendedprice), 2)", 2), ("mean", "round(avg(l_extendedprice), 4)", 4),
    ("count", "count(l_extendedprice)", None), ("min", "min(l_extendedprice)", None),
    ("max", "max(l_extendedprice)", None), ("median", "round(median(l_extendedprice), 4)", 4),
    ("std", "round(stddev_samp(l_extendedprice), 4)", 4), ("var", "round(var_samp(l_extendedprice), 0)", 0),
    ("nunique", "count(DISTINCT l_extendedprice)", None),
):
    add(f"group_aggregate_{_func}",
        lambda t, f=_func, d=_digits: (
            lambda r: r.withColumn("l_extendedprice", F.round("l_extendedprice", d)) if d is not None else r)(
            a.group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", f)),
        f"SELECT l_returnflag, l_linestatus, {_sql} AS l_extendedprice FROM lineitem GROUP BY 1, 2")
for _func, _sql in (("first", "arg_min"), ("last", "arg_max")):
    add(f"group_aggregate_{_func}",
        lambda t, f=_func: a.group_aggregate(t.orders, "o_custkey", "o_totalprice", f, ["o_orderkey"]),
        f"SELECT o_custkey, {_sql}(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
add("group_aggregate_null_keys",
    lambda t: a.group_aggregate(t.dirty_customer, "segment", "acctbal", "count"),
    "SELECT segment, count(acctbal) AS acctbal FROM {dirty_customer} GROUP BY segment")
add("group_aggregate_drop_null_keys",
    lambda t: a.group_aggregate(t.dirty_customer, "segment", "acctbal", "count", drop_null_keys=True),
    "SELECT segment, count(acctbal) AS acctbal FROM {dirty_customer} WHERE segment IS NOT NULL GROUP BY segment")
add("count_rows",
    lambda t: a.count_rows(t.lineitem, "l_quantity > 25"),
    "SELECT count(*) AS total FROM lineitem WHERE l_quantity > 25")
add("column_stats",
    lambda t: a.column_stats(t.dirty_customer, "acctbal").select(
        F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "minimum", "maximum",
        F.round("std", 4).alias("std"), "n"),
    "SELECT round(avg(acctbal), 4) AS mean, round(median(acctbal), 4) AS median, min(acctbal) AS minimum, "
    "max(acctbal) AS maximum, round(stddev_samp(acctbal), 4) AS std, count(acctbal) AS n FROM {dirty_customer}")
add("count_if",
    lambda t: a.count_if(t.dirty_customer, "acctbal", ">1000"),
    "SELECT count(*) FILTER (WHERE acctbal > 1000) AS result FROM {dirty_customer}")
add("count_if_text",
    lambda t: a.count_if(t.dirty_customer, "segment", "!=Building"),
    "SELECT count(*) FILTER (WHERE upper(trim(segment)) <> 'BUILDING') AS result FROM {dirty_customer}")
add("sum_if",
    lambda t: a.sum_if(t.dirty_customer, "acctbal", "segment", "machinery").select(F.round("result", 2).alias("result")),
    "SELECT round(coalesce(sum(acctbal) FILTER (WHERE upper(trim(segment)) = 'MACHINERY'), 0.0), 2) AS result "
    "FROM {dirty_customer}")
_NUMBER = "TRY_CAST(trim(acctbal_text) AS DOUBLE)"
for _name, _run, _sql in (
    ("col_max", a.col_max, f"max({_NUMBER})"), ("col_min", a.col_min, f"min({_NUMBER})"),
    ("col_mean", a.col_mean, f"round(avg({_NUMBER}), 4)"), ("col_sum", a.col_sum, f"round(sum({_NUMBER}), 4)"),
):
    add(_name,
        lambda t, r=_run: r(t.dirty_customer, "acctbal_text").select(F.round("result", 4).alias("result")),
        f"SELECT {_sql} AS result FROM {{dirty_customer}}")
add("harmonic_mean",
    lambda t: a.harmonic_mean(t.dirty_customer, "acctbal").select(F.round("result", 6).alias("result")),
    "SELECT round(count(*) / sum(1.0 / acctbal), 6) AS result FROM {dirty_customer} WHERE acctbal > 0")
add("corr_pearson",
    lambda t: correlation.corr_pearson(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("result", 8).alias("result")),
    "SELECT round(corr(l_quantity, l_extendedprice), 8) AS result FROM lineitem")
add("corr_spearman",
    lambda t: correlation.corr_spearman(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("result", 8).alias("result")),
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, "
    "rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) "
    "SELECT round(corr(a, b), 8) AS result FROM r")
_KENDALL = (
    "WITH p AS (SELECT sign(x.c_nationkey - y.c_nationkey) AS a, sign(x.c_acctbal - y.c_acctbal) AS b "
    "FROM customer x JOIN customer y ON x.c_custkey < y.c_custkey) "
    "SELECT round(sum(a * b) / sqrt(CAST(sum(abs(a)) AS DOUBLE) * sum(abs(b))), 8) AS result FROM p")
for _name, _rows in (("corr_kendall", None), ("corr_kendall_blocked", 100)):
    add(_name,
        lambda t, k=_rows: correlation.corr_kendall(
            t.customer, "c_nationkey", "c_acctbal", **({"block_rows": k} if k else {})
        ).select(F.round("result", 8).alias("result")),
        _KENDALL)
add("corr_methods_agree",
    lambda t: correlation.correlate(t.lineitem, "l_quantity", "l_quantity", "kendall").select(F.round("result", 8).alias("result")),
    "SELECT round(corr(l_quantity, l_quantity), 8) AS result FROM lineitem")
add("group_count_distinct",
    lambda t: a.group_count_distinct(t.dirty_customer),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM {{dirty_customer}}"
        for c in ("c_custkey", "c_nationkey", "segment", "acctbal", "acctbal_text", "empty_col", "code_like")))

# ---- duplicates
add("mark_duplicates",
    lambda t: dedup.mark_duplicates(t.dup_orders, ["o_orderkey", "copy_no"], ["o_custkey", "o_orderstatus"]),
    "SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderstatus)) "
    "ORDER BY o_orderkey, copy_no) > 1 AS _duplicata FROM {dup_orders}")
add("drop_duplicates_normalized",
    lambda t: dedup.drop_duplicates_normalized(t.dup_orders, ["o_orderkey", "copy_no"], ["o_custkey", "o_orderstatus"]),
    "SELECT * FROM {dup_orders} QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderstatus)) "
    "ORDER BY o_orderkey, copy_no) = 1")
add("drop_duplicates_exact",
    lambda t: dedup.drop_duplicates_exact(t.dup_orders, ["o_custkey", "o_orderstatus"], ["o_orderkey", "copy_no"]),
    "SELECT * FROM {dup_orders} QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus "
    "ORDER BY o_orderkey, copy_no) = 1")
add("drop_duplicates_whole_rows",
    lambda t: dedup.drop_duplicates_exact(t.exact_copies),
    "SELECT DISTINCT * FROM {exact_copies}")
add("drop_duplicates_keep_last",
    lambda t: dedup.drop_duplicates_keep_last(t.dup_orders, ["o_orderkey", "copy_no"], ["o_custkey"]),
    "SELECT * FROM {dup_orders} QUALIFY row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderkey DESC, copy_no DESC) = 1")

# ---- order
add("global_row_index",
    lambda t: order.global_row_index(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]),
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
add("average_rank",
    lambda t: order.average_rank(t.orders.select("o_orderkey", "o_custkey"), "o_custkey"),
    "SELECT o_orderkey, o_custkey, rank() OVER (ORDER BY o_custkey) + "
    "(count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rank FROM orders")
add("sort_rows",
    lambda t: order.sort_rows(t.dirty_customer, ["segment", "absent", "acctbal"], ascending=False),
    "SELECT * FROM {dirty_customer} ORDER BY segment DESC NULLS LAST, acctbal DESC NULLS LAST")
add("keep_first_n",
    lambda t: order.keep_first_n(t.orders, 100, ["o_totalprice", "o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
add("keep_last_n",
    lambda t: order.keep_last_n(t.orders, 100, ["o_totalprice", "o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
add("keep_first_n_large",
    lambda t: order.keep_first_n(t.lineitem.select("l_extendedprice"), 20000, ["l_extendedprice"]),
    "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 20000")

# ---- nulls, values
add("fill_null_median",
    lambda t: clean.fill_null_median(t.dirty_customer.select("c_custkey", "acctbal"), ["acctbal"])
    .select("c_custkey", F.round("acctbal", 4).alias("acctbal")),
    "SELECT c_custkey, round(coalesce(acctbal, (SELECT median(acctbal) FROM {dirty_customer})), 4) AS acctbal "
    "FROM {dirty_customer}")
add("fill_null_mode",
    lambda t: clean.fill_null_mode(t.dirty_customer.select("c_custkey", "segment"), ["segment"]),
    "SELECT c_custkey, coalesce(segment, (SELECT segment FROM {dirty_customer} WHERE segment IS NOT NULL "
    "GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM {dirty_customer}")
add("fill_null_constant",
    lambda t: clean.fill_null_constant(
        t.dirty_customer.select("c_custkey", "segment", "acctbal"), {"segment": "SEM SEGMENTO", "acctbal": 0.0}),
    "SELECT c_custkey, coalesce(segment, 'SEM SEGMENTO') AS segment, coalesce(acctbal, 0.0) AS acctbal "
    "FROM {dirty_customer}")
add("drop_null_rows",
    lambda t: clean.drop_null_rows(t.dirty_customer, ["segment", "acctbal"]),
    "SELECT * FROM {dirty_customer} WHERE segment IS NOT NULL AND acctbal IS NOT NULL")
add("drop_empty_columns",
    lambda t: clean.drop_empty_columns(t.dirty_customer),
    "SELECT c_custkey, c_nationkey, segment, acctbal, acctbal_text, code_like FROM {dirty_customer}")
add("replace_values",
    lambda t: clean.replace_values(t.dirty_customer.select("c_custkey", "segment"), ["segment"],
                                   {"N/A": "SEM DADO", "BUILDING": "OBRA"}),
    "SELECT c_custkey, CASE segment WHEN 'N/A' THEN 'SEM DADO' WHEN 'BUILDING' THEN 'OBRA' ELSE segment END "
    "AS segment FROM {dirty_customer}")
_FIFTH = "o_totalprice * o_totalprice * o_totalprice * o_totalprice * o_totalprice AS fifth"
add("outliers_iqr",
    lambda t: clean.outliers_iqr(t.orders.selectExpr("o_orderkey", _FIFTH), "fifth").select("o_orderkey"),
    f"WITH v AS (SELECT o_orderkey, {_FIFTH} FROM orders), "
    "q AS (SELECT quantile_cont(fifth, 0.25) AS q1, quantile_cont(fifth, 0.75) AS q3 FROM v) "
    "SELECT o_orderkey FROM v, q WHERE fifth < q1 - 1.5 * (q3 - q1) OR fifth > q3 + 1.5 * (q3 - q1)")
add("unify_values",
    lambda t: clean.unify_values(t.dirty_customer.select("c_custkey", "segment"), "segment",
                                 {"CONSTRUCAO": ["building", "N/A"], "MAQUINAS": ["Machinery "]}),
    "SELECT c_custkey, CASE WHEN upper(trim(segment)) IN ('BUILDING', 'N/A') THEN 'CONSTRUCAO' "
    "WHEN upper(trim(segment)) = 'MACHINERY' THEN 'MAQUINAS' ELSE segment END AS segment FROM {dirty_customer}")
