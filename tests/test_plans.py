"""What the plans look like: no single-partition windows, no Python, no cross joins in the hot path."""

import pytest

from tidymill.catalog import column_queries, profile_queries, source_queries, table_queries  # noqa: F401
from tidymill.catalog.registry import QUERIES, Tables
from tidymill.operators import clean, columns, dedup, lookup
from tidymill.streaming.incremental import stream_steps

PYTHON_QUERIES = {"parquet_batches"}
LAZY = sorted(set(QUERIES) - {"apply_suggestions"})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "vlookup", "vlookup_first_match", "vlookup_agg_sum", "equi_join_outer", "index_match_column", "mark_duplicates",
    "drop_duplicates_normalized", "drop_duplicates_keep_last", "group_aggregate_nunique", "group_aggregate_median",
    "profile_nulls", "profile_whitespace", "profile_column_repeats", "unify_values", "parse_br_number", "scan_table",
    "global_row_index", "average_rank", "fuzzy_pairs", "fuzzy_groups", "validate_table", "initial_snapshot",
])
def test_plan(spark, folder, name):
    text = plan_of(QUERIES[name].run(Tables(spark, folder)))
    assert "Window" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_row_steps_do_not_shuffle(spark, folder):
    t = Tables(spark, folder)
    df = columns.upper_trim_text(columns.parse_br_number(t.dirty_customer, ["acctbal_text"]), ["segment"])
    df = clean.replace_values(columns.if_else(df, "acctbal > 0", 1, 0), ["segment"], {"N/A": ""})
    assert "Exchange" not in plan_of(df)


def test_filter_and_columns_reach_the_scan(spark, folder):
    t = Tables(spark, folder)
    text = plan_of(columns.filter_rows(t.orders, "o_totalprice > 100").select("o_orderkey"))
    assert "GreaterThan(o_totalprice,100.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_outlier_limits_reach_the_scan(spark, folder):
    assert "PushedFilters: [Or(LessThan(" in plan_of(clean.outliers_iqr(Tables(spark, folder).orders, "o_totalprice"))


def test_lookup_side_is_reduced_before_the_join(spark, folder):
    t = Tables(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(lookup.vlookup(t.orders, "o_custkey", t.customer, "c_custkey", "c_name"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "partial_min_by" in text and "SortMergeJoin" in text


def test_duplicates_combine_before_the_shuffle(spark, folder):
    assert "partial_min_by" in plan_of(
        dedup.drop_duplicates_normalized(Tables(spark, folder).dup_orders, ["o_orderkey", "copy_no"], ["o_custkey"]))


RECIPE = [
    {"operacao": "normalizar_texto", "params": {"colunas": ["c_mktsegment"], "modo": "lower"}},
    {"operacao": "filtrar_linhas", "params": {"condicao": "c_acctbal > 0"}},
    {"operacao": "formatar_brasileiro", "params": {"colunas": ["c_acctbal"]}},
    {"operacao": "procv", "params": {"tabela_origem": "nation", "coluna_chave": "c_nationkey",
                                     "coluna_chave_origem": "n_nationkey", "coluna_valor_origem": "n_name"}},
    {"operacao": "esquerda", "params": {"coluna": "n_name_procv", "n": 3, "nova_coluna": "short"}},
]


def test_steps_on_a_stream(spark, folder, tmp_path):
    from tidymill.plans.steps import run_steps

    t = Tables(spark, folder)
    t.customer.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.customer.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_steps(stream, RECIPE, {"nation": t.nation}).table
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    want = run_steps(t.customer, RECIPE, {"nation": t.nation}, on_error="raise").table
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        stream_steps(stream, [{"operacao": "manter_n_primeiras", "params": {"n": 1}}])
    with pytest.raises(ValueError):
        stream_steps(t.customer, RECIPE)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_mktsegment_procv", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
