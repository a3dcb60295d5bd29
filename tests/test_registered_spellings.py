"""The registered scans with the check of spellings."""

from pyspark.sql import functions as F

from tidymill.catalog import profile_queries  # noqa: F401
from tidymill.catalog.registry import QUERIES, Tables
from tidymill.operators import fuzzy


def test_registered_scan_compares_spellings(spark, folder):
    tables = Tables(spark, folder)
    found = QUERIES["scan_table_spellings"].run(tables).where("category = 'FUZZY_MATCH'").collect()
    groups = fuzzy.fuzzy_groups(tables.dirty_customer.where("acctbal_text IS NOT NULL"), "acctbal_text")
    sizes = groups.groupBy("group").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1")
    assert {r["column"]: r["n_rows"] for r in found} == {"acctbal_text": sizes.agg(F.sum("n")).first()[0]}
    steps = QUERIES["suggest_steps_spellings"].run(tables).where("operation = 'unificar_valores'").collect()
    assert [r["params"] for r in steps] == ['{"coluna":"acctbal_text","tabela":"unificar:acctbal_text"}']
