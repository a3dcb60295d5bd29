"""Steps suggested by the issues of a scan."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import parse_br_number
from ..functions.refs import col, dtype
from ..functions.text import as_text, trim_ws
from ..operators.fuzzy import suggest_unification
from ..operators.profile import scan_table
from ..scratch import write_out
from .steps import StepRun, run_steps


# The rules in the order their steps run, as (category, operation, one step for all
# columns or one for each).
_RULES = (
    ("NULOS", "remover_colunas_vazias", "all"),
    ("COLUNA_VAZIA", "remover_colunas_vazias", "all"),
    ("DUPLICATAS", "remover_duplicatas", "all"),
    ("FORMATO_ESPECIAL", "numero_interno", "all"),
    ("VALOR_SUSPEITO", "substituir_valores", "each"),
    ("TEXTO_ESPACO", "normalizar_texto", "all"),
    ("FUZZY_MATCH", "unificar_valores", "each"),
)


# The mapping of a column is a table under this name, so it never passes through a cell or the driver.
UNIFY = "unificar:"


def _params() -> dict[str, Column]:
    """The parameters of each category's step, as JSON, from the group's columns and details."""
    columns, details = F.col("columns"), F.col("details")
    placeholders = F.map_keys(F.from_json(details["valores"], "map<string,bigint>"))
    blanks = F.map_from_arrays(placeholders, F.transform(placeholders, lambda _: F.lit("")))
    drop_empty = F.struct(F.lit(1.0).alias("limiar"))
    structs = {
        "NULOS": drop_empty,
        "COLUNA_VAZIA": drop_empty,
        "DUPLICATAS": F.struct(F.lit(True).alias("normalizar")),
        "FORMATO_ESPECIAL": F.struct(
            columns.alias("colunas"), F.lit(6).alias("casas"), F.lit(True).alias("marcas")),
        "VALOR_SUSPEITO": F.struct(
            columns.alias("colunas"), blanks.alias("mapeamento"), F.lit(True).alias("normalizar")),
        "TEXTO_ESPACO": F.struct(columns.alias("colunas"), F.lit("upper").alias("modo")),
        "FUZZY_MATCH": F.struct(columns[0].alias("coluna"), F.concat(F.lit(UNIFY), columns[0]).alias("tabela")),
    }
    return {category: F.to_json(params) for category, params in structs.items()}


def suggest_steps(issues: DataFrame) -> DataFrame:
    """Rows ``(rule, operation, params, description)``, in the order they should run.

    One pass over the issues. There is one issue per finding and column, so gathering the columns
    of a category is of schema size.
    """
    category = F.col("category")
    each = [c for c, _, kind in _RULES if kind == "each"]
    groups = issues.where(category.isin([c for c, _, _ in _RULES])).groupBy(
        "category", F.when(category.isin(each), F.col("column")).alias("only")
    ).agg(
        F.array_sort(F.collect_set("column")).alias("columns"),
        F.max_by("details", "column").alias("details"),
    )
    rule, operation, params = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (name, step, _) in enumerate(_RULES, 1):
        rule = F.when(category == name, F.lit(number)).otherwise(rule)
        operation = F.when(category == name, F.lit(step)).otherwise(operation)
        params = F.when(category == name, _params()[name]).otherwise(params)
    description = F.concat(category, F.lit(": "), F.concat_ws(", ", "columns"))
    return groups.select(
        rule.alias("rule"), operation.alias("operation"), params.alias("params"),
        description.alias("description"),
    ).orderBy("rule", "description")


def as_steps(suggested: DataFrame) -> list[dict]:
    """The suggestions as step dicts, ready for ``run_steps``."""
    return [
        {"operacao": r["operation"], "params": json.loads(r["params"])}
        for r in suggested.orderBy("rule", "description").collect()
    ]


def _losing_columns(df: DataFrame, step: Mapping) -> list[str]:
    """Columns of a number step with a filled cell that the step would turn into null; one pass."""
    params = step["params"]
    tests = []
    for name in params["colunas"]:
        filled = trim_ws(as_text(col(name), dtype(df, name))) != ""
        number = parse_br_number(col(name), dtype(df, name), params.get("casas", 2), params.get("marcas", False))
        tests.append(F.coalesce(F.max(filled & number.isNull()), F.lit(False)).alias(name))
    found = df.agg(*tests).first().asDict()
    return [name for name in params["colunas"] if found[name]]


def apply_suggestions(
    df: DataFrame, order_by: Sequence, fuzzy: bool = True, columns: Sequence[str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> StepRun:
    """Scan the table, take the suggested steps and run them.

    Nothing is lost: a column that holds text besides numbers is left as it is, and spellings are
    unified by the groups of ``suggest_unification`` only, which are closer than those an issue counts.
    ``columns`` limits the scan, so that key columns need not be searched for issues.
    """
    scanned = df.select(*columns) if columns else df
    steps, known = [], dict(tables or {})
    for step in as_steps(suggest_steps(write_out(scan_table(scanned, fuzzy=fuzzy), "issues"))):
        params = step["params"]
        if step["operacao"] == "numero_interno":
            losing = _losing_columns(df, step)
            params["colunas"] = [c for c in params["colunas"] if c not in losing]
            if not params["colunas"]:
                continue
        if str(params.get("tabela", "")).startswith(UNIFY):
            known[params["tabela"]] = suggest_unification(df, params["coluna"])
        steps.append(step)
    return run_steps(df, steps, known, order_by)
