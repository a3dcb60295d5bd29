"""Run an ordered list of steps ``{"operacao": name, "params": {...}}`` over a table.

The run folds the steps into one lazy plan. Steps that need a bounded fact of the data first
(a median, the empty columns, positions) run a job while the plan is built.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate, clean, columns, correlation, dedup, fuzzy, lookup, order


# The steps after which there may be more or fewer rows.
ROW_STEPS = {
    "remover_duplicatas", "remover_nulos", "filtrar_linhas", "manter_n_primeiras", "manter_n_ultimas", "juntar",
    "agregar",
}


@dataclass
class StepResult:
    """``value`` holds the answer of a step that asks something and leaves the table alone."""

    number: int
    operation: str
    ok: bool
    message: str
    value: DataFrame | None = None


@dataclass
class StepContext:
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    order_by: Sequence | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"table not found: {name}")
        return self.tables[name]

    def order(self, params: Mapping) -> Sequence:
        order_by = params.get("order_by") or self.order_by
        if not order_by:
            raise ValueError("this step depends on row order: give order_by")
        return order_by


Step = Callable[[DataFrame, Mapping, StepContext], DataFrame]

# Steps that make a new table. Names and parameters are the fixed values of the recipe format.
TABLE_STEPS: dict[str, Step] = {
    "formatar_brasileiro": lambda df, p, x: columns.format_br_number(df, p["colunas"], p.get("casas", 2)),
    "numero_interno": lambda df, p, x: columns.parse_br_number(
        df, p["colunas"], p.get("casas", 2), p.get("marcas", False)),
    "detectar_duplicatas": lambda df, p, x: dedup.mark_duplicates(
        df, x.order(p), p.get("colunas"), p.get("normalizar", True)),
    "remover_duplicatas": lambda df, p, x: _drop_duplicates(df, p, x),
    "unificar_valores": lambda df, p, x: clean.unify_values(
        df, p["coluna"], x.table(p["tabela"]) if "tabela" in p else p["mapeamento"]),
    "remover_colunas_vazias": lambda df, p, x: clean.drop_empty_columns(df, p.get("limiar", 1.0)),
    "preencher_nulos": lambda df, p, x: clean.fill_nulls(df, p["estrategias"]),
    "remover_nulos": lambda df, p, x: clean.drop_null_rows(df, p["colunas"]),
    "substituir_valores": lambda df, p, x: clean.replace_values(
        df, p["colunas"], p["mapeamento"], p.get("normalizar", False)),
    "substituir_regex": lambda df, p, x: columns.replace_regex(df, p["colunas"], p["padrao"], p["novo"]),
    "normalizar_texto": lambda df, p, x: {
        "upper": columns.upper_trim_text, "lower": columns.lower_trim_text,
    }[p.get("modo", "upper")](df, p["colunas"]),
    "corrigir_tipo": lambda df, p, x: columns.cast_types(df, p["tipos"]),
    "adicionar_coluna": lambda df, p, x: (
        columns.add_expression_column(df, p["nome"], p["expressao"], p.get("agregados"))
        if "expressao" in p else columns.add_constant_column(df, p["nome"], p.get("valor", ""))),
    "coluna_calculada": lambda df, p, x: columns.add_expression_column(
        df, p["nome"], p["expressao"], p.get("agregados")),
    "renomear_coluna": lambda df, p, x: columns.rename_columns(df, p["mapeamento"]),
    "remover_coluna": lambda df, p, x: columns.drop_columns(df, p["colunas"]),
    "filtrar_linhas": lambda df, p, x: columns.filter_rows(df, p["condicao"]),
    "ordenar_por": lambda df, p, x: order.sort_rows(df, p["colunas"], p.get("ascendente", True)),
    "reordenar_colunas": lambda df, p, x: columns.reorder_columns(df, p["ordem"]),
    "manter_n_primeiras": lambda df, p, x: order.keep_first_n(df, p["n"], x.order(p)),
    "manter_n_ultimas": lambda df, p, x: order.keep_last_n(df, p["n"], x.order(p)),
    "procv": lambda df, p, x: lookup.vlookup(
        df, p["coluna_chave"], x.table(p["tabela_origem"]), p["coluna_chave_origem"],
        p["coluna_valor_origem"], p.get("padrao", ""), p.get("order_by")),
    "procv_agrupado": lambda df, p, x: lookup.vlookup_agg(
        df, p["coluna_chave"], x.table(p["tabela_origem"]), p["coluna_chave_origem"],
        p["coluna_valor_origem"], p.get("funcao", "soma")),
    "esquerda": lambda df, p, x: columns.left_text(df, p["coluna"], p["n"], p.get("nova_coluna")),
    "direita": lambda df, p, x: columns.right_text(df, p["coluna"], p["n"], p.get("nova_coluna")),
    "meio": lambda df, p, x: columns.mid_text(df, p["coluna"], p["inicio"], p["n"], p.get("nova_coluna")),
    "tamanho": lambda df, p, x: columns.text_length(df, p["coluna"], p.get("nova_coluna")),
    "concatenar": lambda df, p, x: columns.concat_columns(
        df, p["colunas"], p.get("separador", ""), p.get("nova_coluna", "concat")),
    "substituir_texto": lambda df, p, x: columns.substitute_text(
        df, p["coluna"], p["antigo"], p["novo"], p.get("nova_coluna")),
    "se": lambda df, p, x: columns.if_else(
        df, p["condicao"], p["valor_verdadeiro"], p["valor_falso"], p.get("nova_coluna", "resultado_se")),
    "arred": lambda df, p, x: columns.round_number(df, p["coluna"], p.get("casas", 0), p.get("nova_coluna")),
    "valor": lambda df, p, x: columns.text_to_number(df, p["coluna"], p.get("nova_coluna")),
    "indice_corresp": lambda df, p, x: _index_match(df, p, x),
    "juntar": lambda df, p, x: lookup.equi_join(df, x.table(p["tabela"]), p["coluna_chave"], p.get("tipo", "left")),
    "agregar": lambda df, p, x: aggregate.group_aggregate(
        df, p["colunas_grupo"], p["coluna_alvo"], p.get("funcao", "sum"),
        p.get("order_by") or x.order_by, p.get("descartar_nulos", False)),
}

# Steps that answer a question and leave the table as it is.
QUESTION_STEPS: dict[str, Step] = {
    "valores_similares": lambda df, p, x: fuzzy.fuzzy_pairs(df, p["coluna"], p.get("limiar", 0.85)),
    "corresp": lambda df, p, x: order.match_positions(df, p["valor"], p["coluna_busca"], x.order(p)),
    "cont_se": lambda df, p, x: aggregate.count_if(df, p["coluna"], p["criterio"]),
    "somase": lambda df, p, x: aggregate.sum_if(df, p["coluna_valores"], p["coluna_criterios"], p["criterio"]),
    "indice": lambda df, p, x: order.index_at(df, p["coluna"], p["posicao"], x.order(p), "result"),
    "maximo": lambda df, p, x: aggregate.col_max(df, p["coluna"]),
    "minimo": lambda df, p, x: aggregate.col_min(df, p["coluna"]),
    "media": lambda df, p, x: aggregate.col_mean(df, p["coluna"]),
    "soma": lambda df, p, x: aggregate.col_sum(df, p["coluna"]),
    "harmonica": lambda df, p, x: aggregate.harmonic_mean(df, p["coluna"]),
    "correl": lambda df, p, x: correlation.correlate(df, p["col_a"], p["col_b"], p.get("metodo", "pearson")),
    "pearson": lambda df, p, x: correlation.corr_pearson(df, p["col_a"], p["col_b"]),
    "spearman": lambda df, p, x: correlation.corr_spearman(df, p["col_a"], p["col_b"]),
}


def _drop_duplicates(df: DataFrame, p: Mapping, x: StepContext) -> DataFrame:
    if p.get("normalizar", True):
        return dedup.drop_duplicates_normalized(df, x.order(p), p.get("colunas"))
    return dedup.drop_duplicates_exact(df, p.get("colunas"), x.order(p) if p.get("colunas") else None)


def _index_match(df: DataFrame, p: Mapping, x: StepContext) -> DataFrame:
    wanted = p["valor_procurado"]
    find = (
        lookup.index_match_column if isinstance(wanted, str) and wanted in df.columns
        else lookup.index_match_value
    )
    return find(df, p["coluna_retorno"], wanted, p["coluna_busca"], x.order(p))


@dataclass
class StepRun:
    """The table after all steps, one result per step, and the row counts seen on the way."""

    table: DataFrame
    results: list[StepResult]
    _seen: list[tuple[str, DataFrame | None, list[str], list[str]]] = field(default_factory=list)

    def results_table(self) -> DataFrame:
        rows = [(r.number, r.operation, r.ok, r.message) for r in self.results]
        return self.table.sparkSession.createDataFrame(
            rows, "number int, operation string, ok boolean, message string"
        )

    def history(self) -> DataFrame:
        """Rows and columns before and after each step, for a run with ``observe``.

        Steps that keep every row take the count before them. The other tables are counted by one
        query, as one row each, so shuffles that several of them need are done once, and the counts are
        complete and alike on every call, whatever later steps leave.
        """
        counted = [
            table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(number).alias("number"), "n")
            for number, (_, table, _, _) in enumerate(self._seen) if table is not None
        ]
        counts = dict(map(tuple, functools.reduce(DataFrame.union, counted).collect())) if counted else {}
        rows, before = [], None
        for number, (operation, _, old, new) in enumerate(self._seen):
            after = counts.get(number, before)
            if number:
                added = [c for c in new if c not in old]
                removed = [c for c in old if c not in new]
                rows.append((number, operation, before, after, len(old), len(new), added, removed))
            before = after
        return self.table.sparkSession.createDataFrame(
            rows,
            "number int, operation string, rows_before bigint, rows_after bigint, columns_before int, "
            "columns_after int, added array<string>, removed array<string>",
        )


def run_steps(
    df: DataFrame,
    steps: Sequence[Mapping],
    tables: Mapping[str, DataFrame] | None = None,
    order_by: Sequence | None = None,
    on_error: str = "continue",
    observe: bool = False,
) -> StepRun:
    """Apply the steps in order. A step that cannot be planned is reported and skipped, or raised
    with ``on_error="raise"``; a failure while rows are computed surfaces at the action.

    ``observe`` keeps the table after each step for ``history()``, which counts it when asked.
    """
    context = StepContext(dict(tables or {}), order_by)
    results, seen = [], []
    if observe:
        seen.append(("", df, df.columns, df.columns))
    for number, step in enumerate(steps, 1):
        operation, params = step.get("operacao", ""), step.get("params") or {}
        before = df.columns
        try:
            if operation in TABLE_STEPS:
                new = TABLE_STEPS[operation](df, params, context)
                new.schema  # a bad expression fails here, not at the action
                df, result = new, StepResult(number, operation, True, "ok")
            elif operation in QUESTION_STEPS:
                value = QUESTION_STEPS[operation](df, params, context)
                result = StepResult(number, operation, True, "ok", value)
            else:
                raise ValueError(f"operation not found: {operation!r}")
        except Exception as error:
            if on_error == "raise":
                raise
            text = str(error) if not isinstance(error, KeyError) else f"missing: {error}"
            result = StepResult(number, operation, False, text.splitlines()[0] if text else type(error).__name__)
        results.append(result)
        if observe and result.ok and operation in TABLE_STEPS:
            seen.append((operation, df if operation in ROW_STEPS else None, before, df.columns))
    return StepRun(df, results, seen)
