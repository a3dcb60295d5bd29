"""Run steps on a stream: those that look at one row at a time, and lookups in static tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..plans.steps import StepRun, run_steps

# Steps that neither count, sort nor compare rows of the stream with one another.
ROW_STEPS = frozenset({
    "formatar_brasileiro", "numero_interno", "unificar_valores", "remover_nulos", "substituir_valores",
    "substituir_regex", "normalizar_texto", "corrigir_tipo", "adicionar_coluna", "coluna_calculada",
    "renomear_coluna", "remover_coluna", "filtrar_linhas", "reordenar_colunas", "procv", "procv_agrupado",
    "esquerda", "direita", "meio", "tamanho", "concatenar", "substituir_texto", "se", "arred", "valor",
    "juntar",
})


def stream_steps(
    stream: DataFrame, steps: Sequence[Mapping], tables: Mapping[str, DataFrame] | None = None
) -> StepRun:
    """``run_steps`` for a streaming table; a step that would need the whole stream is refused."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table")
    for step in steps:
        params = step.get("params") or {}
        whole = step.get("operacao") not in ROW_STEPS or params.get("agregados")
        outer = step.get("operacao") == "juntar" and params.get("tipo", "left") not in ("left", "inner")
        if whole or outer:
            raise ValueError(f"step needs the whole table: {step.get('operacao')!r}")
    return run_steps(stream, steps, tables, on_error="raise")
