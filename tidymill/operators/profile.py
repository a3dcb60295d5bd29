"""Column diagnostics: aggregates per column, turned into issue rows by rules.

The checks run over the whole table. Text and number metrics come from one pass each over
(column, value) rows, which stays one narrow aggregate however many columns there are. Issue rows
are ``(category, column, severity, n_rows, pct, details)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import to_number
from ..functions.refs import col, is_float, is_number, is_text, text_columns
from ..functions.text import WHITE_SPACE, trim_ws, upper_trim
from ..scratch import in_background, write_out
from .aggregate import counted_by_kind, distinct_values
from .clean import null_counts
from .copies import count_copies
from .dedup import count_duplicate_rows
from .fuzzy import canonical_values, group_sizes, group_values, text_values
from .order import keep_first_n

# Severities and what they rank.
SEVERITY_RANK = {"critico": 3, "aviso": 2, "info": 1}

# Texts that stand for a missing value.
PLACEHOLDERS = (
    "", "-", "--", "---", ".", "..", "...", "N/A", "NA", "n/a",
    "NULL", "null", "None", "none", "SEM DADO", "SEM VALOR",
    "NAO INFORMADO", "NAO DISPONIVEL", "0000-00-00", "00/00/0000",
    "S/N", "SN", "NI", "NR", "N/D", "N/R",
)

# Patterns of numbers written as text.
ANY_NUMBER = r"^-?[0-9]+([.,][0-9]+)?$"
THOUSANDS_COMMA = r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"
MOST_DECIMALS = 6
UNNAMED = r"^(Unnamed|_c[0-9]+$)"

ALL_COLUMNS = "(todas as colunas)"

ISSUE_SCHEMA = (
    "category string, column string, severity string, n_rows bigint, pct double, "
    "details map<string,string>"
)


def _text_long(df: DataFrame) -> DataFrame:
    """(column, raw, n) with one row per non-null text cell."""
    pairs = [F.struct(F.lit(c).alias("column"), col(c).alias("raw")) for c in text_columns(df)]
    return df.select(F.inline(F.array(*pairs))).where(F.col("raw").isNotNull()).withColumn("n", F.lit(1))


def _number_long(df: DataFrame) -> DataFrame:
    """(column, x, digits, n) with one row per number cell; digits for whole-number types only."""
    pairs = []
    for f in df.schema.fields:
        if is_number(f.dataType):
            whole_type = isinstance(f.dataType, T.IntegralType)
            digits = F.char_length(col(f.name).cast("string")) if whole_type else F.lit(None).cast("int")
            x = to_number(col(f.name), f.dataType)
            pairs.append(F.struct(F.lit(f.name).alias("column"), x.alias("x"), digits.alias("digits")))
    return df.select(F.inline(F.array(*pairs))).where(F.col("x").isNotNull()).withColumn("n", F.lit(1))


def _weight(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def _text_metrics(long: DataFrame, *counts: Column) -> DataFrame:
    raw, t, numeric, decimals = F.col("raw"), F.col("t"), F.col("numeric"), F.col("decimals")
    mark = lambda c: F.contains(t, F.lit(c))
    cells = long.withColumn("t", trim_ws(raw)).withColumn("numeric", t.rlike(ANY_NUMBER)).withColumn(
        "decimals", F.when(numeric & (mark(".") | mark(",")), F.char_length(t) - F.greatest(
            F.instr(t, "."), F.instr(t, ",")))
    )
    few = decimals <= MOST_DECIMALS
    thousands = F.contains(raw, F.lit(".")) & F.contains(raw, F.lit(",")) & raw.rlike(THOUSANDS_COMMA)
    return cells.groupBy(F.col("column").alias("__c")).agg(
        *counts,
        _weight(few & mark(".")).alias("n_dot"),
        _weight(few & mark(",")).alias("n_comma"),
        _weight(numeric & decimals.isNull()).alias("n_whole_text"),
        # one to six digits after the dot, so this set has six members at most
        F.array_sort(F.collect_set(F.when(few & mark("."), decimals))).alias("places"),
        _weight(F.contains(raw, F.lit("R$"))).alias("n_currency"),
        _weight(F.contains(raw, F.lit("%"))).alias("n_percent"),
        _weight(thousands).alias("n_thousands"),
        _weight(numeric).alias("n_numeric"),
        F.min(F.when(numeric, t)).alias("numeric_min"),
        F.max(F.when(numeric, t)).alias("numeric_max"),
        F.min(F.when(~numeric, t)).alias("other_min"),
        F.max(F.when(~numeric, t)).alias("other_max"),
        _weight(raw != F.ltrim(raw, F.lit(WHITE_SPACE))).alias("n_leading"),
        _weight(raw != F.rtrim(raw, F.lit(WHITE_SPACE))).alias("n_trailing"),
        # numbers hold neither spaces nor letters, so nothing is tried on them
        _weight(~numeric & t.rlike(r"(?U)\s{2,}")).alias("n_inner"),
        _weight(numeric | (t == F.upper(t))).alias("n_upper"),
        _weight(numeric | (t == F.lower(t))).alias("n_lower"),
        _weight(numeric | (t == F.initcap(t))).alias("n_title"),
    )


def _number_metrics(long: DataFrame, *counts: Column) -> DataFrame:
    weight = F.when(F.col("digits").isNotNull(), F.col("n"))
    return long.groupBy(F.col("column").alias("__c")).agg(
        *counts,
        F.try_divide(F.sum(F.col("digits") * F.col("n")), F.sum(weight)).alias("mean_digits"),
        _weight(F.col("x") == F.floor("x")).alias("n_whole"),
    )


def _family(data_type: T.DataType) -> str:
    if is_text(data_type):
        return "text"
    if isinstance(data_type, T.IntegralType):
        return "int"
    return "float" if is_number(data_type) else "other"


def _with_parts(metrics: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    for part in parts:
        metrics = metrics.join(part, F.col("column") == F.col("__c"), "left").drop("__c")
    return metrics


def column_metrics(
    df: DataFrame, text: bool = False, number: bool = False, distinct: bool = False, approx: bool = False
) -> DataFrame:
    """One row per column; the optional parts are joined on by column name, so only the parts
    asked for are computed."""
    rows = []
    for f in df.schema.fields:
        value = to_number(col(f.name), f.dataType) if is_float(f.dataType) else col(f.name)
        parts = [
            F.lit(f.name).alias("column"), F.lit(_family(f.dataType)).alias("family"),
            F.count("*").alias("rows"), F.count_if(value.isNull()).alias("nulls"),
        ]
        if distinct and approx:
            parts.append(F.approx_count_distinct(value).alias("n_distinct"))
        rows.append(F.struct(*parts))
    metrics = df.agg(F.array(*rows).alias("m")).select(F.inline("m"))
    metrics = metrics.withColumn("filled", F.col("rows") - F.col("nulls"))
    extra = []
    if text and text_columns(df):
        extra.append(_text_metrics(_text_long(df)))
    if number and has_numbers(df):
        extra.append(_number_metrics(_number_long(df)))
    if distinct and not approx:
        counts = distinct_values(df, df.columns).groupBy(F.col("column").alias("__c"))
        extra.append(counts.agg(F.count("*").alias("n_distinct")))
    return _with_parts(metrics, extra)


def _counts() -> list[Column]:
    """What the metrics of every column hold, from its counted values."""
    return [F.sum("n").alias("__filled"), F.count("*").alias("n_distinct")]


def _metrics_of_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per number column, from its counted values, which stay numbers and are not written."""
    parts = []
    for counted in counted_by_kind(df, columns):
        whole = isinstance(counted.schema["value"].dataType, T.IntegralType)
        digits = F.char_length(F.col("value").cast("string")) if whole else F.lit(None).cast("int")
        parts.append(counted.select("column", F.col("value").cast("double").alias("x"), digits.alias("digits"), "n"))
    return _number_metrics(reduce(DataFrame.unionByName, parts), *_counts())


def _metrics_of_texts(values: DataFrame, texts: Sequence[str], others: Sequence[str]) -> DataFrame:
    """One row per column from counted values, so each pattern is tried once per distinct text rather than
    once per row. Columns that are neither text nor number are counted only."""
    parts = []
    if texts:
        found = values.where(F.col("column").isin(texts)) if others else values
        parts.append(_text_metrics(found.withColumnRenamed("value", "raw"), *_counts()))
    if others:
        found = values.where(F.col("column").isin(others))
        parts.append(found.groupBy(F.col("column").alias("__c")).agg(*_counts()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _joined_metrics(df: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """The metrics of all columns, with those of columns without any value."""
    families = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(_family(f.dataType)).alias("family"))
        for f in df.schema.fields
    ])
    base = df.agg(F.count("*").alias("rows")).select("rows", F.inline(families))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    metrics = _with_parts(base, [every]).withColumn("filled", F.coalesce("__filled", F.lit(0)))
    return metrics.withColumn("nulls", F.col("rows") - F.col("filled")).drop("__filled")


def has_numbers(df: DataFrame) -> bool:
    return any(is_number(f.dataType) for f in df.schema.fields)


def _issue(category: str, severity, n: Column, pct: Column, column: Column | None = None, **details) -> Column:
    entries = []
    for key, value in details.items():
        entries += [F.lit(key), value.cast("string")]
    return F.struct(
        F.lit(category).alias("category"),
        (F.col("column") if column is None else column).alias("column"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        n.cast("bigint").alias("n_rows"),
        F.round(pct, 2).cast("double").alias("pct"),
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("details"),
    )


def _share(n: Column, total: Column) -> Column:
    return F.try_divide(n * F.lit(100.0), total)


# ---- rules over one row of column_metrics; each gives an issue or null


def null_rule() -> Column:
    n, pct = F.col("nulls"), _share(F.col("nulls"), F.col("rows"))
    severity = F.when(pct > 30, "critico").when(pct > 10, "aviso").otherwise("info")
    return F.when(n > 0, _issue("NULOS", severity, n, pct, quantidade=n, percentual=F.round(pct, 2)))


def empty_rule() -> Column:
    n, total = F.col("nulls"), F.col("rows")
    severity = F.when(n == total, "critico").otherwise("aviso")
    return F.when((n == total) | (n > total * F.lit(0.9)), _issue("COLUNA_VAZIA", severity, n, _share(n, total)))


def repeats_rule() -> Column:
    unique = F.coalesce("n_distinct", F.lit(0))
    repeats = F.col("rows") - unique - F.when(F.col("nulls") > 0, 1).otherwise(0)
    return F.when(
        (repeats > 0) & (unique < F.col("rows") * F.lit(0.5)),
        _issue("DUPLICATA_COLUNA", "info", repeats, _share(repeats, F.col("rows")), unicos=unique, repetidos=repeats),
    )


def unnamed_rule() -> Column:
    return F.when(
        F.col("column").rlike(UNNAMED),
        _issue("COLUNA_UNNAMED", "aviso", F.col("rows"), F.lit(None).cast("double")),
    )


def decimal_mark_rule() -> Column:
    dot, comma, whole = F.col("n_dot"), F.col("n_comma"), F.col("n_whole_text")
    found = dict(
        qtd_ponto_decimal=dot, qtd_virgula_decimal=comma, qtd_inteiros=whole,
        casas_decimais=F.concat_ws(",", F.col("places").cast("array<string>")),
    )
    enough = (F.col("family") == "text") & (F.col("filled") >= 5) & (dot + comma + whole >= 3)
    mostly_dot = (dot > comma) & (dot >= 3)
    severity = F.when(mostly_dot, "aviso").otherwise("critico")
    return F.when(
        enough & (mostly_dot | ((dot > 0) & (comma > 0))),
        _issue("NUMERO_PONTO_DECIMAL", severity, dot, _share(dot, F.col("filled")), **found),
    )


def special_format_rule() -> Column:
    money, percent, thousands = F.col("n_currency"), F.col("n_percent"), F.col("n_thousands")
    names = F.concat_ws(
        ", ",
        F.when(money > 0, F.lit("moeda (R$)")),
        F.when(percent > 0, F.lit("porcentagem (%)")),
        F.when(thousands > 0, F.lit("milhar brasileiro (1.234,56)")),
    )
    n = F.greatest(money, percent, thousands)
    return F.when(n > 0, _issue("FORMATO_ESPECIAL", "info", n, _share(n, F.col("filled")), formatos=names))


def text_as_number_rule() -> Column:
    n, total = F.col("n_numeric"), F.col("filled")
    pct = _share(n, total)
    convert = (pct >= 80) & (n >= 10)
    severity = F.when(pct >= 50, "aviso").otherwise("info")
    advice = (
        F.when(convert, "numero/float")
        .when(pct >= 50, "verificar valores nao numericos antes de converter")
        .otherwise("verificar se a coluna deveria ser numero")
    )
    return F.when(
        (F.col("family") == "text") & (total >= 10) & (convert | ((pct >= 10) & (pct < 80))),
        _issue(
            "TIPO_TEXTO_NUMERO", severity, n, pct, sugestao=advice,
            exemplo_numerico_menor=F.col("numeric_min"), exemplo_numerico_maior=F.col("numeric_max"),
            exemplo_texto_menor=F.col("other_min"), exemplo_texto_maior=F.col("other_max"),
        ),
    )


def number_as_text_rule() -> Column:
    total = F.col("filled")
    unique = F.coalesce("n_distinct", F.lit(0))
    whole = F.col("n_whole")
    kind = (
        F.when((F.col("family") == "int") & (F.col("mean_digits") >= 8), "codigo")
        .when((F.col("family") == "int") & (unique > total * F.lit(0.9)), "identificador")
        .when((F.col("family") == "float") & (whole > total * F.lit(0.95)), "inteiros")
    )
    n = F.when(kind == "codigo", total).when(kind == "identificador", unique).otherwise(whole)
    severity = F.when(kind == "codigo", "aviso").otherwise("info")
    return F.when(
        (total >= 10) & kind.isNotNull(),
        _issue(
            "TIPO_NUMERO_TEXTO", severity, n, _share(n, total), tipo=kind,
            digitos_medios=F.round("mean_digits", 1),
        ),
    )


def whitespace_rule() -> Column:
    lead, trail, inner = F.col("n_leading"), F.col("n_trailing"), F.col("n_inner")
    names = F.concat_ws(
        ", ",
        F.when(lead > 0, F.lit("espacos no inicio")),
        F.when(trail > 0, F.lit("espacos no fim")),
        F.when(inner > 0, F.lit("espacos extras no meio")),
    )
    n = F.greatest(lead, trail, inner)
    return F.when(
        n > 0,
        _issue(
            "TEXTO_ESPACO", "info", n, _share(n, F.col("filled")), problemas=names,
            inicio=lead, fim=trail, meio=inner,
        ),
    )


def letter_case_rule() -> Column:
    total, upper, lower = F.col("filled"), F.col("n_upper"), F.col("n_lower")
    mixed = (upper > total * F.lit(0.3)) & (lower > total * F.lit(0.3))
    shouting = (upper > total * F.lit(0.8)) & (total > 5)
    severity = F.when(mixed, "aviso").otherwise("info")
    return F.when(
        (F.col("family") == "text") & (mixed | shouting),
        _issue(
            "TEXTO_CASO", severity, upper, _share(upper, total),
            maiusculas=upper, minusculas=lower, title_case=F.col("n_title"),
        ),
    )


def _issues(metrics: DataFrame, rules: Sequence[Callable[[], Column]]) -> DataFrame:
    found = F.filter(F.array(*[rule() for rule in rules]), lambda issue: issue.isNotNull())
    return metrics.select(F.inline(found))


def _no_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def _text_issues(df: DataFrame, rule: Callable[[], Column]) -> DataFrame:
    return _issues(column_metrics(df, text=True), [rule]) if text_columns(df) else _no_issues(df)


def profile_nulls(df: DataFrame) -> DataFrame:
    return _issues(column_metrics(df), [null_rule])


def profile_empty_columns(df: DataFrame) -> DataFrame:
    return _issues(column_metrics(df), [empty_rule])


def profile_unnamed_columns(df: DataFrame) -> DataFrame:
    """By the names alone; Spark calls a blank header ``_c1``, others ``Unnamed: 1``."""
    return _issues(column_metrics(df), [unnamed_rule])


def profile_column_repeats(df: DataFrame, approx: bool = False) -> DataFrame:
    return _issues(column_metrics(df, distinct=True, approx=approx), [repeats_rule])


def profile_decimal_mark(df: DataFrame) -> DataFrame:
    return _text_issues(df, decimal_mark_rule)


def profile_special_formats(df: DataFrame) -> DataFrame:
    return _text_issues(df, special_format_rule)


def profile_text_as_number(df: DataFrame) -> DataFrame:
    return _text_issues(df, text_as_number_rule)


def profile_number_as_text(df: DataFrame, approx: bool = False) -> DataFrame:
    if not has_numbers(df):
        return _no_issues(df)
    numbers = [f.name for f in df.schema.fields if is_number(f.dataType)]
    only = df.select(*[col(c) for c in numbers])
    return _issues(column_metrics(only, number=True, distinct=True, approx=approx), [number_as_text_rule])


def profile_whitespace(df: DataFrame) -> DataFrame:
    return _text_issues(df, whitespace_rule)


def profile_letter_case(df: DataFrame) -> DataFrame:
    return _text_issues(df, letter_case_rule)


def profile_row_duplicates(df: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows beyond the first of each identical row. ``keep`` is that of ``count_copies``."""
    rows, repeated = count_copies(df, keep=keep)
    totals = df.sparkSession.range(1).select(repeated.alias("n"), rows.alias("rows"))
    n, pct = F.col("n"), _share(F.col("n"), F.col("rows"))
    severity = F.when(pct > 20, "critico").when(pct > 5, "aviso").otherwise("info")
    issue = _issue(
        "DUPLICATAS", severity, n, pct, F.lit(ALL_COLUMNS), quantidade=n, percentual=F.round(pct, 2)
    )
    return totals.where("n > 0").select(F.inline(F.array(issue)))


_PLACEHOLDER_LIST = sorted({p.upper() for p in PLACEHOLDERS})


def placeholder_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) of the placeholder texts; all others are filtered out before counting."""
    pairs = [F.struct(F.lit(c).alias("column"), upper_trim(col(c)).alias("value")) for c in text_columns(df)]
    long = df.select(F.inline(F.array(*pairs))).where(F.col("value").isin(_PLACEHOLDER_LIST))
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def _placeholder_issues(counts: DataFrame) -> DataFrame:
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("found"),
    )
    severity = F.when(F.col("n") > 10, "aviso").otherwise("info")
    issue = _issue(
        "VALOR_SUSPEITO", severity, F.col("n"), F.lit(None).cast("double"), valores=F.to_json("found")
    )
    return per_column.select(F.inline(F.array(issue)))


def profile_placeholder_values(df: DataFrame) -> DataFrame:
    return _placeholder_issues(placeholder_counts(df)) if text_columns(df) else _no_issues(df)


def fuzzy_column_groups(
    df: DataFrame, min_score: float = 0.72, use_prefix: bool = True
) -> DataFrame:
    """(column, canonical, variant, n) of similar spellings in every text column, whatever its size."""
    return canonical_values(group_values(text_values(df, text_columns(df)), min_score, use_prefix))


def profile_fuzzy_groups(
    df: DataFrame, min_score: float = 0.72, use_prefix: bool = True
) -> DataFrame:
    if not text_columns(df):
        return _no_issues(df)
    return _fuzzy_issues(group_sizes(text_values(df, text_columns(df)), min_score, use_prefix))


def _fuzzy_issues(groups: DataFrame) -> DataFrame:
    """Counts only: the spellings are rows of ``fuzzy_column_groups``, never gathered in one cell."""
    per_column = groups.where("members > 1").groupBy("column").agg(
        F.count("*").alias("n_groups"), F.sum(F.col("members") - 1).alias("n_variants"), F.sum("n").alias("n"),
    )
    issue = _issue(
        "FUZZY_MATCH", "aviso", F.col("n"), F.lit(None).cast("double"),
        n_grupos=F.col("n_groups"), n_variantes=F.col("n_variants"),
    )
    return per_column.select(F.inline(F.array(issue)))


_METRIC_RULES = (
    null_rule, repeats_rule, empty_rule, unnamed_rule, decimal_mark_rule, special_format_rule,
    text_as_number_rule, number_as_text_rule, whitespace_rule, letter_case_rule,
)
_TEXT_RULES = (
    decimal_mark_rule, special_format_rule, text_as_number_rule, whitespace_rule, letter_case_rule,
)


def severity_rank(severity: Column) -> Column:
    rank = None
    for name, value in SEVERITY_RANK.items():
        test = severity == F.lit(name)
        rank = F.when(test, value) if rank is None else rank.when(test, value)
    return rank.otherwise(0)


def _scanned(df: DataFrame, fuzzy: bool, rules: Sequence[Callable[[], Column]]) -> list[DataFrame]:
    """The issues of all checks but that of spellings, and with ``fuzzy`` those of spellings too."""
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kind = _family(f.dataType)
        kinds.setdefault("number" if kind in ("int", "float") else kind, []).append(f.name)
    texts, others, numbers = (kinds.get(kind, []) for kind in ("text", "other", "number"))
    spark = df.sparkSession
    with ThreadPoolExecutor(5) as pool:
        parts = []
        if texts or others:  # first, as most steps follow it
            values = in_background(pool, spark, lambda: write_out(distinct_values(df, texts + others), "scan-values"))
        if numbers:
            parts.append(in_background(
                pool, spark, lambda: write_out(_metrics_of_numbers(df, numbers), "number-metrics")))
        copies = in_background(pool, spark, lambda: write_out(
            profile_row_duplicates(df, lambda digests: write_out(digests, "digests")), "copies"))
        cleaned = None
        if texts or others:
            values = values.result()
            parts.append(in_background(
                pool, spark, lambda: write_out(_metrics_of_texts(values, texts, others), "text-metrics")))
        if texts:
            # Small in bytes but long to compute with: a fixed number of partitions, not merged by size.
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            cleaned = values.where(F.col("column").isin(texts)).select(
                "column", upper_trim(F.col("value")).alias("value"), "n"
            ).repartition(tasks, "column", "value").groupBy("column", "value").agg(F.sum("n").alias("n"))
            if fuzzy:
                cleaned = write_out(cleaned, "values")

        def plain() -> DataFrame:
            issues = _issues(_joined_metrics(df, [part.result() for part in parts]), rules).unionByName(copies.result())
            if cleaned is not None:
                counted = cleaned.where(F.col("value").isin(_PLACEHOLDER_LIST))
                issues = issues.unionByName(_placeholder_issues(counted))
            return write_out(issues, "issues")

        found = [in_background(pool, spark, plain)]
        spelled = [_fuzzy_issues(group_sizes(cleaned))] if texts and fuzzy else []
        return [part.result() for part in found] + spelled


def scan_table(
    df: DataFrame, approx: bool = False, fuzzy: bool = True
) -> DataFrame:
    """All checks, the most severe issues first.

    One pass for each kind of columns counts their values and one counts equal rows; the other checks
    work on the counted values. Only texts are written, for the check of spellings; its short jobs run
    beside those of the other checks, which do not need them and whose issues are written meanwhile.
    ``approx`` estimates distinct counts instead, which spares the shuffle of columns with many values
    but reads the table once more for each group of checks.
    """
    texts, numbers = text_columns(df), has_numbers(df)
    rules = [
        r for r in _METRIC_RULES
        if (texts or r not in _TEXT_RULES) and (numbers or r is not number_as_text_rule)
    ]
    if approx:
        metrics = column_metrics(df, text=True, number=True, distinct=True, approx=True)
        found = [_issues(metrics, rules), profile_row_duplicates(df)]
        if texts:
            found.append(_placeholder_issues(placeholder_counts(df)))
        if texts and fuzzy:
            found.append(_fuzzy_issues(group_sizes(text_values(df, texts))))
    else:
        found = _scanned(df, fuzzy, rules)
    issues = reduce(DataFrame.unionByName, found)
    return issues.orderBy(severity_rank(F.col("severity")).desc(), "category", "column")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issue counts in all, by severity and by category, as ``(kind, name, n)``.

    Counted by both first: their order is no matter to that, so Spark leaves out sorting them.
    """
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("total").alias("name")),
        F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
    )
    counts = issues.groupBy("severity", "category").agg(F.count("*").alias("found"))
    listed = counts.select("found", F.inline(kinds))
    return listed.groupBy("kind", "name").agg(F.coalesce(F.sum("found"), F.lit(0)).alias("n"))


def issue_report(issues: DataFrame) -> DataFrame:
    """The issues numbered in order of severity. There is one row per finding and column, so the
    numbering is of schema size, not of data size."""
    ranked = issues.withColumn("rank", severity_rank(F.col("severity")))
    listed = ranked.agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("rank")).alias("k"), "category", "column", "severity", "n_rows", "pct",
                         F.to_json("details").alias("details"))
            )
        ).alias("all")
    )
    numbered = listed.select(F.posexplode("all").alias("i", "issue"))
    return numbered.select(
        (F.col("i") + 1).alias("number"), *[F.col("issue").getField(c).alias(c) for c in
        ("category", "column", "severity", "n_rows", "pct", "details")]
    )


def preflight_sample(df: DataFrame, order_by: Sequence, n: int = 100) -> DataFrame:
    """Quick look at the first rows: unnamed columns, columns more than half null, equal rows."""
    sample = keep_first_n(df, n, order_by)
    counts = null_counts(sample).first().asDict()
    rows = counts.pop("__rows")
    repeated = count_duplicate_rows(sample).first()[0]
    found = [("unnamed_column", c, None) for c in df.columns if is_unnamed(c)]
    found += [("mostly_null_column", c, k) for c, k in counts.items() if k > rows * 0.5]
    if repeated:
        found.append(("duplicate_rows", ALL_COLUMNS, repeated))
    return df.sparkSession.createDataFrame(found, "problem string, column string, n_rows bigint")


def is_unnamed(name: str) -> bool:
    return bool(re.match(UNNAMED, name))
