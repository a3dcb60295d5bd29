"""Diagnostics, validation, lineage, recipes and similar spellings."""

from pyspark.sql import functions as F

from ..operators import clean, columns, fuzzy, lineage, profile, validate
from ..plans import steps, suggest
from .column_queries import dice_sql, edit_sql, root_sql
from .registry import QUERIES, VIEWS, add

_SHOWN = ("category", "column", "severity", "n_rows", "pct")
_DIRTY = ("c_custkey", "c_nationkey", "segment", "acctbal", "acctbal_text", "empty_col", "code_like")
_TEXTS = ("segment", "acctbal_text")


def _shown(issues):
    return issues.select(*_SHOWN)


def _per_column(columns_, body: str, where: str) -> str:
    """One SELECT per column over its aggregates, joined by UNION ALL."""
    return " UNION ALL ".join(
        f"SELECT {body.replace('@name', repr(c))} FROM ({_AGGREGATES.replace('@c', c)}) WHERE {where}" for c in columns_
    )


_AGGREGATES = """
    SELECT count(*) AS total, count(@c) AS filled, count(*) - count(@c) AS nulls, count(DISTINCT @c) AS uniq,
        count(*) FILTER (WHERE regexp_full_match(trim(CAST(@c AS VARCHAR)), '-?[0-9]+[.][0-9]{1,6}')) AS dot,
        count(*) FILTER (WHERE regexp_full_match(trim(CAST(@c AS VARCHAR)), '-?[0-9]+,[0-9]{1,6}')) AS comma,
        count(*) FILTER (WHERE regexp_full_match(trim(CAST(@c AS VARCHAR)), '-?[0-9]+')) AS whole,
        count(*) FILTER (WHERE regexp_full_match(trim(CAST(@c AS VARCHAR)), '-?[0-9]+([.,][0-9]+)?')) AS numeric_text,
        count(*) FILTER (WHERE regexp_matches(CAST(@c AS VARCHAR), '^\\s')) AS lead,
        count(*) FILTER (WHERE regexp_matches(CAST(@c AS VARCHAR), '\\s$')) AS trail,
        count(*) FILTER (WHERE regexp_matches(trim(CAST(@c AS VARCHAR)), '\\s{2,}')) AS inner_run,
        count(*) FILTER (WHERE trim(CAST(@c AS VARCHAR)) = upper(trim(CAST(@c AS VARCHAR)))) AS up,
        count(*) FILTER (WHERE trim(CAST(@c AS VARCHAR)) = lower(trim(CAST(@c AS VARCHAR)))) AS low,
        avg(length(CAST(@c AS VARCHAR))) AS digits
    FROM {dirty_customer}"""


def _row(category: str, severity: str, n: str, share_of: str | None) -> str:
    pct = f"round({n} * 100.0 / {share_of}, 2)" if share_of else "CAST(NULL AS DOUBLE)"
    return (f"'{category}' AS category, @name AS \"column\", {severity} AS severity, "
            f"CAST({n} AS BIGINT) AS n_rows, {pct} AS pct")


_NULLS = _per_column(
    _DIRTY,
    _row("NULOS", "CASE WHEN nulls * 100.0 / total > 30 THEN 'critico' WHEN nulls * 100.0 / total > 10 THEN 'aviso' "
         "ELSE 'info' END", "nulls", "total"), "nulls > 0")
_EMPTY = _per_column(
    _DIRTY, _row("COLUNA_VAZIA", "CASE WHEN nulls = total THEN 'critico' ELSE 'aviso' END", "nulls", "total"),
    "nulls > 0.9 * total")
_REPEATS_N = "(total - uniq - CASE WHEN nulls > 0 THEN 1 ELSE 0 END)"
_REPEATS = _per_column(
    _DIRTY, _row("DUPLICATA_COLUNA", "'info'", _REPEATS_N, "total"), f"{_REPEATS_N} > 0 AND uniq < 0.5 * total")
_DECIMAL = _per_column(
    _TEXTS,
    _row("NUMERO_PONTO_DECIMAL", "CASE WHEN dot > comma AND dot >= 3 THEN 'aviso' ELSE 'critico' END", "dot", "filled"),
    "filled >= 5 AND dot + comma + whole >= 3 AND ((dot > comma AND dot >= 3) OR (dot > 0 AND comma > 0))")
_SHARE = "numeric_text * 100.0 / filled"
_TEXT_NUMBER = _per_column(
    _TEXTS, _row("TIPO_TEXTO_NUMERO", f"CASE WHEN {_SHARE} >= 50 THEN 'aviso' ELSE 'info' END", "numeric_text", "filled"),
    f"filled >= 10 AND (({_SHARE} >= 80 AND numeric_text >= 10) OR ({_SHARE} >= 10 AND {_SHARE} < 80))")
_INT_KIND = "CASE WHEN digits >= 8 THEN 'aviso' ELSE 'info' END"
_NUMBER_TEXT = _per_column(
    ("c_custkey", "c_nationkey", "code_like"),
    _row("TIPO_NUMERO_TEXTO", _INT_KIND, "CASE WHEN digits >= 8 THEN filled ELSE uniq END", "filled"),
    "filled >= 10 AND (digits >= 8 OR uniq > 0.9 * filled)")
_SPACES = _per_column(
    _TEXTS, _row("TEXTO_ESPACO", "'info'", "greatest(lead, trail, inner_run)", "filled"), "lead + trail + inner_run > 0")
_MIXED = "(up > 0.3 * filled AND low > 0.3 * filled)"
_CASE = _per_column(
    _TEXTS, _row("TEXTO_CASO", f"CASE WHEN {_MIXED} THEN 'aviso' ELSE 'info' END", "up", "filled"),
    f"{_MIXED} OR (up > 0.8 * filled AND filled > 5)")
_MISSING = ", ".join(repr(p) for p in sorted({p.upper() for p in profile.PLACEHOLDERS}))
_PLACEHOLDERS = " UNION ALL ".join(
    f"SELECT 'VALOR_SUSPEITO' AS category, '{c}' AS \"column\", CASE WHEN count(*) > 10 THEN 'aviso' ELSE 'info' END "
    f"AS severity, count(*) AS n_rows, CAST(NULL AS DOUBLE) AS pct FROM {{dirty_customer}} "
    f"WHERE upper(trim({c})) IN ({_MISSING}) HAVING count(*) > 0" for c in _TEXTS)

add("profile_nulls", lambda t: _shown(profile.profile_nulls(t.dirty_customer)), _NULLS)
add("profile_empty_columns", lambda t: _shown(profile.profile_empty_columns(t.dirty_customer)), _EMPTY)
add("profile_column_repeats", lambda t: _shown(profile.profile_column_repeats(t.dirty_customer)), _REPEATS)
add("profile_unnamed_columns",
    lambda t: _shown(profile.profile_unnamed_columns(t.nation.toDF("Unnamed: 0", "n_name", "_c2"))),
    "SELECT 'COLUNA_UNNAMED' AS category, name AS \"column\", 'aviso' AS severity, "
    "(SELECT count(*) FROM nation) AS n_rows, CAST(NULL AS DOUBLE) AS pct "
    "FROM (VALUES ('Unnamed: 0'), ('_c2')) AS v(name)")
add("profile_row_duplicates",
    lambda t: _shown(profile.profile_row_duplicates(t.exact_copies)),
    "SELECT 'DUPLICATAS' AS category, '(todas as colunas)' AS \"column\", "
    "CASE WHEN n * 100.0 / total > 20 THEN 'critico' WHEN n * 100.0 / total > 5 THEN 'aviso' ELSE 'info' END AS severity, "
    "n AS n_rows, round(n * 100.0 / total, 2) AS pct FROM (SELECT CAST(sum(k - 1) AS BIGINT) AS n, "
    "CAST(sum(k) AS BIGINT) AS total FROM (SELECT count(*) AS k FROM {exact_copies} GROUP BY ALL)) WHERE n > 0"
    .replace("SELECT count(*) AS k FROM {exact_copies} GROUP BY ALL",
             "SELECT count(*) AS k FROM {exact_copies} GROUP BY o_orderkey, o_custkey, o_orderstatus"))
add("profile_decimal_mark", lambda t: _shown(profile.profile_decimal_mark(t.dirty_customer)), _DECIMAL)
add("profile_special_formats",
    lambda t: profile.profile_special_formats(t.money_text).select(
        "category", "column", "severity", "n_rows", F.col("details")["formatos"].alias("formats")),
    "SELECT 'FORMATO_ESPECIAL' AS category, 'amount' AS \"column\", 'info' AS severity, "
    "greatest(count(*) FILTER (WHERE contains(amount, 'R$')), count(*) FILTER (WHERE contains(amount, '%')), "
    "count(*) FILTER (WHERE regexp_full_match(amount, '[0-9]{1,3}([.][0-9]{3})+,[0-9]+'))) AS n_rows, "
    "'moeda (R$), porcentagem (%), milhar brasileiro (1.234,56)' AS formats FROM {money_text}")
add("profile_text_as_number", lambda t: _shown(profile.profile_text_as_number(t.dirty_customer)), _TEXT_NUMBER)
add("profile_number_as_text",
    lambda t: _shown(profile.profile_number_as_text(t.dirty_customer)), _NUMBER_TEXT)
add("profile_number_as_text_float",
    lambda t: _shown(profile.profile_number_as_text(t.lineitem.select("l_quantity", "l_extendedprice"))),
    "SELECT 'TIPO_NUMERO_TEXTO' AS category, 'l_quantity' AS \"column\", 'info' AS severity, "
    "count(*) AS n_rows, 100.0 AS pct FROM lineitem")
add("profile_placeholder_values", lambda t: _shown(profile.profile_placeholder_values(t.dirty_customer)), _PLACEHOLDERS)
add("profile_whitespace", lambda t: _shown(profile.profile_whitespace(t.dirty_customer)), _SPACES)
add("profile_letter_case", lambda t: _shown(profile.profile_letter_case(t.dirty_customer)), _CASE)

# ---- similar spellings
_VALUES = ("v AS (SELECT upper(trim(name)) AS v, count(*) AS n FROM {typo_part} GROUP BY 1)")
_ALL_PAIRS = "FROM v x JOIN v y ON x.v < y.v"
_REACH = ("r(v, w) AS (SELECT v, v FROM v UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a), "
          "g AS (SELECT v, min(w) AS grp FROM r GROUP BY v)")


def _edges(test: str) -> str:
    return (f"p AS (SELECT x.v AS a, y.v AS b {_ALL_PAIRS} WHERE {test}), "
            "e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)")


_ANY_SCORE = (f"greatest({dice_sql('x.v', 'y.v')}, {edit_sql('x.v', 'y.v')}, {root_sql('x.v', 'y.v')}) >= 0.72")
_NO_PREFIX = (f"greatest({dice_sql('x.v', 'y.v')}, {edit_sql('x.v', 'y.v')}, "
              f"CASE WHEN {root_sql('x.v', 'y.v')} >= 0.95 THEN 0.95 ELSE 0.0 END) >= 0.8")
add("fuzzy_pairs",
    lambda t: fuzzy.fuzzy_pairs(t.typo_part, "name", 0.85),
    f"WITH {_VALUES} SELECT x.v AS value_a, y.v AS value_b, round_even({dice_sql('x.v', 'y.v')}, 3) AS similarity "
    f"{_ALL_PAIRS} WHERE {dice_sql('x.v', 'y.v')} >= 0.85 AND {dice_sql('x.v', 'y.v')} < 1"
    .replace("round_even(", "round(CAST(").replace(", 3) AS similarity", " AS DOUBLE), 3) AS similarity"))
add("fuzzy_groups",
    lambda t: fuzzy.fuzzy_groups(t.typo_part, "name"),
    f"WITH RECURSIVE {_VALUES}, {_edges(_ANY_SCORE)}, {_REACH} "
    "SELECT grp AS \"group\", v.v AS value, n FROM v JOIN g ON v.v = g.v")
add("fuzzy_groups_without_prefix",
    lambda t: fuzzy.fuzzy_groups(t.typo_part, "name", 0.8, use_prefix=False),
    f"WITH RECURSIVE {_VALUES}, {_edges(_NO_PREFIX)}, {_REACH} "
    "SELECT grp AS \"group\", v.v AS value, n FROM v JOIN g ON v.v = g.v")
_UNIFY = (f"WITH RECURSIVE {_VALUES}, {_edges(dice_sql('x.v', 'y.v') + ' >= 0.85')}, {_REACH}, "
          "k AS (SELECT grp, v.v AS variant, n, first_value(v.v) OVER (PARTITION BY grp ORDER BY n DESC, v.v) AS canonical, "
          "count(*) OVER (PARTITION BY grp) AS members FROM v JOIN g ON v.v = g.v) ")
add("suggest_unification",
    lambda t: fuzzy.suggest_unification(t.typo_part, "name"),
    _UNIFY + "SELECT canonical, variant, n FROM k WHERE members > 1")
add("unify_values_suggested",
    lambda t: clean.unify_values(
        t.typo_part.select("p_partkey", "name"), "name", fuzzy.suggest_unification(t.typo_part, "name")),
    _UNIFY + "SELECT p_partkey, coalesce(canonical, name) AS name FROM {typo_part} LEFT JOIN "
    "(SELECT * FROM k WHERE members > 1) ON upper(trim(name)) = variant")
add("profile_fuzzy_groups",
    lambda t: profile.profile_fuzzy_groups(t.typo_part.select("name")).select(
        "category", "column", "severity", "n_rows",
        F.col("details")["n_grupos"].cast("bigint").alias("n_groups"),
        F.col("details")["n_variantes"].cast("bigint").alias("n_variants")),
    f"WITH RECURSIVE {_VALUES}, {_edges(_ANY_SCORE)}, {_REACH}, "
    "m AS (SELECT grp, count(*) AS k, sum(n) AS n FROM v JOIN g ON v.v = g.v GROUP BY grp HAVING count(*) > 1) "
    "SELECT 'FUZZY_MATCH' AS category, 'name' AS \"column\", 'aviso' AS severity, CAST(sum(n) AS BIGINT) AS n_rows, "
    "count(*) AS n_groups, CAST(sum(k - 1) AS BIGINT) AS n_variants FROM m")

# ---- scan, report, suggestions
_ALL = " UNION ALL ".join(
    (_NULLS, _EMPTY, _REPEATS, _DECIMAL, _TEXT_NUMBER, _NUMBER_TEXT, _SPACES, _CASE, _PLACEHOLDERS))


def _in_views(sql: str) -> str:
    for view, text in VIEWS.items():
        sql = sql.replace("{" + view + "}", f"({text})")
    return sql


def _similar(column: str) -> str:
    """The issue of a column: rows whose value has a like one. Most show by their first two characters."""
    score = _ANY_SCORE.replace("x.v", "p.a").replace("y.v", "p.b")
    return (
        f"SELECT * FROM (WITH v AS (SELECT upper(trim({column})) AS v, count(*) AS n FROM {{dirty_customer}} "
        f"WHERE {column} IS NOT NULL GROUP BY 1), "
        "s AS (SELECT v, n, length(v) > 1 AND count(*) OVER (PARTITION BY substr(v, 1, 2)) > 1 AS known FROM v), "
        "p AS (SELECT x.v, least(x.v, y.v) AS a, greatest(x.v, y.v) AS b FROM s x JOIN s y ON x.v <> y.v WHERE NOT x.known) "
        f"SELECT 'FUZZY_MATCH' AS category, '{column}' AS \"column\", 'aviso' AS severity, CAST(sum(n) AS BIGINT) AS n_rows, "
        f"CAST(NULL AS DOUBLE) AS pct FROM s WHERE known OR v IN (SELECT v FROM p WHERE {score}) HAVING count(*) > 0)"
    )


def _unified(column: str) -> str:
    values = _VALUES.replace("name", column).replace("{typo_part}", f"{{dirty_customer}} WHERE {column} IS NOT NULL")
    return f"(SELECT * FROM ({_UNIFY.replace(_VALUES, values)} SELECT variant, canonical FROM k WHERE members > 1))"


_ALL_SPELLED = " UNION ALL ".join([_ALL, *[_similar(c) for c in _TEXTS]])


def _scan(t):
    return profile.scan_table(t.dirty_customer)


add("scan_table", lambda t: _shown(_scan(t)), _ALL_SPELLED)
add("issue_summary",
    lambda t: profile.issue_summary(_scan(t)),
    f"WITH i AS ({_ALL_SPELLED}) SELECT 'total' AS kind, 'total' AS name, count(*) AS n FROM i UNION ALL "
    "SELECT 'severity', severity, count(*) FROM i GROUP BY severity UNION ALL "
    "SELECT 'category', category, count(*) FROM i GROUP BY category")
add("issue_report",
    lambda t: profile.issue_report(_scan(t)).select(F.col("number").cast("bigint"), *_SHOWN),
    f"WITH i AS ({_ALL_SPELLED}) SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critico' THEN 3 WHEN 'aviso' THEN 2 "
    f"ELSE 1 END DESC, category, \"column\") AS number, * FROM i")
add("suggest_steps",
    lambda t: suggest.suggest_steps(_scan(t)).select("operation", "params"),
    f"WITH i AS ({_ALL_SPELLED}) "
    "SELECT 'remover_colunas_vazias' AS operation, '{\"limiar\":1.0}' AS params FROM i WHERE category = 'NULOS' "
    "HAVING count(*) > 0 UNION ALL "
    "SELECT 'remover_colunas_vazias', '{\"limiar\":1.0}' FROM i WHERE category = 'COLUNA_VAZIA' HAVING count(*) > 0 "
    "UNION ALL SELECT 'substituir_valores', '{\"colunas\":[\"' || \"column\" || '\"],\"mapeamento\":{\"N/A\":\"\"},"
    "\"normalizar\":true}' FROM i WHERE category = 'VALOR_SUSPEITO' UNION ALL "
    "SELECT 'normalizar_texto', '{\"colunas\":[\"' || string_agg(\"column\", '\",\"' ORDER BY \"column\") || "
    "'\"],\"modo\":\"upper\"}' FROM i WHERE category = 'TEXTO_ESPACO' HAVING count(*) > 0 UNION ALL "
    "SELECT 'unificar_valores', '{\"coluna\":\"' || \"column\" || '\",\"tabela\":\"unificar:' || \"column\" "
    "|| '\"}' FROM i WHERE category = 'FUZZY_MATCH'")
add("apply_suggestions_spellings",
    lambda t: suggest.apply_suggestions(t.typo_part.select("p_partkey", "name"), ["p_partkey"], columns=["name"]).table,
    _UNIFY + "SELECT p_partkey, coalesce(canonical, upper(trim(name))) AS name FROM {typo_part} LEFT JOIN "
    "(SELECT * FROM k WHERE members > 1) ON upper(trim(name)) = variant")
add("apply_suggestions_money",
    lambda t: suggest.apply_suggestions(t.money_text, ["o_orderkey"], fuzzy=False, columns=["amount"]).table,
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) "
    "WHEN o_orderkey % 3 = 1 THEN round(o_custkey / 100.0, 6) ELSE 1000.5 + o_custkey % 1000 END AS amount FROM orders")
add("apply_suggestions",
    lambda t: suggest.apply_suggestions(t.dirty_customer, ["c_custkey"]).table,
    "SELECT c_custkey, c_nationkey, coalesce(s.canonical, CASE WHEN upper(trim(segment)) = 'N/A' THEN '' "
    "ELSE upper(trim(segment)) END) AS segment, acctbal, coalesce(a.canonical, acctbal_text) AS acctbal_text, code_like "
    f"FROM {{dirty_customer}} LEFT JOIN {_unified('segment')} s ON upper(trim(segment)) = s.variant "
    f"LEFT JOIN {_unified('acctbal_text')} a ON upper(trim(acctbal_text)) = a.variant")

# The names under which the check of spellings was first registered.
for _name in ("scan_table", "issue_summary", "issue_report", "suggest_steps"):
    QUERIES[f"{_name}_spellings"] = QUERIES[_name]
QUERIES["apply_suggestions_dirty_spellings"] = QUERIES["apply_suggestions"]

# ---- validation and lineage
add("validate_table",
    lambda t: validate.validate_table(t.dirty_customer, ["segment", "absent"], 100),
    "SELECT 'required_columns' AS rule, false AS passed, 'absent' AS detail UNION ALL "
    "SELECT 'min_rows', count(*) >= 100, CAST(count(*) AS VARCHAR) FROM {dirty_customer} UNION ALL "
    "SELECT 'empty_columns', count(empty_col) > 0, CASE WHEN count(empty_col) = 0 THEN 'empty_col' ELSE '' END "
    "FROM {dirty_customer} UNION ALL SELECT 'unnamed_columns', true, '' UNION ALL "
    "SELECT 'duplicate_rows', count(*) = count(DISTINCT c_custkey), "
    "CAST(count(*) - count(DISTINCT c_custkey) AS VARCHAR) FROM {dirty_customer}")
_TYPES = {"c_custkey": "bigint", "c_nationkey": "int", "segment": "string", "acctbal": "double",
          "acctbal_text": "string", "empty_col": "double", "code_like": "bigint"}
add("initial_snapshot",
    lambda t: lineage.initial_snapshot(t.dirty_customer),
    "SELECT 'rows' AS metric, CAST(NULL AS VARCHAR) AS \"column\", CAST(count(*) AS VARCHAR) AS value FROM {dirty_customer} "
    "UNION ALL SELECT 'columns', NULL, '7' UNION ALL SELECT 'total_nulls', NULL, CAST("
    + " + ".join(f"count(*) - count({c})" for c in _DIRTY)
    + " AS VARCHAR) FROM {dirty_customer} UNION ALL SELECT 'duplicates', NULL, "
    "CAST(count(*) - count(DISTINCT c_custkey) AS VARCHAR) FROM {dirty_customer} UNION ALL "
    + " UNION ALL ".join(f"SELECT 'type', '{c}', '{_TYPES[c]}'" for c in _DIRTY) + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'nulls', '{c}', CAST(count(*) - count({c}) AS VARCHAR) FROM {{dirty_customer}}" for c in _DIRTY))


def _cleaned(t):
    return columns.add_constant_column(
        clean.drop_empty_columns(clean.drop_null_rows(t.dirty_customer, ["segment", "acctbal"])), "origin", "dw")


_CLEAN_WHERE = "FROM {dirty_customer} WHERE segment IS NOT NULL AND acctbal IS NOT NULL"
add("before_after_report",
    lambda t: lineage.before_after_report(
        lineage.initial_snapshot(t.dirty_customer), lineage.initial_snapshot(_cleaned(t)))
    .withColumn("change_pct", F.round("change_pct", 4)),
    f"WITH b AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in _DIRTY)} AS k FROM {{dirty_customer}}), "
    f"a AS (SELECT count(*) AS n {_CLEAN_WHERE}) "
    "SELECT 'rows' AS metric, b.n AS before, a.n AS after, a.n - b.n AS change, "
    "round((a.n - b.n) * 100.0 / b.n, 4) AS change_pct, CAST(NULL AS VARCHAR) AS \"column\" FROM a, b UNION ALL "
    "SELECT 'columns', 7, 7, 0, NULL, NULL UNION ALL SELECT 'total_nulls', b.k, 0, -b.k, NULL, NULL FROM b UNION ALL "
    "SELECT 'duplicates', 0, 0, 0, NULL, NULL UNION ALL SELECT 'added_column', NULL, NULL, NULL, NULL, 'origin' UNION ALL "
    "SELECT 'removed_column', NULL, NULL, NULL, NULL, 'empty_col'")
add("cleaning_summary",
    lambda t: lineage.cleaning_summary(t.dirty_customer, _cleaned(t)).withColumn("pct_removed", F.round("pct_removed", 4)),
    f"WITH b AS (SELECT count(*) AS n FROM {{dirty_customer}}), a AS (SELECT count(*) AS n {_CLEAN_WHERE}) "
    "SELECT b.n AS rows_before, a.n AS rows_after, b.n - a.n AS rows_removed, "
    "round((b.n - a.n) * 100.0 / b.n, 4) AS pct_removed, 7 AS columns_before, 7 AS columns_after FROM a, b")

# ---- recipes
RECIPE = [
    {"operacao": "filtrar_linhas", "params": {"condicao": "acctbal IS NOT NULL"}},
    {"operacao": "normalizar_texto", "params": {"colunas": ["segment"], "modo": "upper"}},
    {"operacao": "substituir_valores", "params": {"colunas": ["segment"], "mapeamento": {"N/A": "OUTROS"}}},
    {"operacao": "preencher_nulos", "params": {"estrategias": {"segment": "OUTROS"}}},
    {"operacao": "numero_interno", "params": {"colunas": ["acctbal_text"], "casas": 2}},
    {"operacao": "procv", "params": {"tabela_origem": "nation", "coluna_chave": "c_nationkey",
                                     "coluna_chave_origem": "n_nationkey", "coluna_valor_origem": "n_name",
                                     "padrao": "-"}},
    {"operacao": "no_such_step", "params": {}},
    {"operacao": "agregar", "params": {"colunas_grupo": ["segment", "n_name_procv"], "coluna_alvo": "acctbal",
                                       "funcao": "sum"}},
    {"operacao": "arred", "params": {"coluna": "acctbal", "casas": 2, "nova_coluna": "total"}},
    {"operacao": "remover_coluna", "params": {"colunas": ["acctbal"]}},
]


def _run(t, **options):
    return steps.run_steps(t.dirty_customer, RECIPE, {"nation": t.partial_nation}, ["c_custkey"], **options)


_RECIPE_ROWS = ("SELECT CASE WHEN segment IS NULL OR upper(trim(segment)) = 'N/A' THEN 'OUTROS' "
                "ELSE upper(trim(segment)) END AS segment, coalesce(n_name, '-') AS n_name_procv, "
                "round(sum(acctbal), 2) AS total FROM {dirty_customer} LEFT JOIN {partial_nation} "
                "ON c_nationkey = n_nationkey WHERE acctbal IS NOT NULL GROUP BY 1, 2")
add("run_steps", lambda t: _run(t).table, _RECIPE_ROWS)


def _history(t):
    run = _run(t, observe=True)
    return run.history().select("operation", "rows_before", "rows_after", "columns_before", "columns_after")


def _emptied(t):
    recipe = [
        {"operacao": "filtrar_linhas", "params": {"condicao": "c_custkey <= 100"}},
        {"operacao": "filtrar_linhas", "params": {"condicao": "c_custkey < 0"}},
        {"operacao": "ordenar_por", "params": {"colunas": ["c_custkey"]}},
        {"operacao": "manter_n_primeiras", "params": {"n": 10}},
    ]
    run = steps.run_steps(t.customer, recipe, order_by=["c_custkey"], observe=True)
    return run.history().select("number", "rows_before", "rows_after")


add("step_history_emptied", _emptied,
    "SELECT 1 AS number, count(*) AS rows_before, count(*) FILTER (c_custkey <= 100) AS rows_after FROM customer "
    "UNION ALL SELECT 2, count(*) FILTER (c_custkey <= 100), 0 FROM customer UNION ALL SELECT 3, 0, 0 UNION ALL SELECT 4, 0, 0")
add("step_history", _history,
    "WITH n AS (SELECT (SELECT count(*) FROM {dirty_customer}) AS a, "
    "(SELECT count(*) FROM {dirty_customer} WHERE acctbal IS NOT NULL) AS b, "
    f"(SELECT count(*) FROM ({_RECIPE_ROWS})) AS c) "
    "SELECT 'filtrar_linhas' AS operation, a AS rows_before, b AS rows_after, 7 AS columns_before, 7 AS columns_after FROM n "
    "UNION ALL SELECT 'normalizar_texto', b, b, 7, 7 FROM n UNION ALL SELECT 'substituir_valores', b, b, 7, 7 FROM n "
    "UNION ALL SELECT 'preencher_nulos', b, b, 7, 7 FROM n UNION ALL SELECT 'numero_interno', b, b, 7, 7 FROM n "
    "UNION ALL SELECT 'procv', b, b, 7, 8 FROM n UNION ALL SELECT 'agregar', b, c, 8, 3 FROM n "
    "UNION ALL SELECT 'arred', c, c, 3, 4 FROM n UNION ALL SELECT 'remover_coluna', c, c, 4, 3 FROM n")
