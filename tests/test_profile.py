import json

from tidymill.operators import lineage, profile, validate
from tidymill.plans import steps, suggest


def found(issues):
    return {(r["category"], r["column"], r["severity"], r["n_rows"]) for r in issues.collect()}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, None)], "id int, e double, s string")
    assert found(profile.profile_nulls(df)) == {("NULOS", "e", "critico", 3), ("NULOS", "s", "critico", 2)}
    assert found(profile.profile_empty_columns(df)) == {("COLUNA_VAZIA", "e", "critico", 3)}
    assert len(found(profile.profile_empty_columns(df.limit(0)))) == 3


def test_placeholders(one):
    df = one(["n/a", "NULL", "-", "ok", None])
    issue = profile.profile_placeholder_values(df).first()
    assert issue["n_rows"] == 3 and issue["severity"] == "info"
    assert json.loads(issue["details"]["valores"]) == {"-": 1, "N/A": 1, "NULL": 1}


def test_decimal_marks(one):
    dots = one(["1.5", "2.25", "3.125", "x", "1,5"])
    issue = profile.profile_decimal_mark(dots).first()
    assert (issue["severity"], issue["n_rows"], issue["details"]["casas_decimais"]) == ("aviso", 3, "1,2,3")
    assert profile.profile_decimal_mark(one(["1.5", "2,5", "3,5", "4,5", "x"])).first()["severity"] == "critico"
    assert profile.profile_decimal_mark(one(["1.5", "2.5", "3.5", "4.5"])).count() == 0


def test_text_that_is_a_number(one):
    rows = lambda numbers, words: one([str(i) for i in range(numbers)] + ["w"] * words)
    check = lambda df: [r["severity"] for r in profile.profile_text_as_number(df).collect()]
    assert check(rows(10, 0)) == ["aviso"] and check(rows(9, 1)) == []
    assert check(rows(6, 5)) == ["aviso"] and check(rows(2, 10)) == ["info"] and check(rows(1, 20)) == []


def test_number_that_is_a_code(spark):
    df = spark.range(20).selectExpr("id + 1000000000 AS code", "id AS key", "id % 3 AS few", "cast(id AS double) AS f")
    got = {(r["column"], r["severity"]) for r in profile.profile_number_as_text(df).collect()}
    assert got == {("code", "aviso"), ("key", "info"), ("f", "info")}


def test_whitespace_and_case(one):
    df = one([" a", "b ", "c  d", "E", "F", "G", "H"])
    issue = profile.profile_whitespace(df).first()
    assert issue["details"]["problemas"] == "espacos no inicio, espacos no fim, espacos extras no meio"
    assert profile.profile_letter_case(df).first()["severity"] == "aviso"
    assert profile.profile_letter_case(one(["A"] * 6)).first()["severity"] == "info"
    assert profile.profile_letter_case(one(["Ab"] * 6)).count() == 0


def test_special_formats(one):
    issue = profile.profile_special_formats(one(["R$ 5", "10%", "1.234,56"])).first()
    assert issue["details"]["formatos"] == "moeda (R$), porcentagem (%), milhar brasileiro (1.234,56)"


def test_scan_suggest_apply(spark):
    names = ["Morais", "MORAES", "n/a", "Silva  Neto", "Silva Neto", None] * 4
    df = spark.createDataFrame(
        [(i, n, None, "R$ 1.234,50") for i, n in enumerate(names)], "id int, nome string, vazio double, preco string")
    issues = profile.scan_table(df)
    ranks = [profile.SEVERITY_RANK[r["severity"]] for r in issues.collect()]
    assert ranks == sorted(ranks, reverse=True)
    suggested = suggest.as_steps(suggest.suggest_steps(issues))
    assert [s["operacao"] for s in suggested] == [
        "remover_colunas_vazias", "remover_colunas_vazias", "numero_interno", "substituir_valores",
        "normalizar_texto", "unificar_valores"]
    run = suggest.apply_suggestions(df, ["id"])
    assert all(r.ok for r in run.results)
    assert {r["nome"] for r in run.table.collect()} == {"MORAES", "MORAIS", "", "SILVA  NETO", None}
    assert {r["preco"] for r in run.table.collect()} == {1234.5}
    assert "vazio" not in run.table.columns
    summary = {(r["kind"], r["name"]): r["n"] for r in profile.issue_summary(issues).collect()}
    assert summary[("total", "total")] == len(ranks)
    report = profile.issue_report(issues).collect()
    assert [r["number"] for r in report] == list(range(1, len(ranks) + 1))


def test_columns_of_any_size_are_compared(spark):
    df = spark.createDataFrame([(f"name {i}", "x") for i in range(1200)] + [("n", "xx")], "many string, few string")
    assert {r["column"] for r in profile.fuzzy_column_groups(df).collect()} == {"few", "many"}


def test_suggestions_lose_nothing(spark):
    amounts = ["R$ 1.234,50", "8%", "1.234,56", "-R$ 2,00", "8,125 %", ""] * 3
    rows = [(i, a, a if i else "por volta de R$ 3") for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "id int, preco string, misto string")
    run = suggest.apply_suggestions(df, ["id"], fuzzy=False)
    assert all(r.ok for r in run.results)
    got = {r["preco"] for r in run.table.collect()}
    assert got == {1234.5, 0.08, 1234.56, -2.0, 0.08125, None}
    assert "POR VOLTA DE R$ 3" in {r["misto"].upper() for r in run.table.collect()}


def test_tables_without_text(spark):
    df = spark.range(3)
    assert profile.profile_whitespace(df).count() == 0
    assert profile.profile_fuzzy_groups(df).count() == 0
    assert profile.profile_placeholder_values(df).count() == 0
    assert profile.scan_table(df).count() >= 0


def test_validate(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, `Unnamed: 1` int")
    report = {r["rule"]: r["passed"] for r in validate.validate_table(df, ["a", "b"], 3).collect()}
    assert report == {"required_columns": False, "min_rows": False, "empty_columns": False,
                      "unnamed_columns": False, "duplicate_rows": False}
    assert validate.is_approved(validate.validate_table(spark.range(3), ["id"], 3))


def test_snapshots(spark):
    before = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    after = before.dropDuplicates().withColumnRenamed("b", "c")
    report = {(r["metric"], r["column"]): (r["before"], r["after"]) for r in lineage.before_after_report(
        lineage.initial_snapshot(before), lineage.initial_snapshot(after)).collect()}
    assert report[("rows", None)] == (3, 2) and report[("duplicates", None)] == (1, 0)
    assert report[("total_nulls", None)] == (2, 1)
    assert ("added_column", "c") in report and ("removed_column", "b") in report


def test_run_steps_goes_on_after_a_failure(spark, one):
    df = one(["a", "b", None])
    recipe = [
        {"operacao": "bogus"}, {"operacao": "filtrar_linhas", "params": {"condicao": "nope > 1"}},
        {"operacao": "esquerda", "params": {"coluna": "v"}}, {"operacao": "manter_n_primeiras", "params": {"n": 1}},
        {"operacao": "cont_se", "params": {"coluna": "v", "criterio": "A"}},
        {"operacao": "remover_nulos", "params": {"colunas": ["v"]}},
    ]
    run = steps.run_steps(df, recipe, observe=True)
    assert [r.ok for r in run.results] == [False, False, False, False, True, True]
    assert run.results[4].value.first()[0] == 1
    assert run.table.count() == 2
    assert [(h["operation"], h["rows_before"], h["rows_after"]) for h in run.history().collect()] == [("remover_nulos", 3, 2)]
    try:
        steps.run_steps(df, recipe, on_error="raise")
    except ValueError:
        return
    raise AssertionError


def test_all_48_steps_are_known():
    assert len(steps.TABLE_STEPS) + len(steps.QUESTION_STEPS) == 48
    assert not set(steps.TABLE_STEPS) & set(steps.QUESTION_STEPS)
