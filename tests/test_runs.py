"""Runs: evaluation reports and gates, shared answers, two-step form calls, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.functions import taxonomy as tx
from quire.operators import catalogue, forms, model, rules, runs, validate

CASE = "dataset string, id string, label string, text string, extraction string, warnings array<string>, ocr_engine string, ocr_line_confidence array<double>"


def case(dataset, id_, label, text):
    return (dataset, id_, label, text, "native", None, None, None)


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(
        [
            case("regression", "a", "tax-invoice", "Tax invoice\nGST 1\nTotal 11"),
            case("regression", "b", "receipt", "Payment receipt\nPaid 5"),
            case("regression", "c", "unknown", "A page about a receipt"),
            case("hardening", "d", "unknown", "Dear all"),
        ],
        CASE,
    )


def test_evaluation_writes_its_report_before_the_gates_fail(spark, cases, tmp_path):
    with pytest.raises(validate.InvalidInput, match="development, hardening, held-out, regression"):
        runs.run_evaluation(cases, str(tmp_path / "report"))
    totals = {(r.method, r.dataset): (r.cases, r.correct) for r in spark.read.json(str(tmp_path / "report" / "totals")).collect()}
    assert totals[("rules", "regression")] == (3, 3) and totals[("keywordBaseline", "regression")] == (3, 2)
    assert [r.id for r in spark.read.json(str(tmp_path / "report" / "errors")).collect()] == ["c"]
    with pytest.raises(Exception, match="(?i)already exists"):
        runs.run_evaluation(cases, str(tmp_path / "report"))


class Counting:
    """Says tax-invoice, sure; keeps a line of each call in a file, as calls are made in workers."""

    def __init__(self, path, fail=""):
        self.path, self.fail = str(path), fail

    def ask(self, state, questions):
        with open(self.path, "a") as f:
            f.write(",".join(questions) + "\n")
        if self.fail and self.fail in json.dumps(state):
            raise OSError(state)
        p = {o: 0.97 if o == "tax-invoice" else 0.03 / 16 for o in tx.MODEL_OUTCOMES}
        return {"answers": {"document": {"choice": "tax-invoice", "confidence": 0.97, "probabilities": p}}, "inputTokens": 3}


def test_policies_share_one_answer_a_case_even_when_it_failed(cases, tmp_path):
    parts = runs.policy_evaluation(cases, Counting(tmp_path / "calls", fail="Dear all"))
    seen = {(r.policy, r.dataset): r for r in parts["transitions"].collect()}
    assert {r.dataset: (r.pagesSent, r.failed, r.correct) for r in parts["model"].collect()} == {"regression": (3, 0, 1), "hardening": (1, 1, 0)}
    assert len((tmp_path / "calls").read_text().split()) == 4
    assert seen[("uncertain", "regression")].falseSuggestions == 1 and seen[("uncertain", "regression")].retained == 2
    assert seen[("compare", "regression")].degraded == 2 and seen[("uncertain", "hardening")].retained == 1


def test_an_answer_is_taken_apart_by_type(spark):
    class Odd:
        def ask(self, state, questions):
            return {"answers": {"document": {"choice": 5, "confidence": True, "probabilities": {"a": "x", "b": 1}}}, "inputTokens": -1, "truncated": 1}

    row = model.ask_pages(spark.createDataFrame([("k", "{}"), ("k", "{}")], "key string, state string"), Odd()).collect()
    assert [(r.choice, r.confidence, r.probabilities, r.input_tokens, r.truncated) for r in row] == [(None, None, {"a": None, "b": 1.0}, None, True)]


class Forms:
    """The family first, then its schedule; a page that says FAIL gets no answer."""

    def __init__(self, path):
        self.path = str(path)

    def ask(self, state, questions):
        with open(self.path, "a") as f:
            f.write(",".join(sorted(questions)) + "\n")
        if "FAIL" in state["header"]:
            raise OSError
        kind = {"choice": "form_page", "confidence": 0.9, "probabilities": {"form_page": 0.9}}
        if "sub" in questions:
            assert list(questions["sub"]["criteria"]) == ["form-5471", "form-5471-schedule-j", tx.NOT_LISTED]
            return {"answers": {"sub": {"choice": "x", "probabilities": {tx.NOT_LISTED: 0.99, "form-5471-schedule-j": 0.8, "form-5471": 0.1}}}, "inputTokens": 5}
        top = "form-5471" if "5471" in state["header"] else "form-1040"
        return {"answers": {"kind": kind, "form": {"choice": top, "confidence": 0.97, "probabilities": {top: 0.97}}}, "inputTokens": 7}


def test_two_steps_ask_only_what_is_needed(spark, tmp_path):
    catalogue = [("form-1040", None), ("form-5471", None), ("form-5471-schedule-j", "form-5471")]
    criteria = spark.createDataFrame([(i, i, "", 1, p, None, None) for i, p in catalogue], forms.CRITERIA_SCHEMA)
    long = "x" * 70
    rows = [("d", 1, ["Form 1040 " + long], "z"), ("d", 2, ["Form 5471 " + long], "z"), ("d", 3, ["short"], "z"), ("d", 4, ["FAIL " + long], "z"), ("d", 5, [], "z")]
    pages = spark.createDataFrame(rows, "doc_id string, page long, lines array<string>, other string")
    got = {r.page: r for r in forms.classify_pages(pages, criteria, Forms(tmp_path / "calls")).collect()}
    assert [(got[p].form, got[p].calls, got[p].inputTokens, got[p].gated) for p in range(1, 6)] == [
        ("form-1040", 1, 7, True), ("form-5471-schedule-j", 2, 12, False), ("blank", 0, 0, True), ("", 1, 0, False), ("blank", 0, 0, True),
    ]
    assert got[2].formConfidence == 0.8 and got[2].stepConfidences == [0.97, 0.8] and got[4].kind is None and got[1].other == "z"
    assert sorted((tmp_path / "calls").read_text().split()) == ["form,kind", "form,kind", "form,kind", "sub"]


def test_command_line_from_a_file_to_a_summary(spark, tmp_path, capsys):
    pack = tmp_path / "pack.txt"
    pack.write_text("Tax invoice\nGST 1\nTotal 11\fDear all")
    assert cli.main(["classify", str(pack)], spark) == 0
    said = capsys.readouterr().out
    manifest = json.loads(said)
    assert [r["documentType"] for r in manifest["results"]] == ["tax-invoice", "unknown"] and manifest["summary"]["pages"] == 2
    assert "Dear" not in said and "pack.txt" not in said
    (tmp_path / "manifest.json").write_text(said)
    assert cli.main(["review", str(tmp_path / "manifest.json")], spark) == 0
    template = json.loads(capsys.readouterr().out)
    for decision in template["decisions"]:
        decision["decision"] = "tax-invoice"
    (tmp_path / "decisions.json").write_text(json.dumps(template))
    assert cli.main(["review", str(tmp_path / "manifest.json"), str(tmp_path / "decisions.json")], spark) == 0
    summary = json.loads(capsys.readouterr().out)
    assert summary["counts"]["accepted"] == 1 and summary["counts"]["missedByPipeline"] == 1 and len(summary["labels"]) == 2


@pytest.mark.parametrize(
    ("arguments", "message"),
    [
        ([], "Use --help"), (["classify", "x.docx"], "Supported inputs"), (["classify", "x.txt", "--model-url", "http://localhost:1"], "need --model"),
        (["classify", "x.txt", "--model", "--model-url", "http://example.org"], "loopback"), (["classify", "x.txt", "--model", "--model-url", "http://127.0.0.1:9"], "No model server"),
        (["classify", "x.pdf", "--extractor", "no_such:thing"], "module:function"), (["classify", "/nowhere/secret-name.txt"], "The run failed"),
    ],
)
def test_command_line_problems_name_no_content(spark, capsys, arguments, message):
    assert cli.main(arguments, spark) == 1
    err = capsys.readouterr().err
    assert message in err and "secret-name" not in err


def test_reports_of_decision_files_and_batches(spark):
    sha = "a" * 64
    rows = [("f", 1, sha, None, None), ("f", 2, sha, None, "receipt"), ("g", 1, sha, None, None), ("g", 1, sha, None, None), ("h", 1, sha, None, "other"), ("i", 0, sha, None, None)]
    decisions = spark.createDataFrame(rows, "file string, page long, textSha256 string, suggested string, decision string")
    assert {r.file: r.valid for r in validate.decisions_report(decisions).collect()} == {"f": True, "g": False, "h": False, "i": False}
    many = spark.range(501).select(F.lit("b").alias("batch"), F.lit("x.pdf").alias("file"), F.col("id").alias("page"))
    assert not validate.batch_report(many).first().valid and validate.batch_report(many.limit(500)).first().valid
    assert not validate.batch_report(many.limit(3).withColumn("file", F.lit("x.txt"))).first().valid


def test_rules_classify_cases_keep_other_columns(cases):
    pages = cases.withColumn("doc_id", F.col("id")).withColumn("page", F.lit(1))
    assert {"dataset", "label"} <= set(rules.classify(pages).columns)


def test_one_pass_gives_all_counts(spark):
    from quire.operators import evaluate

    names = [*tx.TYPES[:3], "unknown", "ambiguous", "other", None]
    rows = [(d, names[i % 7], names[(i * 3 + len(d)) % 7]) for d in ("a", "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, truth string, prediction string")
    counted = evaluate.counts(df, by=("dataset",))
    plain = lambda frame: sorted(map(repr, frame.collect()))
    columns = evaluate.totals(df, by=("dataset",)).columns
    assert plain(evaluate.totals_of(counted, ("dataset",)).select(*columns)) == plain(evaluate.totals(df, by=("dataset",)))
    assert plain(evaluate.per_category_of(counted, ("dataset",))) == plain(evaluate.per_category(df, by=("dataset",)))
    assert plain(evaluate.totals_of(evaluate.counts(df))) == plain(evaluate.totals(df).select(*evaluate.totals_of(evaluate.counts(df)).columns))
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def test_policies_meet_their_answers_in_one_join(spark, cases, tmp_path):
    outcomes, answers = model.compare_policies(rules.classify(runs._as_pages(cases)), Counting(tmp_path / "calls"))
    plan = outcomes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {c for c in answers.columns if c.startswith("_")} == set() and "probabilities" in answers.columns
    assert outcomes.groupBy("policy").count().collect() and outcomes.count() == 8


def test_a_case_is_judged_once_a_policy(spark, cases, tmp_path):
    twice = cases.union(spark.createDataFrame([case("hardening", "a", "receipt", "Payment receipt\nPaid 6")], CASE))
    parts = runs.policy_evaluation(twice, Counting(tmp_path / "calls"))
    assert parts["outcomes"].count() == 10 and sum(r.pagesSent for r in parts["model"].collect()) == 5
    assert parts["totals"].agg(F.sum("cases")).first()[0] == 10


def _counted_lines(path):
    def lines(text):
        with open(path, "a") as f:
            f.write("x")
        return text.split("|")

    return F.udf(lines, "array<string>")(F.col("text"))


def test_lines_of_a_page_are_made_once(spark, tmp_path):
    criteria = spark.createDataFrame([("form-1040", "form-1040", "", 1, None, None, None)], forms.CRITERIA_SCHEMA)
    rows = [("d", i, f"Form 1040 {i}|" + "x" * 70 if i % 2 else "short") for i in range(6)]
    pages = spark.createDataFrame(rows, "doc_id string, page long, text string")
    lined = pages.select("doc_id", "page", _counted_lines(str(tmp_path / "a")).alias("lines"))
    got = {r.page: r.form for r in forms.classify_pages(lined, criteria, Forms(tmp_path / "calls")).collect()}
    assert got == {i: "form-1040" if i % 2 else "blank" for i in range(6)} and len((tmp_path / "a").read_text()) == 6


def test_titles_read_lines_once(spark):
    lines = F.split(F.concat("text", F.lit("|x")), "[|]")
    pages = spark.createDataFrame([("a", 1, "short"), ("a", 2, "A title 2024 of a page|" + "x" * 70)], "id string, page long, text string").select("id", "page", lines.alias("lines"))
    found = catalogue.first_titles(pages)
    assert [(r.id, r.title[:18]) for r in found.collect()] == [("a", "A title of a page ")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_titles_beyond_the_text_that_is_folded_first(spark):
    far = [" " * 3000 + "Far away", "x" * 3000, "a " * 2000, "For Privacy Act y" + "x" * 2000, "   ", "Cat. No. 1 VOID " * 200 + "end", "w " * 40 + "\U0001f600"]
    got = [r.t for r in spark.createDataFrame([(i, [t]) for i, t in enumerate(far)], "i int, lines array<string>").select(catalogue.title_of(F.col("lines")).alias("t"), "i").orderBy("i").collect()]
    assert got == ["Far away", "x" * 80, "a " * 40, "", "", "end", "w " * 40]
