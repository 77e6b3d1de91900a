import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions import taxonomy as tx
from quire.operators import catalogue, evaluate, fallback, forms, model, review, rules, validate
from quire.sources import readers, writers
from quire.streaming.pages import classify_stream, read_page_stream

SHA = "a" * 64


def result(page, kind, method="rules", sha=SHA, reason="no_rule_match", confidence=None):
    return (page, sha, kind, method, reason, tx.TAXONOMY_VERSION, confidence)


RESULT = "page long, textSha256 string, documentType string, method string, reason string, taxonomyVersion string, confidence double"
DECISION = "page long, textSha256 string, suggested string, decision string"


@pytest.fixture
def manifest(spark):
    rows = [result(1, "tax-invoice"), result(2, "receipt", "model", confidence=0.97), result(3, "unknown"), result(4, "unreadable", "extraction"), result(5, "bank-statement"), result(6, "dividend-statement"), result(7, "unreadable", "extraction")]
    return spark.createDataFrame(rows, RESULT)


@pytest.fixture
def decisions(spark):
    said = ["tax-invoice", "unknown", "loan-statement", "unreadable", None, "managed-fund-statement", "receipt"]
    return spark.createDataFrame([(i + 1, SHA, None, d) for i, d in enumerate(said)], DECISION)


def test_review_of_seven_pages(manifest, decisions):
    got = review.summarise(manifest, decisions, "m", "m", reviewer="")
    assert got["counts"].first().asDict() == {"pages": 7, "reviewed": 6, "notReviewed": 1, "accepted": 2, "falseSuggestions": 1, "changedCategory": 1, "missedByPipeline": 1, "unreadableButNamed": 1}
    assert {r.method: (r.pages, r.accepted) for r in got["methods"].collect()} == {"rules": (3, 1), "model": (1, 0), "extraction": (2, 1)}
    by = {r.category: r for r in got["categories"].collect()}
    assert len(by) == 15 and (by["tax-invoice"].precision, by["tax-invoice"].recall) == (1.0, 1.0)
    assert (by["receipt"].precision, by["receipt"].recall) == (0.0, 0.0) and by["dividend-statement"].precision == 0.0 and by["dividend-statement"].recall is None
    assert got["labels"].count() == 6 and got["reviewer"] is None


def test_review_refuses_other_manifests_pages_and_texts(spark, manifest, decisions):
    with pytest.raises(validate.InvalidInput, match="different manifest"):
        review.joined(manifest, decisions, "m", "n")
    with pytest.raises(validate.InvalidInput, match="no page"):
        review.joined(manifest, decisions.withColumn("page", F.col("page") + 1), "m", "m")
    with pytest.raises(validate.InvalidInput, match="different text"):
        review.joined(manifest, decisions.withColumn("textSha256", F.lit("b" * 64)), "m", "m")


def test_manifest_and_decision_validators(spark, manifest, decisions):
    validate.require_manifest(manifest, "au-review-1")
    for change in ({"textSha256": F.lit("x")}, {"documentType": F.lit("other")}, {"reason": F.lit("Text here")}, {"page": F.lit(1)}, {"taxonomyVersion": F.lit("au-2")}, {"method": F.lit(None).cast("string")}):
        with pytest.raises(validate.InvalidInput):
            validate.require_manifest(manifest.withColumns(change), "au-review-1")
    with pytest.raises(validate.InvalidInput):
        validate.require_manifest(manifest, "au-review-2")
    with pytest.raises(validate.InvalidInput):
        validate.require_manifest(manifest.where("false"), "au-review-1")
    head = spark.createDataFrame([("au-review-decisions-1", SHA, "rev-1", "2026-09-27T10:00:00+10:00")], "schemaVersion string, manifestSha256 string, reviewer string, reviewedAt string")
    validate.require_decisions(head, decisions)
    for change in ({"reviewer": F.lit("a@b")}, {"reviewedAt": F.lit("2026-13-45")}, {"schemaVersion": F.lit("x")}):
        with pytest.raises(validate.InvalidInput):
            validate.require_decisions(head.withColumns(change), decisions)
    with pytest.raises(validate.InvalidInput):
        validate.require_decisions(head, decisions.withColumn("decision", F.lit("maybe")))


def answer(choice, p, confidence=None, others=None, **more):
    rest = (1 - p) / 16 if others is None else others
    probabilities = {k: (p if k == choice else rest) for k in tx.MODEL_OUTCOMES}
    return {"answers": {"document": {"choice": choice, "confidence": p if confidence is None else confidence, "probabilities": probabilities}}, "inputTokens": 7, **more}


class Stub:
    def __init__(self, got):
        self.got = got

    def ask(self, state, questions):
        assert set(questions["document"]["criteria"]) == set(tx.MODEL_OUTCOMES) and set(state) == {"page", "text"}
        if isinstance(self.got, Exception):
            raise self.got
        return self.got


def tie(a, b):
    out = answer(a, 0.5, others=0.0)
    out["answers"]["document"]["probabilities"][b] = 0.5
    return out


INVOICE, PLAIN, BOTH = "Tax invoice\nGST total", "hello there", "Tax invoice and receipt\nGST total paid"


@pytest.mark.parametrize(
    ("text", "got", "policy", "kind", "reason"),
    [
        (INVOICE, answer("tax-invoice", 0.97), "compare", "tax-invoice", "model_suggestion_requires_validation"),
        (INVOICE, answer("receipt", 0.97), "compare", "ambiguous", "model_rule_disagreement"),
        (INVOICE, answer("receipt", 0.97), "uncertain", "tax-invoice", "rule_suggestion"),
        (PLAIN, answer("receipt", 0.97), "uncertain", "receipt", "model_suggestion_requires_validation"),
        (PLAIN, answer("receipt", 0.94), "compare", "unknown", "below_model_gate"),
        (PLAIN, answer("unknown", 0.99), "compare", "unknown", "model_suggestion_requires_validation"),
        (PLAIN, tie("receipt", "tax-invoice"), "compare", "ambiguous", "tied_model_choices"),
        (BOTH, answer("receipt", 0.99), "compare", "ambiguous", "conflicting_category_evidence"),
        (BOTH, RuntimeError("no"), "compare", "ambiguous", "model_unavailable"),
        (PLAIN, RuntimeError("no"), "compare", "unknown", "model_unavailable"),
        (PLAIN, answer("receipt", 0.97, truncated=True), "compare", "unknown", "model_input_truncated"),
        (PLAIN, answer("receipt", 0.97, confidence=0.5), "compare", "unknown", "invalid_model_response"),
        (PLAIN, {"answers": {}, "inputTokens": 1}, "compare", "unknown", "invalid_model_response"),
        (PLAIN, answer("receipt", 0.97) | {"inputTokens": -1}, "compare", "unknown", "invalid_model_response"),
        ("y" * 20_001, answer("receipt", 0.97), "compare", "unknown", "model_input_too_long"),
        ("Please send the receipt", answer("receipt", 0.99), "uncertain", "unknown", "context_only_or_instructions"),
    ],
)
def test_model_decisions(spark, text, got, policy, kind, reason):
    pages = rules.classify(spark.createDataFrame([("d", 1, text, "native", None, None, None)], rules.PAGE_SCHEMA))
    row = model.classify_with_model(pages, Stub(got), allow=True, policy=policy).first()
    assert (row.documentType, row.reason) == (kind, reason)
    asked = reason not in ("rule_suggestion", "model_input_too_long", "context_only_or_instructions")
    assert row.calls == int(asked) and row.requiresReview


def test_text_is_not_sent_without_permission(spark):
    pages = rules.classify(spark.createDataFrame([("d", 1, PLAIN, "native", None, None, None)], rules.PAGE_SCHEMA))
    with pytest.raises(validate.InvalidInput):
        model.classify_with_model(pages, Stub(answer("receipt", 0.97)))
    assert model.classify_with_model(pages, None).first().documentType == "unknown"
    for bad in ({"gate": 0}, {"gate": 1.5}, {"policy": "other"}):
        with pytest.raises(validate.InvalidInput):
            model.classify_with_model(pages, Stub(None), allow=True, **bad)


def test_http_backend_retries():
    calls = []

    class Fake(model.HttpBackend):
        def send(self, body):
            calls.append(json.loads(body))
            reply = replies.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply

    ok = (200, json.dumps({"answers": {"document": {"choice": "receipt", "answer_confidence": 0.9, "confidence": 0.1, "probabilities": {}}}, "usage": {"input_tokens": 1024}}))
    made = model.local_backend()
    backend = Fake("x", "http://localhost", "m", limit=1024, criteria=made.criteria, answer=made.answer, pause_s=0.0)
    replies = [OSError("down"), (503, ""), (429, ""), ok]
    got = backend.ask({}, model.question())
    assert got["truncated"] and got["answers"]["document"]["confidence"] == 0.9 and len(calls) == 4
    assert isinstance(calls[0]["questions"]["document"]["criteria"]["receipt"], str)
    replies = [(402, "secret")]
    with pytest.raises(RuntimeError, match="payment required"):
        backend.ask({}, model.question())
    replies = [(400, "secret")]
    with pytest.raises(RuntimeError) as error:
        backend.ask({}, model.question())
    assert "secret" not in str(error.value)
    for url in ("http://example.org", "ftp://localhost", "http://localhost.example.org"):
        with pytest.raises(validate.InvalidInput):
            validate.local_origin(url)
    assert validate.local_origin("http://[::1]:9/x") == "http://[::1]:9" and validate.local_origin() == "http://127.0.0.1:8000"


PAGES = [("a", 1, "Tax invoice\nGST total", "native", None, None, None), ("a", 2, "", "needs_ocr", None, None, None), ("b", 1, "x", "failed", ["w"], None, None), ("c", 1, "hello", "native", None, None, None)]


def test_fallback_replaces_or_flags_whole_documents(spark):
    pages = spark.createDataFrame(PAGES, rules.PAGE_SCHEMA)
    assert sorted(map(tuple, fallback.select_pages(pages).collect())) == [("a", 2), ("b", 1)]

    def reader(doc, numbers):
        if doc == "b":
            raise ValueError("secret")
        return [readers.ocr_page(n, [("Receipt", 0.9), ("paid", 0.7)]) for n in numbers]

    got = {(r.doc_id, r.page): r for r in fallback.retry(pages, reader).collect()}
    assert got["a", 2].text == "Receipt\npaid" and got["a", 2].warnings == [tx.LOW_LINES] and got["a", 2].extraction == "ocr"
    assert got["b", 1].warnings == ["w", tx.FALLBACK_FAILED] and got["b", 1].text == "x" and got["a", 1].text == PAGES[0][2]
    wrong = fallback.retry(pages, lambda doc, numbers: [readers.ocr_page(n + 1, [("t", 0.9)]) for n in numbers])
    assert {r.doc_id for r in wrong.where(F.array_contains("warnings", tx.FALLBACK_FAILED)).collect()} == {"a", "b"}
    assert readers.ocr_page(1, [])["warnings"] == ["paddle_ocr_requires_review"] and readers.ocr_page(1, [])["ocr_line_confidence"] == [0.0]
    for lines in ([("a", 1.5)], [("a", float("nan"))]):
        with pytest.raises(ValueError):
            readers.ocr_page(1, lines)
    assert fallback.retry(pages.where("doc_id = 'c'"), None).count() == 1
    with pytest.raises(validate.InvalidInput):
        fallback.retry(pages, reader, check_batch=True)
    with pytest.raises(validate.InvalidInput):
        validate.require_batch(spark.createDataFrame([("x.txt",)], "file string"), pages)


def test_a_document_is_read_once(spark, tmp_path):
    """One call a document, however often the result is read; each call leaves a file."""
    pages = spark.createDataFrame(PAGES, rules.PAGE_SCHEMA)

    def reader(doc, numbers):
        import uuid

        (tmp_path / f"{doc}-{uuid.uuid4().hex}").write_text("")
        return [readers.ocr_page(n, [("Receipt", 0.9)]) for n in numbers]

    got = fallback.retry(pages, reader)
    assert got.count() == len(PAGES) and got.where("extraction = 'ocr'").count() == 2
    assert sorted(f.name[0] for f in tmp_path.iterdir()) == ["a", "b"]


def test_reviews_and_second_readings_classify_once(spark, small):
    """The rules are not copied into each branch of the plan."""
    from quire.plans.queries import QUERIES

    for name in ("j2_fallback_merge", "r2_per_category", "r2_review_counts", "r2_by_method", "r2_labels"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") < 100, name


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\f")
    got = [(r.page, r.text) for r in readers.read_pages(spark, str(tmp_path / "a.txt")).orderBy("page").collect()]
    assert got == [(1, "one"), (2, "two"), (3, "")]
    pack = [{"page": 1, "text": "a", "extraction": "native"}, {"page": 4, "text": "b\nc", "extraction": "ocr", "warnings": [], "ocrEngine": tx.ENGINES[0], "ocrLineConfidence": [0.5, 1]}]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(pack))
    assert [(r.pos, r.page, r.ocr_line_confidence) for r in readers.read_pages(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(0, 1, None), (1, 4, [0.5, 1.0])]
    for change in ({"page": 0}, {"page": 4}, {"extraction": "x"}, {"ocrLineConfidence": [1.0]}):
        (tmp_path / "b.json").write_text(json.dumps([pack[0] | change, pack[1]]))
        with pytest.raises(validate.InvalidInput):
            readers.read_pages(spark, str(tmp_path / "b.json"))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.csv").write_text("x")
    with pytest.raises(validate.InvalidInput):
        readers.read_pages(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF one two")
    pdf = readers.read_pages(spark, str(tmp_path / "d.pdf"), lambda c: [{"page": i + 1, "text": w.decode(), "extraction": "native", "warnings": []} for i, w in enumerate(c.split()[1:])])
    assert [r.text for r in pdf.orderBy("page").collect()] == ["one", "two"]
    broken = readers.read_pages(spark, str(tmp_path / "d.pdf"), lambda c: 1 / 0)
    assert [(r.extraction, r.text) for r in broken.collect()] == [("failed", "")]


def test_corpus_and_manifest_files(spark, tmp_path):
    case = {"id": "1", "group": "g", "label": "receipt", "extraction": "native", "text": "Receipt paid"}
    (tmp_path / "development.json").write_text(json.dumps([case]))
    (tmp_path / "hardening.json").write_text(json.dumps([case | {"id": "2", "group": "h", "text": "x"}]))
    got = readers.read_corpus(spark, str(tmp_path), ["development", "hardening"], pinned={})
    assert got.count() == 2
    with pytest.raises(validate.InvalidInput, match="changed"):
        readers.read_corpus(spark, str(tmp_path), ["development"])
    for bad in ({"id": "1"}, {"group": "g"}, {"text": "Receipt paid"}, {"label": "other"}):
        (tmp_path / "hardening.json").write_text(json.dumps([case | {"id": "2", "group": "h", "text": "x"} | bad]))
        with pytest.raises(validate.InvalidInput):
            readers.read_corpus(spark, str(tmp_path), ["development", "hardening"], pinned={})
    done = rules.classify(spark.createDataFrame(PAGES[:2], rules.PAGE_SCHEMA))
    (tmp_path / "m.json").write_text(writers.manifest_json(done).first().json)
    m = readers.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert m.schemaVersion == "au-review-1" and len(m.results) == 2 and len(m.sha256) == 64
    template = review.decision_template(done, m.sha256)
    (tmp_path / "t.json").write_text(writers.template_json(template, m.sha256).first().json)
    d = readers.read_decisions(spark, str(tmp_path / "t.json")).first()
    assert d.manifestSha256 == m.sha256 and [x.decision for x in d.decisions] == [None, None]
    writers.write_report(template, str(tmp_path / "report"))
    with pytest.raises(Exception, match="already exists"):
        writers.write_report(template, str(tmp_path / "report"))


def test_ids(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    names = {"Form 1040 Schedule A": "form-1040-schedule-a", "Form 1040NR Schedule NEC": "form-1040-nr-schedule-nec", "Form 8995A Schedule A": "form-8995-a-schedule-a", "Form 1065 Schedule K1": "form-1065-schedule-k-1", "Form 1040 Schedule 1A": "form-1040-schedule-1-a", "Form W2G": "form-w-2g", "Form 1099R": "form-1099-r"}
    for name, want in names.items():
        assert one(ids.id_of_name(F.lit(name))) == want and one(ids.is_form_id(F.lit(want)))
    with pytest.raises(Exception, match="not a form name"):
        one(ids.id_of_name(F.lit("1040")))
    assert one(ids.page_of(F.lit("form-1040/p2"))) == 2 and one(ids.page_of(F.lit("form-1040"))) is None
    assert one(ids.label_of(F.lit("form-5471-schedule-j"))) == "Schedule J (Form 5471)" and one(ids.parent_of(F.lit("form-5471-schedule-j"))) == "form-5471"
    assert not one(ids.is_form_id(F.lit("form-1040\n"))) and not one(ids.is_form_id(F.lit("schedule-a")))


def test_forms_in_two_steps(spark):
    criteria = spark.createDataFrame([("form-1040", "Form 1040", "Return", 2, None, ["1 Wages"], ["Form 1"]), ("form-5471", "Form 5471", "", 1, None, None, None), ("form-5471-schedule-j", "Schedule J (Form 5471)", "", 1, "form-5471", None, None)], forms.CRITERIA_SCHEMA)
    options = forms.criteria_dict(forms.first_list(criteria))
    assert list(options) == ["form-1040", "form-5471", tx.NOT_LISTED] and options["form-1040"] == {"what": "Form 1040 — Return", "examples": ["1 Wages"], "not_for": "Not Form 1"}
    assert [r.id for r in forms.members(criteria, "form-5471").collect()] == ["form-5471", "form-5471-schedule-j"]
    schema = "truth string, label string, page int, lines array<string>, kind_choice string, kind_confidence double, form_probabilities map<string,double>, tokens1 int, sub_probabilities map<string,double>, tokens2 int"
    body = ["x" * 70]
    rows = [("blank", "a", 1, ["short"], None, None, None, None, None, None), ("form-1040", "b", 1, body, "form_page", 0.9, {"form-1040": 0.4, "form-5471": 0.1, tx.NOT_LISTED: 0.5}, 10, None, None), ("form-5471", "c", 2, body, "form_page", 0.9, {"form-1040": 0.01, "form-5471": 0.98}, 10, {"form-5471": 0.02, "form-5471-schedule-j": 0.97}, 5)]
    order, sub = (F.array(*map(F.lit, x)) for x in (["form-1040", "form-5471"], ["form-5471", "form-5471-schedule-j"]))
    scored = forms.score(forms.decide_forms(spark.createDataFrame(rows, schema), order, sub))
    got = [(r.form, r.formConfidence, r.calls, r.inputTokens, r.gated, r.wrong, r.strict) for r in scored.orderBy("label").collect()]
    assert got == [("blank", 1.0, 0, 0, True, False, False), ("form-1040", 0.4, 1, 10, False, False, True), ("form-5471-schedule-j", 0.97, 2, 15, True, True, True)]
    total = forms.summarise(scored).first()
    assert (total.pages, total.wrong, total.strict, total.calls, total.inputTokens) == (3, 1, 2, 3, 25) and total.estCostUsd == pytest.approx(25 * 0.042 / 1e6)
    assert [r.label for r in forms.strict_errors(scored).collect()] == ["b", "c"] and forms.summarise(scored.where("false")).first().strictRate == 0.0


def test_catalogue(spark):
    body = "Department of the Treasury Interest Income OMB No. 1545-0112 2025"
    pages = [("form-1099-int", 1, ["Attention: filers", "x" * 80]), ("form-1099-int", 2, [body, "1 Interest income     2 Early withdrawal penalty", "1 Interest again too", "3 short", "4 See instructions here", "x" * 60]), ("form-1099-int", 3, [""]), ("form-1098", 1, ["Mortgage Interest Statement " + "y" * 60])]
    frame = spark.createDataFrame(pages, "id string, page int, lines array<string>")
    built = {r.id: r for r in catalogue.build(spark.createDataFrame([("form-1099-int",), ("form-1098",)], "id string"), frame).collect()}
    assert built["form-1099-int"].boxes == ["1 Interest income", "2 Early withdrawal penalty"] and built["form-1099-int"].page_count == 3
    assert built["form-1099-int"].title.startswith("Interest Income") and built["form-1098"].title == catalogue.TITLES["form-1098"]
    listed = {r.id: r for r in catalogue.manifest(spark.createDataFrame([("form-1099-int",), ("form-1098",)], "id string"), frame).collect()}
    assert listed["form-1099-int"].blankPages == [3] and listed["form-1098"].url.endswith("f1098.pdf") and listed["form-1098"].source == "info"
    counted = catalogue.counters(catalogue.build(spark.createDataFrame([("form-1098",)], "id string"), frame), catalogue.manifest(spark.createDataFrame([("form-1098",)], "id string"), frame)).first()
    assert (counted.forms, counted.with_boxes, counted.schedules, counted.pages, counted.blank_pages) == (1, 0, 0, 1, 0)


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", "<sst><si><t>Form 1040</t></si><si><t>Other</t></si><si><t>Form  1040 Schedule &amp;</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", '<d><row r="1"><c r="A1" t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="s"><v>1</v></c></row><row><c t="s"><v>2</v></c></row><row></row></d>')
    assert sorted(r.name for r in readers.read_form_names(spark, str(tmp_path / "f.xlsx")).collect()) == ["Form 1040", "Form 1040 Schedule &"]


def test_gates(spark):
    seen = spark.createDataFrame([(d, t, 1) for d in tx.GATE_COMPLETE for t in tx.TYPES], "dataset string, category string, cases int")
    scores = spark.createDataFrame([(d, n, n) for d, n in tx.GATE_CASES.items()], "dataset string, cases int, correct int")
    evaluate.assert_gates(scores, seen)
    for bad in (scores.where("dataset <> 'hardening'"), scores.withColumn("correct", F.col("correct") - 1), scores.withColumn("cases", F.col("cases") - 1)):
        with pytest.raises(validate.InvalidInput):
            evaluate.assert_gates(bad, seen)
    with pytest.raises(validate.InvalidInput):
        evaluate.assert_gates(scores, seen.where("category <> 'receipt'"))


def test_limits(spark):
    pages = spark.createDataFrame([("a", 10, 1, 100.0, 100.0, 2.0), ("a", 10, 2, 6000.0, 10.0, 2.0), ("b", 10, 1, 2236.0, 2236.0, 2.0), ("c", 10, 1, float("nan"), 1.0, 1.0), ("d", 10, 1, 5000.0, 1000.0, 2.0)], "file string, bytes long, page int, width double, height double, scale double")
    assert {r.file: r.valid for r in validate.geometry_report(pages).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_stream(spark, tmp_path):
    pd.DataFrame([{"doc_id": "a", "page": 1, "text": INVOICE, "extraction": "native"}, {"doc_id": "a", "page": 0, "text": "x", "extraction": "native"}]).to_json(tmp_path / "in.json", orient="records", lines=True)
    (tmp_path / "in").mkdir()
    (tmp_path / "in.json").rename(tmp_path / "in" / "1.json")
    classify_stream(read_page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [r.documentType for r in got.collect()] == ["tax-invoice"] and "text" not in got.columns and spark.read.parquet(str(tmp_path / "bad")).count() == 1
