"""Workflow predicates, catalogues, prompts and the model callable on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from clausegrid import constants
from clausegrid.operators import catalogue, dossier, findings, prompts, render, rules, workflow

SCHEMA = "doc_id long, idx int, block_type string, text string"


@pytest.mark.parametrize(
    "key,want",
    [("a/b", "a/b"), (" a//./b/ ", "a/b"), ("/a", None), ("a\\b", None), ("C:/a", None), ("a/../b", None), ("..a/b", "..a/b"), ("", None), (" ", None), (None, None), ("./", None)],
)
def test_storage_keys(spark, key, want):
    assert spark.createDataFrame([(key,)], "k string").select(workflow.normalised_key(F.col("k")).alias("k")).first().k == want


def test_every_error_code_is_classified(spark):
    codes = [c for c, _, _ in constants.ERRORS]
    assert len(codes) == len(set(codes)) == 47
    got = {r.error_code: r for r in workflow.classify_errors(spark.createDataFrame([(c,) for c in [*codes, "?"]], "error_code string")).collect()}
    assert all((got[c].http_status, got[c].category) == (h, k) for c, h, k in constants.ERRORS)
    assert (got["?"].http_status, got["?"].should_block, got["LLM_TIMEOUT"].retryable, got["OCR_LOW_QUALITY"].should_block) == (500, True, True, False)


def test_snapshots(spark):
    rows = [("A", 1, "v1", 1, "R1"), ("B", 2, "", None, None), ("C", None, None, 5, "R5"), ("D", 3, "v3", None, None), ("E", 4, "v4", 7, "")]
    df = spark.createDataFrame(rows, "contract_type string, set_id long, version string, rule_id long, rule_code string")
    assert {r.contract_type: r.verdict for r in catalogue.check_snapshots(df).collect()} == {"A": "OK", "B": "VERSION_MISSING", "C": "RULES_WITHOUT_SET", "D": "OK", "E": "MALFORMED_RULE"}


def test_converge_twice_keeps_everything(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "k string, v int")
    assert {r.k: r.action for r in catalogue.converge(old, new, "k", ["v"]).collect()} == {"a": "DELETE", "b": "UPDATE", "c": "KEEP", "d": "INSERT"}
    assert {r.action for r in catalogue.converge(new, new, "k", ["v"]).collect()} == {"KEEP"}


def test_all_or_nothing_batches(spark):
    schema = "doc_id long, seq long, risk_level string, ambiguous boolean, batch_error string"
    rows = [(1, 0, "HIGH", False, None), (1, 1, "LOW", False, None), (2, 0, "HIGH", False, None), (2, 1, "HIGH", True, None), (3, 0, "ODD", False, None), (4, 0, "LOW", False, "RULE_NOT_FOUND"), (5, 0, "LOW", False, None)]
    gates = spark.createDataFrame([(i, "OK") for i in range(1, 5)] + [(5, "DOCUMENT_NOT_PERSISTED")], "doc_id long, risk_gate string")
    got = catalogue.persist_risks(gates, spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.seq, r.review_status) for r in got) == [(1, 0, "PENDING"), (1, 1, "PENDING")]


@pytest.fixture(scope="module")
def document(spark):
    texts = ["第一条 违约责任", "甲方承担无限责任", "第二条", "x"]
    return spark.createDataFrame([(1, i, "PARAGRAPH", t) for i, t in enumerate(texts)], SCHEMA)


def test_prompt_request_and_model(spark, document):
    made = prompts.prompts_of(dossier.dossiers(document, rules.seed_rules()))
    text = made.first().user_prompt
    assert text.startswith("【合同类型】PURCHASE\n\n【本批条款】（共 2 条，clause_index 请原样回显）\n--- 条款 #0（第一条 违约责任·LIABILITY）---\n第一条 违约责任\n甲方承担无限责任\n\n--- 条款 #1（第二条·OTHER）---")
    assert text.endswith("- rule_code=LIAB_UNLIMITED_001 | 我方单方承担无限责任 | 维度=违约责任 | 等级=HIGH | 命中证据：无限责任")
    body = json.loads(prompts.requests(made, "system", "m").first().request)
    assert body["messages"][1]["content"] == text and body["response_format"] == {"type": "json_object"} and body["temperature"] == 0.2

    def answers(texts):
        return [('{"findings": []}', None) for _ in texts]

    def broken(texts):
        raise OSError("no network")

    assert [(r.raw_text, r.llm_error_code) for r in prompts.complete(made, answers).collect()] == [('{"findings": []}', None)]
    for model in (None, broken):
        assert [(r.raw_text, r.llm_error_code) for r in prompts.complete(made, model).collect()] == [(None, "LLM_UNAVAILABLE")]
    assert findings.guard_json(prompts.complete(made, answers)).first().json_status == "VALID"


def test_no_rule_hits_prompt(spark):
    p = spark.createDataFrame([(1, 0, "PARAGRAPH", "x")], SCHEMA)
    assert prompts.prompts_of(dossier.dossiers(p, rules.seed_rules())).first().user_prompt == "【合同类型】PURCHASE\n\n【本批条款】（共 1 条，clause_index 请原样回显）\n--- 条款 #0（OTHER）---\nx\n\n【规则已命中】（无）"


def test_cells_escape_tables(spark):
    got = spark.createDataFrame([("\u3000a|b\nc\r",), (" ",), (None,)], "v string").select(render.cell(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == ["a\\|b c", "—", "—"]
