"""Operators on small tables, by hand-made expectations and by properties."""

import io
import math
import random
import re
import zipfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clausegrid import constants
from clausegrid.functions import terms
from clausegrid.functions import text as ft
from clausegrid.operators import catalogue, clauses, dossier, findings, keywords, merge, metadata, paragraphs, persist, readmodels, render, rules, sweep
from clausegrid.plans.review import review
from clausegrid.queries import QUERIES
from clausegrid.sources import docx, tables_by_task
from clausegrid.streaming import ingest

SCHEMA = "doc_id long, idx int, block_type string, text string"


def para(spark, *texts, doc=1):
    rows = [(doc, i, "TABLE_ROW" if "\t" in t else "PARAGRAPH", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def golden(spark):
    """A purchase contract of 44 paragraphs with clauses, metadata and risks at known places."""
    t = [""] * 44
    t[0], t[1] = "软件采购合同", "合同编号：HT-2026-001"
    t[3] = "甲方（采购方）：启明数智科技（上海）有限公司"
    t[4] = "统一社会信用代码：91310115MA1K4ABC2X"
    t[5] = "乙方（供应方）：某某软件有限公司"
    for i, (at, name) in enumerate([(8, "合同标的与金额"), (11, "交付与验收"), (15, "付款方式"), (22, "知识产权"), (25, "保密"), (28, "违约责任"), (31, "争议解决"), (34, "其他")]):
        t[at] = f"第{'一二三四五六七八'[i]}条 {name}"
    t[10] = "合同总价为人民币 1,200,000.00 元"
    t[17], t[18], t[19], t[20] = "付款阶段\t比例\t条件", "1. 预付款\t30%\t合同生效后", "2. 进度款\t40%\t上线后", "3. 尾款\t30%\t验收后"
    t[23] = "本项目产生的知识产权归乙方所有"
    t[30] = "甲方应赔偿乙方全部损失"
    t[35], t[40] = "本合同有效期至 2029年9月13日", "签订日期：2026年 9 月 14 日"
    return para(spark, *t)


def test_golden_clauses(golden):
    got = clauses.segment_clauses(golden).orderBy("clause_index").collect()
    assert [(r.clause_no, r.start_idx, r.end_idx) for r in got] == [(None, 0, 7), ("第一条", 8, 10), ("第二条", 11, 14), ("第三条", 15, 21), ("第四条", 22, 24), ("第五条", 25, 27), ("第六条", 28, 30), ("第七条", 31, 33), ("第八条", 34, 43)]
    assert [r.clause_type for r in got] == ["OTHER", "SUBJECT", "ACCEPTANCE", "AMOUNT_PAYMENT", "IP", "CONFIDENTIAL", "LIABILITY", "DISPUTE", "OTHER"]
    assert got[1].title == "合同标的与金额" and got[0].title is None


def test_golden_metadata(golden):
    got = {r.field_key: (r.field_value, r.idx) for r in metadata.extract_metadata(golden).collect()}
    assert got["contract_amount"] == ("1200000.00", 10) and got["currency"] == ("CNY", 10)
    assert got["sign_date"] == ("2026-09-14", 40) and got["expire_date"] == ("2029-09-13", 35) and "effective_date" not in got
    assert got["prepay_ratio"] == ("0.3", 18) and got["payment_terms"][1] == 17 and got["payment_terms"][0].count("\n") == 3
    assert got["our_party_name"] == ("启明数智科技（上海）有限公司", 3) and got["counterparty_name"][1] == 5 and got["credit_code"][1] == 4


def test_golden_rules(golden):
    some = rules.seed_rules()
    verdicts = {r.rule_code: r.status for r in rules.evaluate(golden, some).collect()}
    assert verdicts == {"IP_OWNER_SUPPLIER_001": "MATCHED", "LIAB_UNLIMITED_001": "MATCHED", "PAY_PREPAY_RATIO_001": "NOT_MATCHED"}
    got = [(r.risk_code, r.paragraph_index, r.quote) for r in rules.rule_risks(golden, some).orderBy("seq").collect()]
    assert got == [("IP_OWNER_SUPPLIER_001", 23, "知识产权归乙方"), ("LIAB_UNLIMITED_001", 30, "全部损失")]


def test_golden_invariants(golden):
    rows = paragraphs.block_offsets(golden).orderBy("idx").collect()
    whole = "\n".join(r.text for r in rows)
    assert all(whole[r.char_start : r.char_end] == r.text for r in rows)
    placed = clauses.with_clauses(golden).groupBy("idx").count().where("count <> 1").count()
    assert placed == 0


@pytest.mark.parametrize(
    "texts,mode,starts",
    [
        (["一、总则", "x"], None, [0]),
        (["一、总则", "二、付款"], "CN_NUM", [0, 1]),
        (["序", "1. a", "2、b", "3.5 折"], "ARAB", [0, 1, 2]),
        (["1. a", "2. b", "第 3 条 c"], "TIAO", [0, 2]),
        (["第１条 全角", "1. 预付\t30%"], "TIAO", [0]),
    ],
)
def test_numbering_modes(spark, texts, mode, starts):
    p = para(spark, *texts)
    assert clauses.numbering_mode(p).first().mode == mode
    assert [r.start_idx for r in clauses.segment_clauses(p).orderBy("clause_index").collect()] == starts


@pytest.mark.parametrize(
    "text,amount,currency",
    [("¥1,234.5", "1234.50", "CNY"), ("总价 100 美元", "100.00", "USD"), ("欧元 7", "7.00", "EUR"), ("港币 0.125 元", "0.12", "HKD"), ("0.135元", "0.14", "CNY"), ("无金额", None, None), ("¥,", None, None)],
)
def test_amounts(spark, text, amount, currency):
    got = {r.field_key: r.field_value for r in metadata.extract_metadata(para(spark, text)).collect()}
    assert (got.get("contract_amount"), got.get("currency")) == (amount, currency)


@pytest.mark.parametrize("percent,ratio", [("30%", "0.3"), ("100％", "1"), ("30.5 %", "0.305"), ("0%", "0"), ("5%", "0.05")])
def test_prepay_ratio(spark, percent, ratio):
    got = metadata.extract_metadata(para(spark, f"预付款\t{percent}")).where("field_key = 'prepay_ratio'").collect()
    assert [r.field_value for r in got] == [ratio]


@pytest.mark.parametrize("op,value,status", [("gt", 0.3, "NOT_MATCHED"), ("gte", 0.3, "MATCHED"), ("lt", 0.3, "NOT_MATCHED"), ("lte", 0.3, "MATCHED"), ("eq", 0.3, "MATCHED"), ("ne", 0.3, "NOT_MATCHED"), ("gt", 0.29, "MATCHED"), ("ne", 1, "MATCHED")])
def test_threshold_operators(spark, op, value, status):
    p = para(spark, "预付款\t30%")
    rule = rules.Rule("R", "r", "d", "THRESHOLD", {"field": "prepay_ratio", "op": op, "value": value}, "LOW")
    assert rules.evaluate(p, [rule]).first().status == status
    assert rules.threshold_verdicts(metadata.wide_metadata(p), [rule]).first().status == status


@pytest.mark.parametrize(
    "kind,expression,targets,reason",
    [
        ("KEYWORD", {"keywords": []}, [], "INVALID_EXPRESSION"),
        ("KEYWORD", {"keywords": ["a", 1]}, [], "INVALID_EXPRESSION"),
        ("KEYWORD", {"keywords": ["a"], "logic": "ALL"}, [], "INVALID_EXPRESSION"),
        ("REGEX", {"pattern": "("}, [], "INVALID_EXPRESSION"),
        ("REGEX", {}, [], "INVALID_EXPRESSION"),
        ("THRESHOLD", {"field": "x", "op": "??", "value": 1}, [], "INVALID_EXPRESSION"),
        ("THRESHOLD", {"field": "x", "op": "gt", "value": True}, [], "INVALID_EXPRESSION"),
        ("EXISTS", {}, [], "UNSUPPORTED_RULE_TYPE"),
        ("EXISTS", {}, ["nope"], "INVALID_TARGET_CLAUSE_TYPE"),
        ("KEYWORD", {"keywords": ["a"]}, ["ip"], "INVALID_TARGET_CLAUSE_TYPE"),
        ("KEYWORD", {"keywords": ["a"]}, ["IP"], None),
    ],
)
def test_rule_validation(kind, expression, targets, reason):
    assert rules.Rule("R", "r", "d", kind, expression, "LOW", targets).failure() == reason


def test_regex_that_only_python_takes(spark):
    rule = rules.Rule("R", "r", "d", "REGEX", {"pattern": r"(?P<a>x)(?P=a)y"}, "LOW")
    got = rules.paragraph_risks(para(spark, "axxyb", "xy"), [rule]).collect()
    assert [(r.paragraph_index, r.quote) for r in got] == [(0, "xxy")]


def test_keyword_quote_is_leftmost(spark):
    rule = rules.Rule("R", "r", "d", "KEYWORD", {"keywords": ["乙乙", "甲", "乙", "甲"]}, "LOW")
    got = rules.paragraph_risks(para(spark, "x乙乙甲"), [rule]).first()
    assert got.quote == "乙乙" and got.reason == "命中规则关键词：「乙乙」、「乙」、「甲」"


GOOD = '{"clause_index": 0, "dimension": "保密", "risk_title": "t", "risk_level": "LOW", "reason": "r", "quote": "q"}'


@pytest.mark.parametrize(
    "raw,n",
    [
        ('{"findings": [%s]}' % GOOD, 1),
        ("```json\n{\"findings\": [%s, %s]}\n```" % (GOOD, GOOD), 2),
        ("```\n{}", 0),
        ("  {} \n", 0),
        ("[]", -1),
        ("", -1),
        (None, -1),
        ("3", -1),
        ("null", -1),
        ('{"findings": null}', -1),
        ('{"findings": {}}', -1),
        ('{"findings": [%s]}' % GOOD.replace("0,", '"0",'), -1),
        ('{"findings": [%s]}' % GOOD.replace("0,", "0.0,"), -1),
        ('{"findings": [%s]}' % GOOD.replace("0,", "-1,"), -1),
        ('{"findings": [%s]}' % GOOD.replace("保密", "其他"), -1),
        ('{"findings": [%s]}' % GOOD.replace('"q"', '""'), -1),
        ('{"findings": [%s]}' % GOOD.replace('"q"', '"q", "legal_basis": 3'), -1),
        ('{"findings": [%s]}' % GOOD.replace('"q"', '"q", "legal_basis": null, "extra": 1'), 1),
        ('{"findings": [%s]}' % GOOD.replace('"q"', '"q", "context_before": null'), -1),
        ('{"findings": [%s]}' % GOOD.replace('"q"', '"q", "suggestion": {"type": "ADD"}'), -1),
        ('{"findings": [%s, 1]}' % GOOD, -1),
    ],
)
def test_json_guard(spark, raw, n):
    got = findings.guard_json(spark.createDataFrame([(1, raw)], "doc_id long, raw_text string")).first()
    assert (len(got.findings) if got.findings is not None else -1) == n and (got.json_status == "VALID") == (n >= 0)


def locate(spark, p, clause, quote, before="", after=""):
    f = spark.createDataFrame([(1, 0, clause, quote, before, after)], "doc_id long, seq int, clause_index int, quote string, context_before string, context_after string")
    got = findings.locate(f, clauses.with_clauses(p)).collect()
    return [(r.paragraph_index, r.quote, r.anchor_method) for r in got]


def test_quote_locator(spark):
    p = para(spark, "第一条 甲", "aXbXc XX", "aXb", "第二条", "", " ")
    assert locate(spark, p, 0, "Xc") == [(1, "Xc", "CLAUSE_SCOPED")]
    assert locate(spark, p, 0, "XX") == [(1, "XX", "CLAUSE_SCOPED")]
    assert locate(spark, p, 0, "aXb") == [(0, "第一条 甲", "CLAUSE_FALLBACK")]
    assert locate(spark, p, 0, "X", "b", "c") == [(1, "X", "CLAUSE_SCOPED")]
    assert locate(spark, p, 0, "b", "X") == [(0, "第一条 甲", "CLAUSE_FALLBACK")]
    assert locate(spark, p, 0, "") == [(0, "第一条 甲", "CLAUSE_FALLBACK")]
    assert locate(spark, p, 1, "zzz") == [(3, "第二条", "CLAUSE_FALLBACK")]
    assert locate(spark, p, 9, "甲") == []
    over = para(spark, "第一条", "aaa")
    assert locate(spark, over, 0, "a", "a") == [(0, "第一条", "CLAUSE_FALLBACK")]  # overlaps count


def risk(seq, source, code=None, title="t", idx=1, dim="d", level="LOW", related=None, law=None):
    return (1, seq, source, code, title, dim, level, f"r{seq}", law, "o", f"q{seq}", idx, None, related)


RISKS = "doc_id long, seq long, source string, risk_code string, risk_title string, dimension string, risk_level string, reason string, legal_basis string, original_text string, quote string, paragraph_index int, anchor_method string, related_rule_code string"


def merged(spark, *rows):
    return [(r.seq, r.source, r.risk_code, r.risk_level, r.reason, r.legal_basis) for r in merge.merge_risks(spark.createDataFrame(list(rows), RISKS)).orderBy("seq").collect()]


def test_merge(spark):
    assert merged(spark, risk(0, "LLM", title="A b", related="R"), risk(1, "RULE", "R", level="HIGH", law="x")) == [(0, "RULE+LLM", "R", "HIGH", "r1", "x")]
    assert merged(spark, risk(0, "LLM", title="Straße"), risk(1, "LLM", title=" STRASSE", level="MEDIUM")) == [(0, "LLM", None, "MEDIUM", "r0", None)]
    assert len(merged(spark, risk(0, "RULE", "R"), risk(1, "LLM", title="a", related="R"), risk(2, "LLM", title="b", related="R"))) == 3
    assert len(merged(spark, risk(0, "RULE", "R"), risk(1, "RULE", "S"), risk(2, "LLM", title="a", related="R"), risk(3, "LLM", title="a", related="S"))) == 3
    assert merged(spark, risk(0, "RULE", "R", level="ODD"), risk(1, "RULE", "R", level="HIGH")) == [(0, "RULE", "R", "ODD", "r0", None)]
    assert len(merged(spark, risk(0, "RULE+LLM", "R"), risk(1, "RULE", "R"))) == 2


def test_merge_is_idempotent_and_ignores_partitions(spark):
    r = random.Random(1)
    rows = [risk(i, r.choice(["RULE", "LLM", "LLM"]), r.choice("RS"), r.choice(["a", "A ", "b"]), r.randrange(2), "d", r.choice(["HIGH", "LOW", "ODD"]), r.choice([None, "R", "S"])) for i in range(40)]
    # findings of one title claim one rule, else the first claim that is kept may be alone in the second pass
    rows = [x if x[2] == "RULE" else (*x[:3], None, *x[4:-1], {"a": "R", "A ": "R", "b": None}[x[4]]) for x in rows]
    df = spark.createDataFrame(rows, RISKS)
    once = merge.merge_risks(df.repartition(7, "quote"))
    first = sorted(map(repr, once.collect()))
    assert first == sorted(map(repr, merge.merge_risks(df.coalesce(1)).collect()))
    assert first == sorted(map(repr, merge.merge_risks(once).collect()))


def docx_bytes(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(docx_bytes(p("甲　 方") + "<w:p/><w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("30%") + "</w:tc></w:tr></w:tbl>" + p("end")))
    (tmp_path / "b.docx").write_bytes(docx_bytes("<w:p/>"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-")
    got = {r.path.rsplit("/", 1)[1]: r for r in docx.read_files(spark, str(tmp_path)).collect()}
    assert [(b.block_type, b.text) for b in got["a.docx"].paragraphs] == [("PARAGRAPH", "甲 方"), ("PARAGRAPH", ""), ("TABLE_ROW", "x\t30%"), ("PARAGRAPH", "end")]
    assert [got[k].status for k in ("a.docx", "b.docx", "c.docx", "d.pdf")] == ["PARSED", "EMPTY", "FAILED", "FAILED"]
    assert (got["c.docx"].error_code, got["d.pdf"].error_code) == ("PARSE_FAILED", "PARSE_UNSUPPORTED_TYPE")


def test_large_files_are_not_opened(spark, tmp_path):
    docs = spark.createDataFrame([("a.docx", [("PARAGRAPH", "x <&> y"), ("TABLE_ROW", "1\t\t2"), ("TABLE_ROW", "3"), ("PARAGRAPH", "")]), ("b.docx", [("PARAGRAPH", "".join(map(chr, range(0x4E00, 0x9000))))]), ("c.docx", [])], "name string, blocks array<struct<block_type:string,text:string>>")
    assert docx.write_files(docs, f"file://{tmp_path}/d") == 3
    got = docx.read_files(spark, f"file://{tmp_path}/d", most_bytes=5000)
    rows = {r.path.rsplit("/", 1)[1]: r for r in got.collect()}
    assert [(b.block_type, b.text) for b in rows["a.docx"].paragraphs] == [("PARAGRAPH", "x <&> y"), ("TABLE_ROW", "1\t\t2"), ("TABLE_ROW", "3"), ("PARAGRAPH", "")]
    assert (rows["b.docx"].status, rows["b.docx"].error_code, rows["c.docx"].status) == ("FAILED", "FILE_TOO_LARGE", "EMPTY")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5000)" in plan and "GreaterThan(length,5000)" in plan  # the scan leaves them out


def test_sweep(spark, tmp_path):
    objects = spark.createDataFrame([("a", NOON), ("b", NOON), ("c", datetime(2027, 1, 1))], "storage_key string, modified timestamp")
    refs = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "storage_key string")
    got = sweep.object_outcomes(objects, refs, F.lit(datetime(2026, 12, 1)))
    assert {tuple(r) for r in got.collect()} == {("a", "referenced"), ("b", "orphan"), ("c", "too_new"), ("z", "missing")}
    (tmp_path / "u" / "1").mkdir(parents=True)
    (tmp_path / "u" / "1" / "x.bin").write_bytes(b"123")
    listed = sweep.list_objects(spark, f"file://{tmp_path}/u")
    assert [(r.storage_key, r.length) for r in listed.collect()] == [("1/x.bin", 3)] and "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "contract_id long")
    contracts = spark.createDataFrame([(1, None), (2, 7), (3, None), (4, None), (5, None)], "contract_id long, current_task_id long")
    out = sweep.orphan_contracts(ids(1, 2, 3, 4, 9, 9, None), contracts, ids(3, 3), ids(4, 3, None))
    assert {tuple(r) for r in out.collect()} == {(1, "deleted"), (2, "skipped_task_link_present"), (3, "skipped_file_exists"), (4, "skipped_task_exists"), (9, "skipped_not_found"), (None, "skipped_not_found")}
    assert {r.contract_id for r in sweep.swept(contracts, out).collect()} == {2, 3, 4, 5}


def test_text_functions(spark):
    df = spark.createDataFrame([(" a　\x1cb \n c ", "aaa", "aa"), (None, None, None)], "t string, x string, y string")
    r = df.select(ft.normalised(F.col("t")).alias("n"), ft.occurrences(F.col("x"), F.col("y")).alias("k")).collect()
    assert r[0].n == "a b c" and r[0].k == 2 and r[1].n is None
    assert spark.range(1).select(render.percent_encoded(F.lit("a b~*é/")).alias("u")).first().u == "a%20b~%2A%C3%A9%2F"
    assert spark.range(1).select(render.report_file_name(F.lit('a/b:"c')).alias("u")).first().u == "a-b--c.md"


def test_whole_review_and_report(spark, golden):
    raw = spark.createDataFrame([(1, '{"findings": [{"clause_index": 4, "dimension": "知识产权", "risk_title": "归属", "risk_level": "MEDIUM", "reason": "r", "quote": "知识产权归乙方", "related_rule_code": "IP_OWNER_SUPPLIER_001"}]}')], "doc_id long, raw_text string")
    out = review(golden, rules.seed_rules(), raw)
    got = {r.risk_code: (r.source, r.paragraph_index) for r in out.risks.collect()}
    assert got == {"IP_OWNER_SUPPLIER_001": ("RULE+LLM", 23), "LIAB_UNLIMITED_001": ("RULE", 30)}
    docs = dossier.with_clause_ids(dossier.with_risks(out.dossiers, out.risks))
    heads = spark.createDataFrame([(1, "reviewing", "REVIEWED", NOON, "HT-1", "采购|合同", "PURCHASE", "甲", None, Decimal("1234.50"), "CNY", "2026-01-02", None, None, " ", "a.docx", "DOCX", "PARSED", "ab12", "PARAGRAPH"), (2, "pending", "ODD", NOON, "HT-2", "t", "SALES", None, None, None, "CNY", None, None, None, "法务", "b.docx", None, "EMPTY", "cd", "PARAGRAPH")], HEADS)
    reviews = spark.createDataFrame([(1, 1, "MODIFIED", "see\nclause", NOON)], "doc_id long, seq long, review_status string, review_comment string, reviewed_at timestamp")
    md = {r.doc_id: r.content_md for r in render.render_reports(heads, docs, reviews).collect()}
    assert "### 1. [HIGH] 知识产权归属相对方" in md[1] and "| 所属条款 | 第四条 知识产权 |" in md[1] and "本次审查共发现 2 项风险，其中 HIGH 2 项。" in md[1]
    assert "| 风险来源 | RULE+LLM |" in md[1] and "| 人工复核 | 已修改 |" in md[1] and "| 人工复核 | 待复核 |" in md[1]
    assert "- **人工风险等级**：HIGH\n- **复核意见**：see clause\n- **复核时间**：2026-03-04 12:30 (UTC)" in md[1]
    assert md[2] == EMPTY_REPORT


def many_rules(n):
    out = []
    for i in range(n):
        words = [f"词{i}", "甲方" if i % 5 == 0 else f"无{i}", "责任", "责"][: 1 + i % 4]
        out.append(rules.Rule(f"K{i}", f"n{i}", "d", "KEYWORD", {"keywords": words}, "LOW", ["LIABILITY"] if i % 3 == 0 else [], "law" if i % 2 else None))
    patterns = ["甲方|乙方", r"\d+%?", r"(?<=第)四", r"责\w", r"x*"]
    out += [rules.Rule(f"R{i}", "r", "d", "REGEX", {"pattern": p}, "HIGH", ["IP"] if i == 0 else []) for i, p in enumerate(patterns)]
    out += [rules.Rule(f"T{i}", "t", "d", "THRESHOLD", {"field": "prepay_ratio", "op": op, "value": 0.3}, "HIGH") for i, op in enumerate(("gt", "gte", "lt", "lte", "eq", "ne"))]
    return [*out, rules.Rule("BAD", "b", "d", "REGEX", {"pattern": "("}, "LOW")]


def test_a_scan_finds_what_expressions_find(spark, golden, monkeypatch):
    catalogue_rules = many_rules(40)
    seen = []
    for most in (0, 1000):
        monkeypatch.setattr(rules, "EXPRESSIONS", most)
        seen.append([sorted(map(repr, f(golden, catalogue_rules).collect())) for f in (rules.paragraph_risks, rules.rule_risks, rules.evaluate)])
    assert seen[0] == seen[1] and all(seen[0])
    odd = spark.createDataFrame([(1, 0, "PARAGRAPH", None), (1, 1, "PARAGRAPH", ""), (1, 2, "PARAGRAPH", "aab " * 50_000), (None, 0, "PARAGRAPH", "\U0001d4b3aab")], "doc_id long, idx int, block_type string, text string")
    some = [rules.Rule(f"K{i}", "n", "d", "KEYWORD", {"keywords": [w, "b "]}, "LOW") for i, w in enumerate(["aab", "ab", "aa", "\U0001d4b3a", "b a"])]
    for most in (0, 1000):
        monkeypatch.setattr(rules, "EXPRESSIONS", most)
        seen.append(sorted(map(repr, rules.paragraph_risks(odd, some).collect())))
    assert seen[2] == seen[3] and len(seen[2]) == 9
    lexicon = ["aab", "b", "aab", "ab"]
    for most in (0, 1000):
        monkeypatch.setattr(keywords, "EXPRESSIONS", most)
        seen.append(sorted(map(repr, keywords.keyword_hits(odd, lexicon).collect())))
    assert seen[4] == seen[5] and len(seen[4]) == 8


def test_plans_do_not_grow_with_the_catalogue(spark, golden):
    sizes = []
    for n in (30, 3000):
        catalogue_rules = many_rules(n)
        plans = [f(golden, catalogue_rules)._jdf.queryExecution().optimizedPlan().toString() for f in (rules.evaluate, rules.rule_risks)]
        sizes.append([len(re.sub(r"LocalRelation.*", "", p).splitlines()) for p in plans])
    assert sizes[0] == sizes[1]
    hit = {r.rule_code: r.n_risks for r in rules.evaluate(golden, many_rules(3000)).collect()}
    assert len(hit) == 3012 and sum(n > 0 for n in hit.values()) > 1000
    with pytest.raises(ValueError):
        terms.term_scan(spark, ["x" * (terms.MOST_CHARACTERS + 1)])


def test_bounds_beyond_all_doubles(spark):
    wide = metadata.wide_metadata(spark.createDataFrame([(1, 0, "PARAGRAPH", "合同总价为 1200 元")], "doc_id long, idx int, block_type string, text string"))
    values = [10**308, 10**309, -(10**400), 10**400, 1e308, math.inf, -math.inf]
    some = [rules.Rule(f"{op}{i}", "t", "d", "THRESHOLD", {"field": "contract_amount", "op": op, "value": v}, "LOW") for i, v in enumerate(values) for op in ("gt", "lte", "ne", "eq")]
    got = {r.rule_code: r.status for r in rules.threshold_verdicts(wide, some).collect()}
    by = {"gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "ne": lambda a, b: a != b, "eq": lambda a, b: a == b}
    assert got == {f"{op}{i}": "MATCHED" if by[op](1200, v) else "NOT_MATCHED" for i, v in enumerate(values) for op in by}


def test_a_risk_has_the_clause_that_its_id_names(spark, golden):
    """Null, own and foreign ids; clauses without number and title; the paragraph decides nothing once the risk is stored."""
    stored = dossier.with_clause_ids(dossier.dossiers(golden, rules.seed_rules()))
    one, two = stored.first().risks
    own = stored.first().clauses
    assert one.r.clause_id == next(c.clause_id for c in own if c.start_idx <= one.r.paragraph_index <= c.end_idx) == dossier.IDS_A_DOCUMENT + 4
    heads = spark.createDataFrame([(1, "reviewing", "REVIEWED", NOON, "HT-1", "t", "P", None, None, None, None, None, None, None, None, "a", "DOCX", "PARSED", "ab", "PARAGRAPH")], HEADS)
    none = spark.createDataFrame([], "doc_id long, seq long, review_status string, review_comment string, reviewed_at timestamp")
    tasks = spark.createDataFrame([(1,), (9,)], "doc_id long")
    for clause_id, text, foreign in [(None, "未关联具体条款", []), (77, "条款信息缺失（#77）", [77]), (own[-1].clause_id, f"{own[-1].clause_no} {own[-1].title}", []), (own[0].clause_id, f"条款 #{own[0].clause_id}", [])]:
        docs = stored.withColumn("risks", F.transform("risks", lambda x: x.withField("r", x["r"].withField("clause_id", F.lit(clause_id).cast("long")))))
        md = render.render_reports(heads, docs, none).first().content_md
        assert md.count(f"| 所属条款 | {text} |") == 2
        got = {r.doc_id: r for r in readmodels.workbench_rows(tasks, docs).collect()}
        assert got[1].foreign_clause_ids == foreign and got[1].risks.count(f'"clause_id":{clause_id}') == (2 if clause_id else 0)
        assert (got[9].risks, got[9].foreign_clause_ids) == ("[]", [])
    nowhere = stored.withColumn("risks", F.transform("risks", lambda x: x.withField("r", x["r"].withField("paragraph_index", F.lit(None).cast("int")))))
    assert {x.r.clause_id for x in dossier.with_clause_ids(nowhere).first().risks} == {None}


#: A report without findings, in full.
EMPTY_REPORT = """# 合同审查报告

> 合同编号：HT-2 ｜ 合同名称：t ｜ 审查任务：#2

## 一、合同基本信息

| 项目 | 内容 |
| --- | --- |
| 合同编号 | HT-2 |
| 合同名称 | t |
| 合同类型 | SALES |
| 我方主体 | — |
| 相对方 | — |
| 合同金额 | — |
| 签署日 | — |
| 生效日 | — |
| 到期日 | — |
| 送审部门 | 法务 |

## 二、审查任务信息

| 项目 | 内容 |
| --- | --- |
| 审查任务 | #2 |
| 任务状态 | pending |
| 审查阶段 | ODD（ODD） |
| 创建时间 | 2026-03-04 12:30 (UTC) |
| 被审查附件 | b.docx |
| 附件类型 | — |
| 解析状态 | EMPTY |
| 附件 SHA-256 | cd |

## 三、风险概览

本次审查未发现风险。

| 风险等级 | 数量 |
| --- | --- |
| HIGH | 0 |
| MEDIUM | 0 |
| LOW | 0 |
| 合计 | 0 |

## 四、风险明细

本次审查未发现风险。

## 五、条款附录

本次审查未切分出条款。

## 六、合同信息提取结果

本次审查未提取到合同信息。
"""
NOON = datetime(2026, 3, 4, 12, 30)
HEADS = "doc_id long, status string, stage string, created_at timestamp, contract_no string, title string, contract_type string, our_party string, counterparty string, amount decimal(18,2), currency string, sign_date string, effective_date string, expire_date string, dept string, file_name string, file_type string, parse_status string, sha256 string, locator_type string"


@pytest.mark.parametrize("name", ["workbench_flat", "report_markdown", "prompt_render", "metadata_all", "rule_risks"])
def test_the_corpus_is_derived_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize(
    "pattern,texts",
    [
        (r"[x&&y]+", ["a&x&y", "xy", "z"]),
        (r"[a[b]+", ["x[ab", "q"]),
        (r"a.c", ["a\rc", "a\u2028c", "a\nc", "abc"]),
        (r"end$", ["end\n", "end\r", "end", "end\n\n", "ending"]),
        (r"end\Z", ["end\n", "end"]),
        (r"\w+\s\w+", ["á\x1cb", "ab cd", "a\u3000b", "a\u0301 b"]),
        (r"[\s\w]{3}", ["a\x1fb", "--- "]),
        (r"\S+", ["\x1c\x1d x", "中文"]),
        (r"(?P<a_b>x)(?P=a_b)", ["xx", "x"]),
        (r"(?i)AbC", ["xabc", "x"]),
        (r"x{,2}y", ["xxxy", "y"]),
        (r"^\d{2,3}?[^\d,]|第.条", ["12345x", "12a", "第三条", "第\n条"]),
    ],
)
def test_patterns_mean_what_python_means(spark, pattern, texts):
    rule = rules.Rule("R", "r", "d", "REGEX", {"pattern": pattern}, "LOW")
    got = {r.paragraph_index: r.quote for r in rules.paragraph_risks(para(spark, *texts), [rule]).collect()}
    want = {i: m.group() for i, t in enumerate(texts) if (m := re.search(pattern, t)) and m.group()}
    assert got == want


@pytest.mark.parametrize("op,bound", [("gt", 1e25), ("lt", float("inf")), ("gte", float("-inf")), ("eq", 10**30), ("lt", 1e-30), ("gt", 0.3), ("ne", 0.1)])
def test_thresholds_of_any_size(spark, op, bound):
    by = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}[op]
    rule = rules.Rule("R", "r", "d", "THRESHOLD", {"field": "prepay_ratio", "op": op, "value": bound}, "LOW")
    assert rule.failure() is None
    values = ["0.3", "0.1", "1e26", str(10**30), "12345678901234567890123", "0.30000000000000000001", "NaN", "三成", None]
    wide = spark.createDataFrame([(i, (v, 1, "q")) for i, v in enumerate(values)], "doc_id long, prepay_ratio struct<value:string,idx:int,quote:string>")
    got = {r.doc_id: r.status for r in rules.threshold_verdicts(wide, [rule]).collect()}
    for i, v in enumerate(values):
        number = v is not None and v not in ("NaN", "三成")
        exact = number and by(Decimal(v), Decimal(str(bound)))
        assert got[i] == ("EVALUATION_FAILED" if not number else "MATCHED" if exact else "NOT_MATCHED") or v == "0.30000000000000000001"


def test_no_bound_ends_the_review(spark, golden):
    bad = [rules.Rule(f"R{i}", "r", "d", "THRESHOLD", {"field": "prepay_ratio", "op": "gt", "value": v}, "LOW") for i, v in enumerate([float("nan"), float("inf"), 1e25])]
    got = {r.rule_code: (r.status, r.failure_reason) for r in rules.evaluate(golden, bad).collect()}
    assert got["R0"] == ("EVALUATION_FAILED", "INVALID_EXPRESSION") and got["R1"][0] == got["R2"][0] != "MATCHED"


def test_guard_strips_as_python_does(spark):
    good = '{"findings": []}'
    texts = ["\u3000" + good + "\u00a0", "```json\r" + good + "\r```", "```\u2028" + good + "\u2028```\n", "\x1c```json\n" + good, "```" + good, "x" + good, "```json\r\n" + good + "\r\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    got = [r.json_status for r in findings.guard_json(df).orderBy("doc_id").collect()]
    assert got == ["VALID"] * 4 + ["LLM_SCHEMA_INVALID"] * 2 + ["VALID"]


def test_workbench_collections(spark, golden):
    tasks = spark.createDataFrame([(1, "REVIEWED"), (9, "PARSED")], "doc_id long, stage string")
    got = {r.doc_id: r for r in readmodels.workbench(tasks, blocks=golden.select("doc_id", "idx", "text"), clauses=clauses.segment_clauses(golden)).collect()}
    assert len(got[1].blocks) == 44 and [c.clause_index for c in got[1].clauses] == list(range(9)) and got[9].blocks is None


def test_one_shuffle_for_clauses_and_no_cross_join(spark, golden):
    plan = clauses.segment_clauses(golden)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = rules.evaluate(golden, rules.seed_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stream_reviews_each_content_once(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    bad = "第一条 违约责任\n甲方承担无限责任"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs((1, bad), (2, "第一条 保密\nx"), (3, bad)).write.parquet(src)

    def run():
        q = ingest.review_stream(ingest.read_documents(spark, src, spark.read.parquet(src).schema), rules.seed_rules(), out, str(tmp_path / "cp"), bounded=False)
        q.awaitTermination()
        return sorted((r.risk_code, r.paragraph_index) for r in spark.read.parquet(f"{out}/risks").collect())

    assert run() == [("LIAB_UNLIMITED_001", 1)]
    docs((4, bad), (5, bad + "全部损失")).write.mode("append").parquet(src)
    assert run() == [("LIAB_UNLIMITED_001", 1)] * 2


def test_keyword_lexicon(spark):
    got = keywords.keyword_hits(para(spark, "预付款\t30%", "知识产权与保密")).orderBy("idx", "ord").collect()
    assert [(r.idx, r.term) for r in got] == [(0, "预付款"), (0, "付款"), (1, "保密"), (1, "知识产权")]
    assert len(constants.LEXICON) == len(set(constants.LEXICON))


def test_broadcast_only_what_is_small(spark):
    from clausegrid.functions.joins import broadcast_if_small

    text = lambda most: spark.range(100).join(broadcast_if_small(spark.range(50), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text(50) and "strategy=broadcast" not in text(49)


def test_catalogue_comes_to_the_driver_checked(spark, monkeypatch):
    import json

    rows = [(r["rule_code"], r["rule_name"], r["dimension"], r["rule_type"], r["expression"], r["severity"], r["target_clause_types"], r["sort_order"]) for r in constants.SEED_RULES]
    df = spark.createDataFrame(rows, "rule_code string, rule_name string, dimension string, rule_type string, expression string, severity string, target_clause_types array<string>, sort_order int")
    assert rules.collect_rules(df) == rules.seed_rules()
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        rules.collect_rules(df)
    with pytest.raises(json.JSONDecodeError):
        rules.collect_rules(df.limit(1).withColumn("expression", F.lit("{")))


def test_the_last_of_repeated_keys_counts(spark):
    good = '{"clause_index": 4, "dimension": "违约责任", "risk_title": "t", "risk_level": "SEVERE", "reason": "r", "quote": "q", "risk_level": "LOW"}'
    bad = good.replace('"SEVERE"', '"HIGH"').replace('"LOW"', '"SEVERE"')
    texts = ['{"findings": [%s]}' % good, '{"findings": [%s]}' % bad, '{"findings": [1], "findings": [%s]}' % good, '{"findings": [%s], "findings": 1}' % good]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    got = {r.doc_id: (r.json_status, r.findings is not None and len(r.findings)) for r in findings.guard_json(raw).collect()}
    assert got == {0: ("VALID", 1), 1: ("LLM_SCHEMA_INVALID", False), 2: ("VALID", 1), 3: ("LLM_SCHEMA_INVALID", False)}
    assert findings.findings_rows(findings.guard_json(raw)).first().risk_level == "LOW"


def test_findings_without_a_place_are_counted(spark, golden):
    f = spark.createDataFrame([(1, i, c, "d", "t", "LOW", "r", None, q, "", "", None) for i, (c, q) in enumerate([(4, "知识产权归乙方"), (4, "nowhere"), (99, "x"), (4, "知识产权")])], "doc_id long, seq int, clause_index int, dimension string, risk_title string, risk_level string, reason string, legal_basis string, quote string, context_before string, context_after string, related_rule_code string")
    placed = clauses.with_clauses(golden)
    got = findings.resolve(f, placed)
    assert {(r.seq, r.anchor_method) for r in got.collect()} == {(0, "CLAUSE_SCOPED"), (1, "CLAUSE_FALLBACK"), (2, None), (3, "CLAUSE_FALLBACK")}
    assert findings.locate(f, placed).count() == 3
    metrics = catalogue.anchor_metrics(got)
    assert tuple(metrics.first()) == (4, 3, 1, 2)
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_task_is_read_from_its_bucket(spark, golden, monkeypatch):
    monkeypatch.setattr(tables_by_task, "ROWS_A_BUCKET", 4)
    many = golden.union(golden.withColumn("doc_id", F.lit(2).cast("long"))).union(golden.withColumn("doc_id", F.lit(30).cast("long")))
    docs = dossier.with_clause_ids(dossier.dossiers(many, rules.seed_rules()))
    assert tables_by_task.write(docs, "store_of_a_test") > 4
    read = tables_by_task.of_task(spark, "store_of_a_test", 30)
    assert {k: df.count() for k, df in read.items()} == {"clauses": 9, "risks": 2, "metadata": dossier.metadata_of(docs).where("doc_id = 30").count()}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say which buckets it takes
    try:
        plan = tables_by_task.of_task(spark, "store_of_a_test", 30)["risks"]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert re.search(r"SelectedBucketsCount: 1 out of [0-9]+", plan)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    both = tables_by_task.risks_with_clauses(spark, "store_of_a_test")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.seq, r.clause_no) for r in both.collect()} == {(d, s, n) for d in (1, 2, 30) for s, n in ((1, "第四条"), (2, "第六条"))}
    assert tables_by_task.write(docs.limit(0), "store_without_rows") == 1



# tables of any size -------------------------------------------------------------------------------


def test_contracts_are_dealt_before_they_are_paragraphs(spark, sf, monkeypatch):
    from clausegrid.sources import tables

    monkeypatch.setattr(tables, "CONTRACTS_A_TASK", 100)
    n = tables.table(spark, sf, "orders").count()
    placed = clauses.segment_clauses(tables.contract_paragraphs(spark, sf))
    assert placed.rdd.getNumPartitions() == 1 + n // 100  # not coalesced by the size of the rows that become paragraphs
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_merging_broadcasts_nothing(spark):
    row = lambda d, seq, source, code, title, related: (d, seq, source, code, title, "X", "LOW", None, None, None, None, 3, None, related)
    several = [
        row(d, *x)
        for d in range(30)
        for x in [(0, "RULE", "A", "r", None), (1, "RULE", "B", "r", None), (2, "LLM", None, "a b", "A"), (3, "LLM", None, "ab", "A"), (4, "LLM", None, "c", "B"), (5, "LLM", None, "d", "B"), (6, "LLM", None, "e", "GONE"), (7, "LLM", None, None, None)]
    ]
    out = merge.merge_risks(spark.createDataFrame(several, RISKS), 7)
    assert out.rdd.getNumPartitions() == 7
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.seq, r.source) for r in out.collect()) == [(d, n, s) for d in range(30) for n, s in [(0, "RULE+LLM"), (1, "RULE"), (4, "LLM"), (5, "LLM"), (6, "LLM"), (7, "LLM")]]


def test_a_catalogue_beyond_the_driver_finds_the_same(spark, sf, monkeypatch):
    from clausegrid.sources import tables

    p = tables.contract_paragraphs(spark, sf).where("doc_id < 300")
    words = [["甲方"], ["方", "甲方（采购方）", "甲方"], ["责任", "甲", "甲"], ["没有的词"], ["Supplier#00000000", "Supplier#000000001", "合同总价为"], ["预付款\t", "合同编号：HT-1"], []]
    rows = [(f"R{i}", f"n{i}", "d", "KEYWORD", '{"keywords": [%s]}' % ", ".join('"%s"' % w.replace("\t", "\\t") for w in some), "HIGH", targets, i) for i, some in enumerate(words) for targets in (None, ["DISPUTE", "OTHER"], ["bad"])]
    rows.append(("X", "x", "d", "REGEX", '{"pattern": "[0-9]{4}-"}', "LOW", None, 9))
    table = spark.createDataFrame(rows, "rule_code string, rule_name string, dimension string, rule_type string, expression string, severity string, target_clause_types array<string>, sort_order int")
    want = sorted(map(repr, rules.paragraph_risks(p, rules.collect_rules(table)).drop("rule_ord").collect()))
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    assert sorted(map(repr, rules.catalogue_risks(p, table).collect())) == want and want
    monkeypatch.setattr(rules, "MOST_ANCHORS", 0)
    assert sorted(map(repr, rules.catalogue_risks(p, table).collect())) == want


def test_documents_are_collected_in_the_order_of_the_windows(spark, sf):
    """One aggregation, on rows that lie sorted: nothing is hashed, nothing sorted again for a group."""
    from clausegrid.sources import tables

    text = dossier.dossiers(tables.contract_paragraphs(spark, sf), rules.seed_rules())._jdf.queryExecution().executedPlan().toString()
    after = text[: text.index("Window")]
    assert after.count("SortAggregate") == 1 and "ObjectHashAggregate" not in after and "Sort [" not in after


def test_dossiers_cut_the_same_clauses(spark):
    """A paragraph without text adds no line; the payment terms are a paragraph, or the run of rows around the first percentage."""
    rows = [(1, i, kind, text) for i, (kind, text) in enumerate([("PARAGRAPH", "第一条 付款"), ("PARAGRAPH", None), ("TABLE_ROW", "a"), ("TABLE_ROW", "30%"), ("TABLE_ROW", "b"), ("PARAGRAPH", "第二条 50%"), ("PARAGRAPH", "x")])]
    rows += [(2, 0, "TABLE_ROW", "10%"), (2, 1, "TABLE_ROW", "c"), (3, 0, "PARAGRAPH", "y"), (3, 1, "PARAGRAPH", "20%"), (3, 2, "TABLE_ROW", "z"), (4, 0, "PARAGRAPH", "none")]
    p = spark.createDataFrame(rows, "doc_id long, idx int, block_type string, text string")
    docs = dossier.dossiers(p)
    key = ["doc_id", "clause_index", "clause_no", "title", "clause_type", "start_idx", "end_idx", "text"]
    assert sorted(map(str, dossier.clauses_of(docs).select(*key).collect())) == sorted(map(str, clauses.segment_clauses(p).select(*key).collect()))
    got = {r.doc_id: r.payment_terms and (r.payment_terms.value, r.payment_terms.idx) for r in docs.collect()}
    assert got == {1: ("a\n30%\nb", 2), 2: ("10%\nc", 0), 3: ("20%", 1), 4: None}


def test_arrays_and_patterns_are_for_paragraphs_that_need_them(spark, golden):
    placed = clauses.with_clauses(golden)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    for ords in (False, True):
        found = placed.select("idx", rules._found(spark, rules.seed_rules(), ords).alias("f"))
        assert {r.idx for r in found.where("f IS NOT NULL").collect()} == {23, 30}
    # a test before a pattern is a condition, as both sides of an AND may be evaluated ahead
    plan = metadata.wide_metadata(golden)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "AND NOT (regexp_extract" not in plan


def test_many_files_go_in_few_archives(spark, sf, tmp_path, monkeypatch):
    got = QUERIES["docx_scan"](spark, sf)
    assert len(got.inputFiles()) < got.count() / 10  # else a file a customer is listed and opened
    monkeypatch.setattr(docx, "ARCHIVE_FILES", 2)
    texts = ["a", " b  c ", "x <&> y", "".join(map(chr, range(0x4E00, 0x9000)))]
    docs = spark.createDataFrame([(f"{i}.docx", [("PARAGRAPH", t), ("TABLE_ROW", "1\t\t2")]) for i, t in enumerate(texts)] + [("4.docx", []), ("5.pdf", [])], "name string, blocks array<struct<block_type:string,text:string>>").coalesce(1)
    paths = docx.write_archives(docs, f"file://{tmp_path}/d")
    assert len(paths) == 3
    (tmp_path / "d" / "left.zip").write_bytes(b"of an aborted attempt")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = {r.path.rsplit("/", 1)[1]: r for r in docx.read_archives(spark, [*paths, f"file://{tmp_path}/bad.zip"], most_bytes=5000).collect()}
    assert {k: (r.status, r.error_code) for k, r in rows.items()} == {"0.docx": ("PARSED", None), "1.docx": ("PARSED", None), "2.docx": ("PARSED", None), "3.docx": ("FAILED", "FILE_TOO_LARGE"), "4.docx": ("EMPTY", None), "5.pdf": ("FAILED", "PARSE_UNSUPPORTED_TYPE"), "bad.zip": ("FAILED", "PARSE_FAILED")}
    assert [[(b.idx, b.block_type, b.text) for b in rows[f"{i}.docx"].paragraphs] for i in range(3)] == [[(0, "PARAGRAPH", t), (1, "TABLE_ROW", "1\t\t2")] for t in ("a", "b c", "x <&> y")]
    assert docx.read_archives(spark, []).count() == 0


def test_dossiers_collect_only_what_paragraphs_have(spark, golden):
    """Fields of all paragraphs aren't aggregated one by one; the values that thresholds compare are put together once a document."""
    plan = dossier.dossiers(golden, rules.seed_rules())._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("map(prepay_ratio") == 1
    placed = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "heading" not in placed


def test_dossiers_have_the_metadata_of_odd_documents(spark):
    texts = [
        ["a\tb", "x\t5%", "甲方：  ", "甲方：A", "y\t7%", "z\tq"],
        ["总价 ,,, 元", "总价 12 元", "50 %", "1. 预付\t30%", "1. 预付\t999999999999999999999999999999999%"],
        ["1. 预付\t999999999999999999999999999999999%", "1. 预付\t30%", "港币 7", "到期日 2020-1-123", "签订日期：2020年1月2日"],
        ["乙方 B", "乙方：\x1c", "乙方：B\nC", "统一社会信用代码：91310115MA1K4ABC2", "自 2020-1-2 起生效", "EUR 5 元"],
        ["%\tonly", "第一条 付款 20%", "第二条"],
    ]
    rows = [(doc, 3 * i, "TABLE_ROW" if "\t" in t else "PARAGRAPH", t) for doc, some in enumerate(texts) for i, t in enumerate(some)]
    p = spark.createDataFrame([*rows, (9, 0, "PARAGRAPH", None), (9, 1, "TABLE_ROW", "1%"), (9, 2, "TABLE_ROW", None)], SCHEMA).repartition(3)
    key = ("doc_id", "ord", "field_key", "field_value", "idx", "quote")
    want = sorted(map(str, metadata.extract_metadata(p).select(*key).collect()))
    assert len(want) > 10 and sorted(map(str, dossier.metadata_of(dossier.dossiers(p)).select(*key).collect())) == want
