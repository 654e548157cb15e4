"""SQL that other engines can run for each query of ``queries``: a second statement of the same results."""

from __future__ import annotations

from .constants import BLOCK_REASONS, CLAUSE_TYPE_WORDS, CURRENCIES, ERRORS, FILE_TYPES, LEXICON, METADATA_FIELDS, MIME_FALLBACK, MOST_BYTES, TASK_MOVES
from .sources import fixtures as fx
from .sources.tables import CORPUS_SQL

CORPUS = f"WITH {CORPUS_SQL}"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _type_case(heading: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({heading}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in CLAUSE_TYPE_WORDS) + " ELSE 'OTHER' END"


#: Paragraphs with their clause, as ``pc``.
PLACED = f"""{CORPUS},
m1 AS (SELECT *, CASE WHEN block_type = 'PARAGRAPH' THEN regexp_extract(text, '^第\\s*[一二三四五六七八九十百零〇\\d]+\\s*条') ELSE '' END AS t1,
  CASE WHEN block_type = 'PARAGRAPH' THEN regexp_extract(text, '^[一二三四五六七八九十]+、') ELSE '' END AS t2,
  CASE WHEN block_type = 'PARAGRAPH' AND regexp_matches(text, '^\\d+[.、]($|\\D)') THEN regexp_extract(text, '^\\d+[.、]') ELSE '' END AS t3 FROM p),
m2 AS (SELECT *, sum(CASE WHEN t1 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n1, sum(CASE WHEN t2 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n2, sum(CASE WHEN t3 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n3 FROM m1),
m3 AS (SELECT *, CASE WHEN n1 >= 1 THEN nullif(t1, '') WHEN n2 >= 2 THEN nullif(t2, '') WHEN n3 >= 2 THEN nullif(t3, '') END AS no FROM m2),
m4 AS (SELECT *, count(no) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp, max(CASE WHEN idx = 0 AND no IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS f FROM m3),
pc AS (SELECT doc_id, idx, block_type, text, CAST(grp - f AS INTEGER) AS clause_index, max(no) OVER (PARTITION BY doc_id, grp) AS clause_no, max(CASE WHEN no IS NOT NULL THEN text END) OVER (PARTITION BY doc_id, grp) AS heading FROM m4),
cl AS (SELECT doc_id, clause_index, max(clause_no) AS clause_no, max(heading) AS heading, min(idx) AS start_idx, max(idx) AS end_idx, string_agg(text, chr(10) ORDER BY idx) AS text FROM pc GROUP BY doc_id, clause_index),
clt AS (SELECT *, CASE WHEN clause_no IS NULL THEN 'OTHER' ELSE {_type_case('heading')} END AS clause_type, nullif(trim(substr(heading, length(clause_no) + 1)), '') AS title FROM cl)"""


def _contains(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CURRENCY = "CASE " + " ".join(f"WHEN {_contains('text', tokens)} THEN '{code}'" for code, tokens in CURRENCIES) + " END"
_DATE = r"(\d{4})\s*[年\-/]\s*(\d{1,2})\s*[月\-/]\s*(\d{1,2})\s*日?"
_AMOUNT = r"[¥￥$€]\s*([\d,]+(?:\.\d+)?)|(?:人民币|美元|欧元|港元|港币)\s*([\d,]+(?:\.\d+)?)|([\d,]+(?:\.\d+)?)\s*(?:人民币|美元|欧元|港元|港币|元)"


def _first(name: str, hit: str, value: str, quote: str = "text") -> str:
    """The first paragraph with ``hit`` gives the field."""
    return f"{name} AS (SELECT doc_id, '{name}' AS field_key, {value} AS field_value, idx, {quote} AS quote FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS nth FROM p WHERE {hit}) x WHERE nth = 1)"


def _date(name: str, pattern: str) -> str:
    parts = " || '-' || ".join(f"lpad(regexp_extract(text, '{pattern}', {n}), {w}, '0')" for n, w in ((1, 4), (2, 2), (3, 2)))
    return _first(name, f"regexp_matches(text, '{pattern}')", parts, f"regexp_extract(text, '{pattern}')")


def _party(name: str, role: str) -> str:
    pattern = f"^{role}[^：:]{{0,12}}[：:]\\s*(.+?)\\s*$"
    return _first(name, f"block_type = 'PARAGRAPH' AND regexp_matches(text, '{pattern}')", f"regexp_extract(text, '{pattern}', 1)")


_RAW = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{_AMOUNT}', {n}), '')" for n in (1, 2, 3)) + ")"
_PERCENT = r"(\d+(?:\.\d+)?)\s*[%％]"
_PARTS = {
    "our_party_name": _party("our_party_name", "甲方"),
    "counterparty_name": _party("counterparty_name", "乙方"),
    "credit_code": _first("credit_code", "regexp_matches(text, '统一社会信用代码[：:]\\s*([0-9A-HJ-NPQRTUWXY]{18})')", "regexp_extract(text, '统一社会信用代码[：:]\\s*([0-9A-HJ-NPQRTUWXY]{18})', 1)", "regexp_extract(text, '统一社会信用代码[：:]\\s*([0-9A-HJ-NPQRTUWXY]{18})')"),
    "contract_amount": _first("contract_amount", f"{_RAW} IS NOT NULL", f"CAST(CAST(replace({_RAW}, ',', '') AS DECIMAL(38,2)) AS VARCHAR)", f"regexp_extract(text, '{_AMOUNT}')"),
    "currency": _first("currency", f"{_RAW} IS NOT NULL", _CURRENCY),
    "sign_date": _date("sign_date", r"(?:签订|签署|签约)日期[：:]?\s*" + _DATE),
    "effective_date": _date("effective_date", r"(?:生效日期[：:]?\s*|自\s*)" + _DATE + r"\s*起生效"),
    "expire_date": _date("expire_date", r"(?:有效期至|到期日[：:]?|终止日期[：:]?)\s*" + _DATE),
    # here percentages are whole tens, so a ratio has one digit after the point
    "prepay_ratio": _first("prepay_ratio", f"block_type = 'TABLE_ROW' AND contains(text, '预付') AND regexp_matches(text, '{_PERCENT}')", f"CAST(CAST(CAST(regexp_extract(text, '{_PERCENT}', 1) AS DECIMAL(10,1)) / 100 AS DECIMAL(10,1)) AS VARCHAR)"),
    # the table is one run of rows, and rows 8 to 10 are the only ones with a percentage
    "payment_terms": "payment_terms AS (SELECT doc_id, 'payment_terms' AS field_key, string_agg(text, chr(10) ORDER BY idx) AS field_value, min(idx) AS idx, string_agg(text, chr(10) ORDER BY idx) AS quote FROM p WHERE block_type = 'TABLE_ROW' GROUP BY doc_id)",
}


def _fields(*keys: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {k}" for k in keys)
    return f"{CORPUS}, {', '.join(_PARTS[k] for k in keys)} SELECT doc_id, field_key, field_value, idx, quote FROM ({union}) u"


_META = f"{', '.join(_PARTS[k] for k, _, _ in METADATA_FIELDS)}, meta AS (" + " UNION ALL ".join(f"SELECT doc_id, {n} AS ord, field_key, '{label}' AS field_label, field_value, '{kind}' AS value_type, idx, quote FROM {key}" for n, (key, label, kind) in enumerate(METADATA_FIELDS)) + ")"

_LEX = "SELECT CAST(ord AS INTEGER) AS ord, term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(LEXICON)) + ") v(ord, term)"


def _keyword(code: str, words: list[str], types: list[str] | None) -> str:
    """Hits of a keyword rule: leftmost word first, ties by the rule's order."""
    scope = "" if not types else "WHERE clause_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    listed = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""SELECT doc_id, '{code}' AS risk_code, idx AS paragraph_index, any_value(text) AS original_text, arg_min(w, pos * 1000 + i) AS quote,
      '命中规则关键词：' || string_agg('「' || w || '」', '、' ORDER BY pos, i) AS reason
      FROM (SELECT k.doc_id, k.idx, k.text, v.i, v.w, instr(k.text, v.w) AS pos FROM (SELECT pc.*, clt.clause_type FROM pc JOIN clt USING (doc_id, clause_index)) k, (VALUES {listed}) v(i, w) {scope}) x
      WHERE pos > 0 GROUP BY doc_id, idx"""


_IP = ["知识产权归供方", "知识产权归乙方", "知识产权归供应商", "所有权归乙方"]
_LIABILITY = ["全部损失", "无限责任", "不设上限", "承担一切责任", "赔偿全部"]
_KEYWORDS = " UNION ALL ".join([_keyword("IP_OWNER_SUPPLIER_001", _IP, ["IP"]), _keyword("LIAB_UNLIMITED_001", _LIABILITY, ["LIABILITY"])])
_ANYWHERE = _keyword("ANYWHERE", ["责任", "甲方", "合同"], None)


def _regex(code: str, pattern: str, types: list[str] | None = None) -> str:
    scope = "" if not types else "AND clause_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f"SELECT doc_id, '{code}' AS risk_code, idx AS paragraph_index, regexp_extract(text, '{pattern}') AS quote FROM (SELECT pc.*, clt.clause_type FROM pc JOIN clt USING (doc_id, clause_index)) k WHERE regexp_matches(text, '{pattern}') {scope}"


_REGEXES = [_regex("CODE_REGEX", r"代码：\w{10}"), _regex("DATE_IN_DISPUTE", r"\d{4}-\d{2}", ["DISPUTE"]), _regex("ZERO_WIDTH", r"^\d+")]


def _bound(code: str, key: str, op: str, value: str) -> str:
    number = "try_cast(f.field_value AS DECIMAL(38,10))"
    return f"SELECT a.doc_id, '{code}' AS rule_code, CASE WHEN {number} IS NULL THEN 'EVALUATION_FAILED' WHEN {number} {op} {value} THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status, f.idx AS paragraph_index FROM (SELECT DISTINCT doc_id FROM p) a LEFT JOIN (SELECT * FROM meta WHERE field_key = '{key}') f USING (doc_id)"


_BOUNDS = " UNION ALL ".join(
    [
        _bound("PAY_PREPAY_RATIO_001", "prepay_ratio", ">", "0.3"),
        _bound("PAY_RATIO_GTE", "prepay_ratio", ">=", "0.3"),
        _bound("AMOUNT_LT", "contract_amount", "<", "150000"),
        _bound("NOT_NUMERIC", "our_party_name", "=", "1"),
        _bound("NO_FIELD", "nothing", "=", "1"),
    ]
)
_BAD = {"ALL_LOGIC": "INVALID_EXPRESSION", "BAD_SCOPE": "INVALID_TARGET_CLAUSE_TYPE", "BAD_PATTERN": "INVALID_EXPRESSION", "EXISTS_RULE": "UNSUPPORTED_RULE_TYPE", "BOOL_VALUE": "INVALID_EXPRESSION"}
_BAD_ROWS = "(VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in _BAD.items()) + ") v(rule_code, failure_reason)"
_RISKS = f"""rr0 AS (SELECT 0 AS ord, 'HIGH' AS risk_level, k.* FROM ({_KEYWORDS}) k
  UNION ALL SELECT 2, 'MEDIUM', doc_id, 'PAY_PREPAY_RATIO_001', idx, quote, quote,
    '规则要求 prepay_ratio gt 0.3，实际值为 ' || field_value || '（取自「预付款比例」）' FROM meta WHERE field_key = 'prepay_ratio' AND CAST(field_value AS DECIMAL(10,2)) > 0.3),
rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE risk_code WHEN 'IP_OWNER_SUPPLIER_001' THEN 0 WHEN 'LIAB_UNLIMITED_001' THEN 1 ELSE 2 END, paragraph_index) AS seq FROM rr0)"""

_LOCATED = f"""{PLACED}, {_META}, fi AS ({fx.FINDINGS_SQL}),
lo1 AS (SELECT fi.*, pc.idx, pc.text, fi.context_before || fi.quote || fi.context_after AS ck FROM fi JOIN pc ON pc.doc_id = fi.doc_id AND pc.clause_index = fi.clause_index),
lo2 AS (SELECT *, CASE WHEN quote = '' THEN false WHEN context_before = '' AND context_after = '' THEN contains(text, quote) ELSE contains(text, ck) AND (length(text) - length(replace(text, ck, ''))) = length(ck) END AS hit FROM lo1),
lo3 AS (SELECT doc_id, seq, max(quote) AS q, max(risk_level) AS risk_level, max(related_rule_code) AS related, count(*) FILTER (WHERE hit) AS n, min(idx) FILTER (WHERE hit) AS hit_idx, arg_min(text, idx) FILTER (WHERE hit) AS hit_text, min(idx) FILTER (WHERE trim(text) <> '') AS fb, arg_min(text, idx) FILTER (WHERE trim(text) <> '') AS fb_text FROM lo2 GROUP BY doc_id, seq),
lo AS (SELECT doc_id, seq, risk_level, CASE WHEN n = 1 THEN hit_idx ELSE fb END AS paragraph_index, CASE WHEN n = 1 THEN hit_text ELSE fb_text END AS original_text, CASE WHEN n = 1 THEN q ELSE fb_text END AS quote, CASE WHEN n = 1 THEN 'CLAUSE_SCOPED' ELSE 'CLAUSE_FALLBACK' END AS anchor_method,
  CASE WHEN related IN ('IP_OWNER_SUPPLIER_001', 'LIAB_UNLIMITED_001', 'PAY_PREPAY_RATIO_001') THEN related END AS related_rule_code FROM lo3 WHERE CASE WHEN n = 1 THEN hit_idx ELSE fb END IS NOT NULL)"""

_RISK_FIELDS = ["source", "risk_code", "risk_title", "dimension", "risk_level", "reason", "legal_basis", "original_text", "quote", "paragraph_index", "anchor_method", "related_rule_code"]


def _merge(where: str) -> str:
    taken = lambda c: f"arg_min({c}, o) AS {c}"
    filled = lambda c: f"arg_min({c}, o) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    rank = "CASE risk_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"
    return f"""WITH r AS (SELECT * FROM ({fx.RISKS_SQL}) x WHERE {where}),
u0 AS (SELECT *, CASE source WHEN 'RULE' THEN 'R:' || risk_code || ':' || paragraph_index || ':' || dimension WHEN 'LLM' THEN 'L:' || lower(regexp_replace(risk_title, '\\s+', '', 'g')) || ':' || paragraph_index || ':' || dimension ELSE 'M:' || seq END AS own,
  CASE WHEN source = 'LLM' THEN 'R:' || related_rule_code || ':' || paragraph_index || ':' || dimension END AS claim FROM r),
cm AS (SELECT DISTINCT doc_id, own, claim FROM u0 l WHERE claim IS NOT NULL AND EXISTS (SELECT 1 FROM u0 q WHERE q.doc_id = l.doc_id AND q.source = 'RULE' AND q.own = l.claim)),
ok AS (SELECT doc_id, own, claim FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, own) AS a, count(*) OVER (PARTITION BY doc_id, claim) AS b FROM cm) y WHERE a = 1 AND b = 1),
un AS (SELECT u0.*, coalesce(ok.claim, u0.own) AS unit, CASE WHEN source = 'RULE' THEN 0 ELSE 100 END + seq AS o, {rank} AS rk FROM u0 LEFT JOIN ok ON ok.doc_id = u0.doc_id AND ok.own = u0.own)
SELECT doc_id, min(seq) AS seq, CASE WHEN count(*) FILTER (WHERE source = 'RULE') > 0 AND count(*) FILTER (WHERE source = 'LLM') > 0 THEN 'RULE+LLM' ELSE arg_min(source, o) END AS source,
  {filled('risk_code')}, {taken('risk_title')}, {taken('dimension')},
  CASE WHEN arg_min(coalesce(rk, 0), o) = 0 THEN arg_min(risk_level, o) ELSE CASE max(rk) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END END AS risk_level,
  {taken('reason')}, {filled('legal_basis')}, {taken('original_text')}, {taken('quote')}, {taken('paragraph_index')}, {filled('anchor_method')}, {filled('related_rule_code')}
FROM un GROUP BY doc_id, unit"""


_EXT = r"regexp_extract(coalesce(file_name, ''), '[^/.][^/]*?(\.[^./\s]+)$', 1)"
_FILE_SPECS = "(VALUES " + ", ".join(f"('{c}', '{e}', '{','.join(m)}', '{','.join(h)}')" for c, e, m, h in FILE_TYPES) + ") s(code, ext, mimes, heads)"
_MIMES = "(VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in {m: c for c, _, ms, _ in FILE_TYPES for m in ms}.items()) + ") t(mime, of_code)"
_OVERVIEW = "SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_level = 'LOW') AS low, count(*) FILTER (WHERE risk_level NOT IN ('HIGH', 'MEDIUM', 'LOW')) AS other FROM ({sql}) x GROUP BY doc_id"


def _sentence() -> str:
    part = lambda name, c: f"CASE WHEN {c} > 0 THEN '{name} ' || {c} || ' 项' END"
    return f"CASE WHEN total = 0 THEN '本次审查未发现风险。' ELSE '本次审查共发现 ' || total || ' 项风险，其中 ' || concat_ws('、', {part('HIGH', 'high')}, {part('MEDIUM', 'medium')}, {part('LOW', 'low')}, {part('其他等级', 'other')}) || '。' END"


_TITLES = "CASE risk_code WHEN 'IP_OWNER_SUPPLIER_001' THEN '知识产权归属相对方' WHEN 'LIAB_UNLIMITED_001' THEN '我方单方承担无限责任' ELSE '预付款比例超过 30%' END"
_DIMS = "CASE risk_code WHEN 'IP_OWNER_SUPPLIER_001' THEN '知识产权' WHEN 'LIAB_UNLIMITED_001' THEN '违约责任' ELSE '金额支付' END"
_HEADING = "coalesce(nullif(concat_ws(' ', nullif(clause_no, ''), nullif(title, '')), ''), '条款 #' || clause_id)"
#: Stored clauses and risks: a risk names its clause by id, in some documents none, in some one of another document; the clause is found by that id alone.
_STORED = """sc AS (SELECT *, doc_id * 1048576 + clause_index AS clause_id FROM clt),
sr AS (SELECT rr.*, CASE WHEN rr.doc_id % 5 = 0 AND rr.seq = 1 THEN NULL WHEN rr.doc_id % 7 = 3 AND rr.seq < 3 THEN (rr.doc_id + 1) * 1048576 ELSE own.clause_id END AS named
  FROM rr LEFT JOIN sc own ON own.doc_id = rr.doc_id AND rr.paragraph_index BETWEEN own.start_idx AND own.end_idx)"""
_LABEL = f"CASE WHEN named IS NULL THEN '未关联具体条款' WHEN clause_id IS NULL THEN '条款信息缺失（#' || named || '）' ELSE {_HEADING} END"


def _cell(x: str) -> str:
    flat = f"replace(replace(replace(trim(CAST({x} AS VARCHAR)), '|', chr(92) || '|'), chr(13), ' '), chr(10), ' ')"
    return f"coalesce(nullif({flat}, ''), '—')"


def _rows(*rows: tuple[str, str]) -> str:
    return "'| 项目 | 内容 |' || chr(10) || '| --- | --- |'" + "".join(f" || chr(10) || '| {name} | ' || {value} || ' |'" for name, value in rows)


_AMOUNT_TEXT = "coalesce(nullif(concat_ws(' ', CAST(amount AS VARCHAR), CASE WHEN amount IS NOT NULL THEN nullif(currency, '') END), ''), '—')"
_STAGE = "CASE stage WHEN 'UPLOADED' THEN '已上传' WHEN 'PARSED' THEN '已解析' WHEN 'CLAUSED' THEN '已切分条款' WHEN 'REVIEWED' THEN '审查完成' ELSE stage END"
_REVIEWED = "CASE coalesce(review_status, 'PENDING') WHEN 'PENDING' THEN '待复核' WHEN 'CONFIRMED' THEN '已确认' WHEN 'REJECTED' THEN '已驳回' WHEN 'MODIFIED' THEN '已修改' ELSE review_status END"
_RISK_ROWS = _rows(("风险编码", "risk_code"), ("审查维度", _DIMS), ("风险来源", "'RULE'"), ("所属条款", _LABEL), ("定位方式", "'PARAGRAPH'"), ("原文段落", "'第 ' || paragraph_index || ' 段'"), ("人工复核", _REVIEWED))
_REPORT = f"""{PLACED}, {_META}, {_RISKS}, {_STORED}, rv AS ({fx.REVIEWS_SQL}), hd AS ({fx.REPORT_HEADS_SQL}),
rk AS (SELECT rr.doc_id, rr.seq, risk_level, '### ' || row_number() OVER (PARTITION BY rr.doc_id ORDER BY rr.seq) || '. [' || risk_level || '] ' || {_TITLES} || chr(10) || chr(10) || {_RISK_ROWS} || chr(10) || chr(10) ||
  concat_ws(chr(10), '- **风险原因**：' || reason, '- **命中原文**：' || replace(quote, chr(9), ' '), CASE WHEN review_status = 'MODIFIED' THEN '- **人工风险等级**：' || risk_level END,
    '- **复核意见**：' || nullif(regexp_replace(review_comment, '\\s+', ' ', 'g'), ''), '- **复核时间**：' || strftime(reviewed_at, '%Y-%m-%d %H:%M') || ' (UTC)') AS block
  FROM sr rr LEFT JOIN sc ON sc.doc_id = rr.doc_id AND sc.clause_id = rr.named LEFT JOIN rv ON rv.doc_id = rr.doc_id AND rv.seq = rr.seq),
ra AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium, string_agg(block, chr(10) || chr(10) ORDER BY seq) AS blocks FROM rk GROUP BY doc_id),
ca AS (SELECT doc_id, string_agg('### ' || (clause_index + 1) || '. ' || {_HEADING} || '（' || clause_type || '）' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY clause_index) AS blocks FROM sc GROUP BY doc_id),
ma AS (SELECT doc_id, string_agg('| ' || field_label || ' | ' || replace(field_value, chr(10), ' ') || ' | ' || value_type || ' | REGEX |', chr(10) ORDER BY ord) AS lines FROM meta GROUP BY doc_id),
al AS (SELECT hd.*, coalesce(ra.total, 0) AS total, coalesce(ra.high, 0) AS high, coalesce(ra.medium, 0) AS medium, 0 AS low, 0 AS other, ra.blocks AS risk_blocks, ca.blocks AS clause_blocks, ma.lines FROM hd LEFT JOIN ra ON ra.doc_id = hd.doc_id LEFT JOIN ca ON ca.doc_id = hd.doc_id LEFT JOIN ma ON ma.doc_id = hd.doc_id),
report AS (SELECT doc_id, '# 合同审查报告' || chr(10) || chr(10) || '> 合同编号：' || {_cell('contract_no')} || ' ｜ 合同名称：' || {_cell('title')} || ' ｜ 审查任务：#' || doc_id || chr(10) || chr(10) ||
  '## 一、合同基本信息' || chr(10) || chr(10) || {_rows(("合同编号", _cell("contract_no")), ("合同名称", _cell("title")), ("合同类型", _cell("contract_type")), ("我方主体", _cell("our_party")), ("相对方", _cell("counterparty")), ("合同金额", _AMOUNT_TEXT), ("签署日", _cell("sign_date")), ("生效日", _cell("effective_date")), ("到期日", _cell("expire_date")), ("送审部门", _cell("dept")))} || chr(10) || chr(10) ||
  '## 二、审查任务信息' || chr(10) || chr(10) || {_rows(("审查任务", "'#' || doc_id"), ("任务状态", _cell("status")), ("审查阶段", f"{_STAGE} || '（' || {_cell('stage')} || '）'"), ("创建时间", "strftime(created_at, '%Y-%m-%d %H:%M') || ' (UTC)'"), ("被审查附件", _cell("file_name")), ("附件类型", _cell("file_type")), ("解析状态", _cell("parse_status")), ("附件 SHA-256", _cell("sha256")))} || chr(10) || chr(10) ||
  '## 三、风险概览' || chr(10) || chr(10) || {_sentence()} || chr(10) || chr(10) || '| 风险等级 | 数量 |' || chr(10) || '| --- | --- |' || chr(10) || '| HIGH | ' || high || ' |' || chr(10) || '| MEDIUM | ' || medium || ' |' || chr(10) || '| LOW | ' || low || ' |' || chr(10) || '| 合计 | ' || total || ' |' || chr(10) || chr(10) ||
  '## 四、风险明细' || chr(10) || chr(10) || coalesce(risk_blocks, '本次审查未发现风险。') || chr(10) || chr(10) || '## 五、条款附录' || chr(10) || chr(10) || clause_blocks || chr(10) || chr(10) ||
  '## 六、合同信息提取结果' || chr(10) || chr(10) || '| 字段 | 值 | 类型 | 提取方式 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || lines || chr(10) AS content_md FROM al)"""

#: A task's parts as JSON; what a risk names that isn't among its task's clauses is listed.
_NESTED = f"""{PLACED}, {_META}, {_RISKS}, {_STORED},
jc AS (SELECT doc_id, '[' || string_agg('{{"clause_id":' || clause_id || coalesce(',"clause_no":' || to_json(clause_no), '') || coalesce(',"title":' || to_json(title), '') || ',"clause_type":"' || clause_type || '","start":' || start_idx || ',"end":' || end_idx || '}}', ',' ORDER BY clause_index) || ']' AS clauses FROM sc GROUP BY doc_id),
jr AS (SELECT doc_id, '[' || string_agg('{{"seq":' || seq || ',"risk_code":"' || risk_code || '","risk_level":"' || risk_level || '"' || coalesce(',"clause_id":' || named, '') || ',"paragraph_index":' || paragraph_index || ',"quote":' || to_json(quote) || '}}', ',' ORDER BY seq) || ']' AS risks FROM sr GROUP BY doc_id),
jf AS (SELECT doc_id, string_agg(CAST(named AS VARCHAR), ',' ORDER BY named) AS ids FROM (SELECT DISTINCT doc_id, named FROM sr WHERE named NOT IN (SELECT clause_id FROM sc WHERE sc.doc_id = sr.doc_id)) x GROUP BY doc_id),
jm AS (SELECT doc_id, '[' || string_agg('{{"field_key":"' || field_key || '","field_value":' || to_json(field_value) || ',"idx":' || idx || '}}', ',' ORDER BY ord) || ']' AS metadata FROM meta GROUP BY doc_id)"""
_WRITEBACK = f"""WITH t AS ({fx.WRITEBACK_TASKS_SQL}), r AS ({fx.WRITEBACK_RISKS_SQL}),
k AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS high, 0 AS medium, 0 AS low, count(*) FILTER (WHERE risk_level = 'ODD') AS other, string_agg('#### ' || nth || '. [' || risk_level || '] ' || risk_title || chr(10) || chr(10) || '| 项目 | 内容 |' || chr(10) || '| --- | --- |' || chr(10) || '| 风险编码 | ' || coalesce(risk_code, '—') || ' |' || chr(10) || '| 审查维度 | D |' || chr(10) || '| 风险来源 | RULE |' || chr(10) || '| 原文段落 | ' || coalesce('第 ' || paragraph_index || ' 段', '—') || ' |' || chr(10) || '| 人工复核 | ' || CASE review_status WHEN 'MODIFIED' THEN '已修改' ELSE '待复核' END || ' |' || chr(10) || chr(10) ||
  concat_ws(chr(10), '- **风险原因**：why not', '- **法律依据**：' || legal_basis, '- **命中原文**：' || quote, CASE WHEN review_status = 'MODIFIED' THEN '- **人工风险等级**：' || risk_level END, '- **复核意见**：' || review_comment), chr(10) || chr(10) ORDER BY seq) AS blocks
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS nth FROM r) x GROUP BY doc_id),
j AS (SELECT t.*, coalesce(total, 0) AS total, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(other, 0) AS other, blocks FROM t LEFT JOIN k ON k.doc_id = t.doc_id)
SELECT doc_id, '## 合同审查意见' || chr(10) || chr(10) || '> 合同编号：' || coalesce(nullif(contract_no, ''), '—') || ' ｜ 合同名称：' || replace(title, '|', chr(92) || '|') || ' ｜ 审查任务：#' || doc_id || chr(10) || chr(10) || '### 一、合同信息' || chr(10) || chr(10) || '| 项目 | 内容 |' || chr(10) || '| --- | --- |' || chr(10) || '| 合同编号 | ' || coalesce(nullif(contract_no, ''), '—') || ' |' || chr(10) || '| 合同名称 | ' || replace(title, '|', chr(92) || '|') || ' |' || chr(10) || chr(10) ||
  '### 二、审查任务' || chr(10) || chr(10) || '| 项目 | 内容 |' || chr(10) || '| --- | --- |' || chr(10) || '| 审查任务 | #' || doc_id || ' |' || chr(10) || '| 审查阶段 | ' || CASE stage WHEN 'REVIEWED' THEN '审查完成' ELSE stage END || '（' || stage || '） |' || chr(10) || '| 创建时间 | ' || strftime(created_at, '%Y-%m-%d %H:%M') || ' (UTC) |' || chr(10) || chr(10) || '### 三、风险清单' || chr(10) || chr(10) || {_sentence()} || coalesce(chr(10) || chr(10) || blocks, '') || chr(10) AS content_md FROM j"""
_TASKS = f"SELECT * FROM ({fx.TASKS_SQL}) t"
_LINES = "SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents"

def _persist_call(n: int, which: str, before: int | None) -> str:
    """One call: each request after the other by task_id; a file's blocks are told apart by their number here."""
    stored = f"(SELECT file_id, max(n) AS n FROM v{before} WHERE creates GROUP BY file_id)" if before else "(SELECT 0 AS file_id, 0 AS n WHERE false)"
    said = f"(SELECT file_id, CASE WHEN max(CASE WHEN parse_status = 'PARSED' THEN 1 ELSE 0 END) = 1 THEN 'PARSED' ELSE 'FAILED' END AS s FROM v{before} WHERE verdict = 'OK' GROUP BY file_id)" if before else "(SELECT 0 AS file_id, '' AS s WHERE false)"
    done = f"(SELECT task_id FROM v{before} WHERE verdict = 'OK')" if before else "(SELECT 0 AS task_id WHERE false)"
    return f"""q{n} AS (SELECT r.task_id, r.parse_status, t.file_id, CASE WHEN d.task_id IS NOT NULL THEN 'CLAUSED' ELSE t.stage END AS stage, coalesce(a.s, f.parse_status) AS was, b.n AS stored,
  CASE WHEN r.parse_status = 'FAILED' THEN 0 WHEN r.task_id % 10 = 6 THEN 17 ELSE 18 END AS n,
  CASE WHEN t.task_id IS NULL THEN 'TASK_NOT_FOUND' WHEN f.file_id IS NULL THEN 'FILE_NOT_FOUND' WHEN d.task_id IS NOT NULL OR t.stage IN ('CLAUSED', 'REVIEWED') THEN 'DOCUMENT_ALREADY_PERSISTED' END AS gate
  FROM (SELECT * FROM ({fx.PERSIST_REQUESTS_SQL}) x WHERE {which}) r LEFT JOIN ({fx.PERSIST_TASKS_SQL}) t ON t.task_id = r.task_id LEFT JOIN ({fx.PERSIST_FILES_SQL}) f ON f.file_id = t.file_id
  LEFT JOIN {stored} b ON b.file_id = t.file_id LEFT JOIN {said} a ON a.file_id = t.file_id LEFT JOIN {done} d ON d.task_id = r.task_id),
w{n} AS (SELECT *, min(CASE WHEN gate IS NULL AND n > 0 AND stored IS NULL THEN task_id END) OVER (PARTITION BY file_id) AS maker FROM q{n}),
x{n} AS (SELECT *, coalesce(stored, CASE WHEN task_id >= maker THEN max(CASE WHEN task_id = maker THEN n END) OVER (PARTITION BY file_id) END, 0) AS must FROM w{n}),
y{n} AS (SELECT *, min(CASE WHEN gate IS NULL AND n = must AND parse_status = 'PARSED' THEN task_id END) OVER (PARTITION BY file_id) AS parsed FROM x{n}),
v{n} AS (SELECT *, verdict = 'OK' AND coalesce(task_id = maker, false) AS creates FROM (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN parse_status = 'FAILED' AND (was = 'PARSED' OR coalesce(parsed < task_id, false)) THEN 'PARSE_STATUS_ALREADY_FINAL' WHEN n <> must THEN 'DOCUMENT_BLOCKS_CONFLICT' ELSE 'OK' END AS verdict FROM y{n}) z)"""


def _folded(log: str, step: str, begin: str) -> str:
    """Each key's events one after the other; what is carried is 'state,attempts,refused'."""
    return f"SELECT key, list_reduce(list_prepend('{begin},0,0', list(event ORDER BY seq, event)), lambda c, e: {step}) AS c FROM ({log}) x GROUP BY key"


_CARRIED = "split_part(c, ',', 1)", "split_part(c, ',', 2)", "split_part(c, ',', 3)"
_REFUSED = f"{_CARRIED[0]} || ',' || {_CARRIED[1]} || ',' || (CAST({_CARRIED[2]} AS BIGINT) + 1)"
_WRITING = f"""CASE WHEN e = 'start' AND {_CARRIED[0]} IN ('none', 'not_written', 'failed') THEN 'writing,' || (CAST({_CARRIED[1]} AS BIGINT) + 1) || ',' || {_CARRIED[2]} WHEN e = 'start' AND {_CARRIED[0]} = 'writing' THEN c
  WHEN e IN ('ok', 'error') AND {_CARRIED[0]} = 'writing' THEN CASE e WHEN 'ok' THEN 'success' ELSE 'failed' END || ',' || {_CARRIED[1]} || ',' || {_CARRIED[2]} ELSE {_REFUSED} END"""
_MOVING = f"CASE WHEN {_CARRIED[0]} || '>' || e IN ({', '.join(repr(f'{a}>{b}') for a, b in TASK_MOVES)}) THEN e || ',' || {_CARRIED[1]} || ',' || {_CARRIED[2]} ELSE {_REFUSED} END"


def _persisted(n: int) -> str:
    ok = lambda x: f"CAST(CASE WHEN verdict = 'OK' THEN {x} ELSE 0 END AS BIGINT)"
    rows = lambda t: f"CASE WHEN parse_status = 'PARSED' THEN (SELECT count(*) FROM {t} WHERE {t}.doc_id = task_id) ELSE 0 END"
    return f"SELECT task_id, verdict, {ok('CASE WHEN creates THEN n ELSE 0 END')} AS blocks_created, {ok('CASE WHEN creates THEN 0 ELSE n END')} AS blocks_reused, {ok(rows('clt'))} AS clauses_persisted, {ok(rows('meta'))} AS metadata_persisted, CASE WHEN verdict = 'OK' THEN 'CLAUSED' ELSE stage END AS current_stage, {n} AS call FROM v{n}"


ORACLE_SQL: dict[str, str] = {
    "paragraph_scan": f"SELECT doc_id, idx, 'PARAGRAPH' AS block_type, text FROM ({_LINES}) l",
    "paragraph_normalize": f"SELECT doc_id, idx, 'PARAGRAPH' AS block_type, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS text FROM ({_LINES}) l",
    "html_paragraphs": rf"""SELECT doc_id, idx, 'PARAGRAPH' AS block_type, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '{_SPACE}', ' ', 'g')) AS text FROM (
  SELECT page_id AS doc_id, CAST(unnest(range(len(regexp_extract_all(html, '(?is)<(?:h1|p|li)\b[^>]*>(.*?)</(?:h1|p|li)>', 1)))) AS INTEGER) AS idx, unnest(regexp_extract_all(html, '(?is)<(?:h1|p|li)\b[^>]*>(.*?)</(?:h1|p|li)>', 1)) AS raw FROM pages) x""",
    "block_offsets": f"SELECT doc_id, idx, CAST(e - length(text) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS e FROM ({_LINES}) l) x",
    "parse_status": f"SELECT doc_id, CASE WHEN max(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) = 1 THEN 'PARSED' ELSE 'EMPTY' END AS status, count(*) AS n_paragraphs FROM ({_LINES}) l GROUP BY doc_id",
    "numbering_mode": f"{PLACED} SELECT doc_id, CAST(max(n1) AS BIGINT) AS n_tiao, CAST(max(n2) AS BIGINT) AS n_cn_num, CAST(max(n3) AS BIGINT) AS n_arab, CASE WHEN max(n1) >= 1 THEN 'TIAO' WHEN max(n2) >= 2 THEN 'CN_NUM' WHEN max(n3) >= 2 THEN 'ARAB' END AS mode FROM m2 GROUP BY doc_id",
    "clause_segments": f"{PLACED} SELECT doc_id, clause_index, start_idx, end_idx, text FROM clt",
    "clause_types": f"{PLACED} SELECT doc_id, clause_index, clause_type, 'RULE' AS extract_method FROM clt",
    "clause_titles": f"{PLACED} SELECT doc_id, clause_index, clause_no, title FROM clt",
    "keyword_hits": f"{CORPUS}, lx AS ({_LEX}) SELECT doc_id, idx, ord, term FROM p JOIN lx ON contains(p.text, lx.term)",
    "keyword_distinct_terms": f"{CORPUS}, lx AS ({_LEX}) SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_hits FROM p JOIN lx ON contains(p.text, lx.term) GROUP BY doc_id",
    "meta_parties": _fields("our_party_name", "counterparty_name"),
    "meta_credit_code": _fields("credit_code"),
    "meta_amount_currency": _fields("contract_amount", "currency"),
    "meta_dates": _fields("sign_date", "effective_date", "expire_date"),
    "meta_payment_terms": f"{CORPUS}, {_PARTS['payment_terms']} SELECT doc_id, field_value AS value, idx FROM payment_terms",
    "meta_prepay_ratio": _fields("prepay_ratio"),
    "metadata_all": f"{CORPUS}, {_META} SELECT doc_id, ord, field_key, field_label, field_value, value_type, idx FROM meta",
    "rule_effective_set": f"""WITH s AS ({fx.RULE_SETS_SQL}), r AS ({fx.SET_RULES_SQL}), e AS (SELECT contract_type, max(set_id) AS set_id FROM s WHERE is_active GROUP BY contract_type)
SELECT e.set_id, e.contract_type, s.version, a.rule_id, a.rule_code, a.sort_order, CAST(row_number() OVER (PARTITION BY e.contract_type ORDER BY a.sort_order, a.rule_id) AS INTEGER) AS nth
FROM e JOIN s ON s.set_id = e.set_id LEFT JOIN (SELECT * FROM r WHERE is_active) a ON a.set_id = e.set_id""",
    "rule_scope_invalid": f"{CORPUS} SELECT d.doc_id, v.rule_code, 'EVALUATION_FAILED' AS status, v.failure_reason FROM (SELECT DISTINCT doc_id FROM p) d, {_BAD_ROWS}",
    "rule_keyword": f"{PLACED} SELECT doc_id, risk_code, paragraph_index, quote, reason FROM ({_KEYWORDS} UNION ALL {_ANYWHERE}) x",
    "rule_regex": f"{PLACED} " + " UNION ALL ".join(_REGEXES),
    "rule_threshold": f"{CORPUS}, {_META} {_BOUNDS}",
    "rule_evaluations_tristate": f"""{PLACED}, {_META}, d AS (SELECT DISTINCT doc_id FROM p), hits AS (SELECT doc_id, risk_code AS rule_code, count(*) AS n FROM (SELECT doc_id, risk_code FROM ({_KEYWORDS} UNION ALL {_ANYWHERE}) k UNION ALL SELECT doc_id, risk_code FROM ({" UNION ALL ".join(_REGEXES)}) g) x GROUP BY doc_id, risk_code)
SELECT d.doc_id, c.rule_code, CASE WHEN h.n > 0 THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status, CAST(NULL AS VARCHAR) AS failure_reason, coalesce(h.n, 0) AS n_risks
FROM d CROSS JOIN (VALUES ('IP_OWNER_SUPPLIER_001'), ('LIAB_UNLIMITED_001'), ('CODE_REGEX'), ('DATE_IN_DISPUTE'), ('ZERO_WIDTH'), ('ANYWHERE')) c(rule_code) LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.rule_code = c.rule_code
UNION ALL SELECT doc_id, rule_code, status, CASE WHEN status = 'EVALUATION_FAILED' THEN 'MISSING_INPUT' END, CASE WHEN status = 'MATCHED' THEN 1 ELSE 0 END FROM ({_BOUNDS}) b
UNION ALL SELECT d.doc_id, v.rule_code, 'EVALUATION_FAILED', v.failure_reason, 0 FROM d, {_BAD_ROWS}""",
    "rule_risks": f"{PLACED}, {_META}, {_RISKS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, risk_code, risk_level, paragraph_index, original_text, quote FROM rr",
    # the raw outputs are made by doc_id % 13, so their verdicts follow from it
    "finding_json_guard": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 IN (0, 2, 3, 4, 6, 7, 8) THEN 'LLM_SCHEMA_INVALID' ELSE 'VALID' END AS json_status, CAST(CASE WHEN o_orderkey % 13 IN (0, 2, 3, 4, 6, 7, 8) THEN -1 WHEN o_orderkey % 13 IN (5, 9) THEN 0 WHEN o_orderkey % 13 IN (1, 10) THEN 1 ELSE 2 END AS INTEGER) AS n_findings FROM orders",
    "finding_rows": """SELECT o_orderkey AS doc_id, CAST(CASE WHEN kind = 'b' AND o_orderkey % 13 > 10 THEN 1 ELSE 0 END AS INTEGER) AS seq, clause_index, dimension, risk_title, risk_level, CAST(NULL AS VARCHAR) AS legal_basis, quote, context_before, context_after, related_rule_code
FROM orders, (VALUES ('a', 4, '违约责任', '无限责任', 'HIGH', '无限责任', '', '', 'LIAB_UNLIMITED_001'), ('b', 3, '知识产权', '归属', 'LOW', '知识产权', '本项目', '归', CAST(NULL AS VARCHAR))) v(kind, clause_index, dimension, risk_title, risk_level, quote, context_before, context_after, related_rule_code)
WHERE o_orderkey % 13 > 10 OR (kind = 'a' AND o_orderkey % 13 = 1) OR (kind = 'b' AND o_orderkey % 13 = 10)""",
    "finding_locate": f"{_LOCATED} SELECT doc_id, seq, paragraph_index, original_text, quote, anchor_method FROM lo",
    "finding_related_code": f"{_LOCATED} SELECT doc_id, seq, related_rule_code FROM lo",
    "risk_unify": f"{_LOCATED}, {_RISKS} SELECT doc_id, CAST(seq AS BIGINT) AS seq, 'RULE' AS source, risk_code, risk_level, paragraph_index, quote, CAST(NULL AS VARCHAR) AS anchor_method, CAST(NULL AS VARCHAR) AS related_rule_code FROM rr UNION ALL SELECT doc_id, CAST(seq + 2147483648 AS BIGINT), 'LLM', NULL, risk_level, paragraph_index, quote, anchor_method, related_rule_code FROM lo",
    "risk_merge_rule_rule": _merge("seq IN (0, 1, 8)"),
    "risk_merge_rule_llm": _merge("seq IN (0, 2, 8, 9)"),
    "risk_merge_llm_llm": _merge("seq IN (2, 3, 5, 6)"),
    "risk_merge_ambiguous": _merge("seq IN (0, 2, 4, 7)"),
    "risk_merge_full": _merge("true"),
    "risk_clause_interval_join": f"{PLACED} SELECT r.doc_id, r.seq, r.paragraph_index, clt.clause_index, false AS ambiguous FROM ({fx.RISKS_SQL}) r LEFT JOIN clt ON clt.doc_id = r.doc_id AND r.paragraph_index BETWEEN clt.start_idx AND clt.end_idx",
    "risk_rule_resolve": f"WITH r AS (SELECT doc_id, seq, CASE WHEN risk_code = 'B' AND doc_id % 2 = 0 THEN 'A' ELSE risk_code END AS risk_code FROM ({fx.RISKS_SQL}) x) SELECT doc_id, seq, CASE WHEN doc_id % 2 = 0 AND risk_code = 'A' THEN CAST(1 AS BIGINT) END AS rule_id, CASE WHEN doc_id % 2 <> 0 THEN 'RULE_NOT_FOUND' END AS batch_error FROM r",
    "file_type_validate": f"""WITH f AS (SELECT *, lower({_EXT}) AS e, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS m FROM ({fx.FILES_SQL}) x),
g AS (SELECT f.*, s.code, t.of_code, s.heads FROM f LEFT JOIN {_FILE_SPECS} ON s.ext = f.e LEFT JOIN {_MIMES} ON t.mime = f.m),
h AS (SELECT *, CASE WHEN size <= 0 THEN 'FILE_CORRUPTED' WHEN size > {MOST_BYTES} THEN 'FILE_TOO_LARGE' WHEN code IS NULL THEN 'UNSUPPORTED_FORMAT'
  WHEN m NOT IN ({", ".join(f"'{m}'" for m in MIME_FALLBACK)}) AND coalesce(of_code <> code, true) THEN 'UNSUPPORTED_FORMAT'
  WHEN NOT (starts_with(head_hex, split_part(heads, ',', 1)) OR (contains(heads, ',') AND starts_with(head_hex, split_part(heads, ',', 2)))) THEN 'UNSUPPORTED_FORMAT' END AS error_code FROM g)
SELECT file_no, CASE WHEN error_code IS NULL THEN code END AS type_code, error_code FROM h""",
    "file_dedupe_sha256": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS kept, doc_id <> min(doc_id) OVER (PARTITION BY text) AS reused FROM documents",
    "task_idempotency_key": "SELECT o_orderkey, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), sha256(o_orderpriority), CASE WHEN o_orderkey % 3 <> 0 THEN 'v' || CAST(o_orderkey % 3 AS VARCHAR) ELSE 'NONE' END, 'ingest-v1')) AS task_key FROM orders",
    "block_reuse_conflict": f"""WITH a AS (SELECT DISTINCT * FROM ({fx.OLD_BLOCKS_SQL}) x), b AS (SELECT DISTINCT * FROM ({fx.NEW_BLOCKS_SQL}) y),
n AS (SELECT file_id, count(*) AS n_new FROM b GROUP BY file_id), o AS (SELECT file_id, count(*) AS n_old FROM a GROUP BY file_id), c AS (SELECT file_id, count(*) AS n_both FROM a JOIN b USING (file_id, order_index) GROUP BY file_id)
SELECT n.file_id, coalesce(n_old, 0) AS n_old, n_new, CASE WHEN n_old IS NULL THEN 'INSERT' WHEN n_old = n_both AND n_new = n_both THEN 'REUSE' ELSE 'DOCUMENT_BLOCKS_CONFLICT' END AS verdict FROM n LEFT JOIN o USING (file_id) LEFT JOIN c USING (file_id)""",
    "stage_gate": f"SELECT task_id, stage, has_rows, CASE WHEN stage IN ('CLAUSED', 'REVIEWED') OR has_rows THEN 'DOCUMENT_ALREADY_PERSISTED' ELSE 'OK' END AS document_gate, CASE WHEN stage = 'REVIEWED' THEN 'TASK_ALREADY_PERSISTED' WHEN stage IN ('UPLOADED', 'PARSED') THEN 'DOCUMENT_NOT_PERSISTED' WHEN has_rows THEN 'TASK_ALREADY_PERSISTED' ELSE 'OK' END AS risk_gate, CASE WHEN stage = 'REVIEWED' THEN 'OK' ELSE 'REPORT_NOT_READY' END AS report_gate, CASE WHEN stage = 'REVIEWED' THEN 'OK' ELSE 'RISK_REVIEW_NOT_READY' END AS review_gate, CASE WHEN stage = 'REVIEWED' THEN 'OK' ELSE 'WRITEBACK_NOT_READY' END AS writeback_gate FROM ({_TASKS}) x",
    "status_transition": f"SELECT event_id, from_status, to_status, CASE WHEN m.a IS NULL THEN 'INVALID_STATE_TRANSITION' ELSE 'OK' END AS verdict FROM ({fx.MOVES_SQL}) e LEFT JOIN (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in TASK_MOVES)}) m(a, b) ON m.a = e.from_status AND m.b = e.to_status",
    "review_overlay": f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY risk_id ORDER BY seq DESC) AS nth FROM ({fx.DECISIONS_SQL}) x WHERE (review_status = 'MODIFIED' AND new_level IN ('HIGH', 'MEDIUM', 'LOW')) OR (review_status IN ('CONFIRMED', 'REJECTED') AND new_level IS NULL))
SELECT r.risk_id, CASE WHEN d.review_status = 'MODIFIED' THEN d.new_level ELSE r.risk_level END AS risk_level, coalesce(d.review_status, 'PENDING') AS review_status, d.review_comment, CASE coalesce(d.review_status, 'PENDING') WHEN 'PENDING' THEN '待复核' WHEN 'CONFIRMED' THEN '已确认' WHEN 'REJECTED' THEN '已驳回' ELSE '已修改' END AS review_label
FROM ({fx.OPEN_RISKS_SQL}) r LEFT JOIN d ON d.risk_id = r.risk_id AND d.nth = 1""",
    "writeback_transition": f"SELECT record_id, status, attempt, CASE WHEN status IN ('writing', 'success') THEN status ELSE 'writing' END AS next_status, CAST(CASE WHEN status IS NULL THEN 1 WHEN status IN ('failed', 'not_written') THEN attempt + 1 ELSE attempt END AS INTEGER) AS next_attempt, status IS NULL OR status IN ('failed', 'not_written') AS started, CASE WHEN status = 'success' THEN 'WRITEBACK_ALREADY_SUCCESS' END AS error_code FROM ({fx.RECORDS_SQL}) x",
    "approval_comment_dedupe": f"SELECT instance_id, idempotency_key, comment_id, content, 'MOCK-CMT-' || CAST(comment_id AS VARCHAR) AS external_id FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, idempotency_key ORDER BY comment_id) AS nth FROM ({fx.COMMENTS_SQL}) x) y WHERE nth = 1",
    "risk_overview": _OVERVIEW.format(sql=fx.RISKS_SQL),
    "overview_sentence": f"SELECT doc_id, {_sentence()} AS sentence FROM ({_OVERVIEW.format(sql=f'SELECT CASE WHEN seq <= doc_id % 10 THEN doc_id ELSE doc_id + 1000000000 END AS doc_id, risk_level FROM ({fx.RISKS_SQL}) q')}) o",
    "contract_list_latest_task": f"""WITH t AS ({_TASKS}), l AS (SELECT * FROM t WHERE task_id IN (SELECT max(task_id) FROM t GROUP BY contract_id))
SELECT c_custkey AS contract_id, c_name AS contract_no, l.task_id AS latest_task_id, l.stage, l.status, CAST(CASE l.stage WHEN 'UPLOADED' THEN 0 WHEN 'PARSED' THEN 30 WHEN 'CLAUSED' THEN 60 WHEN 'REVIEWED' THEN 100 END AS INTEGER) AS progress FROM customer LEFT JOIN l ON l.contract_id = c_custkey""",
    "task_tree_diagnosis": f"SELECT t.task_id, t.contract_id, c.c_name AS contract_no, n.n_name AS file_name, CASE WHEN c.c_custkey IS NULL THEN 'CONTRACT_NOT_FOUND' WHEN n.n_nationkey IS NULL THEN 'FILE_NOT_FOUND' ELSE 'OK' END AS diagnosis FROM ({_TASKS}) t LEFT JOIN customer c ON c.c_custkey = t.contract_id AND c.c_custkey % 10 <> 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 7 <> 0",
    "workbench_flat": f"""{PLACED}, {_META}, {_RISKS} SELECT t.task_id AS doc_id, t.stage, CAST(18 AS BIGINT) AS n_blocks, (SELECT count(*) FROM clt WHERE clt.doc_id = t.task_id) AS n_clauses, (SELECT count(*) FROM meta WHERE meta.doc_id = t.task_id) AS n_metadata, (SELECT count(*) FROM rr WHERE rr.doc_id = t.task_id) AS n_risks FROM ({_TASKS}) t""",
    "report_markdown": f"{_REPORT} SELECT doc_id, content_md FROM report",
    "upload_gate": f"""SELECT run_id, m = '' AS file_valid, m AS missing, CASE WHEN error_code IS NOT NULL THEN error_code WHEN m <> '' THEN 'BACKEND_CONTRACT_INCOMPLETE' END AS gate_error FROM (
  SELECT *, concat_ws(',', CASE WHEN error_code IS NOT NULL THEN 'upload' END, CASE WHEN contract_id IS NULL OR contract_id <= 0 THEN 'contract_id' END, CASE WHEN file_id <= 0 THEN 'file_id' END, CASE WHEN review_task_id <= 0 THEN 'review_task_id' END, CASE WHEN sha256 IS NULL OR sha256 = '' THEN 'sha256' END) AS m FROM ({fx.RUNS_SQL}) r) x""",
    "workflow_routes": f"SELECT run_id, CASE WHEN file_valid IS TRUE THEN 'continue' ELSE 'stop' END AS after_validate, CASE WHEN parse_status IN ('EMPTY', 'PARSED') THEN 'continue' ELSE 'stop' END AS after_parse, CASE WHEN error_code IS NULL THEN 'continue' ELSE 'stop' END AS after_persist, CASE WHEN llm_error_code IS NULL AND has_findings IS TRUE THEN 'continue' ELSE 'fallback' END AS after_llm FROM ({fx.RUNS_SQL}) r",
    "workflow_status": f"""SELECT run_id, CASE WHEN done THEN 'completed' ELSE 'rejected' END AS workflow_status, CASE WHEN NOT done AND coalesce(error_code, '') <> 'TASK_ALREADY_PERSISTED' THEN CASE error_code WHEN 'PARSE_FAILED' THEN 'FILE_CORRUPTED' WHEN 'PARSE_UNSUPPORTED_TYPE' THEN 'UNSUPPORTED_FORMAT' ELSE 'INTERNAL_ERROR' END END AS block_reason
FROM (SELECT *, error_code IS NULL AND file_valid IS TRUE AND coalesce(parse_status, 'FAILED') <> 'FAILED' AS done FROM ({fx.RUNS_SQL}) r) x""",
    "error_classification": f"SELECT r.run_id, r.error_code, s.http AS http_status, s.category, s.category = 'SYSTEM_ERROR' AS retryable, s.category IN ('USER_ERROR', 'FATAL') AS should_block FROM ({fx.RUNS_SQL}) r JOIN (VALUES {', '.join(map(str, ERRORS))}) s(code, http, category) ON s.code = CASE WHEN r.error_code IN ({', '.join(repr(e[0]) for e in ERRORS)}) THEN r.error_code ELSE 'INTERNAL_ERROR' END WHERE r.error_code IS NOT NULL",
    "task_block": f"SELECT task_id, status, reason_code, error_code, CASE WHEN error_code IS NULL THEN 'blocked' ELSE status END AS next_status FROM (SELECT *, CASE WHEN status NOT IN ('pending', 'parsing', 'reviewing') THEN 'INVALID_STATE_TRANSITION' WHEN reason_code IS NULL OR reason_code NOT IN ({', '.join(map(repr, BLOCK_REASONS))}) THEN 'VALIDATION_ERROR' END AS error_code FROM ({fx.BLOCKS_SQL}) b) x",
    "name_lookups": f"""SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'DOCX' WHEN 2 THEN 'PDF' WHEN 3 THEN 'TIFF' END AS type_code, CASE WHEN row_id % 6 IN (0, 1) THEN 'PARAGRAPH' ELSE 'PAGE' END AS locator_type, CASE WHEN status = 'blocked' THEN 'blocked' WHEN stage = 'REVIEWED' THEN 'reviewed' ELSE 'processing' END AS phase,
  CASE row_id % 10 WHEN 0 THEN 'uploads/1/a.docx' WHEN 7 THEN 'a..b/c' WHEN 9 THEN 'k' || CAST(row_id AS VARCHAR) END AS storage_key FROM ({fx.NAMES_SQL}) n""",
    "rule_snapshot": f"""WITH s AS ({fx.RULE_SETS_SQL}), r AS ({fx.SET_RULES_SQL}), e AS (SELECT contract_type, max(set_id) AS set_id FROM s WHERE is_active GROUP BY contract_type)
SELECT e.contract_type, s.version, count(r.rule_id) AS n_rules, 'OK' AS verdict FROM e JOIN s ON s.set_id = e.set_id LEFT JOIN (SELECT * FROM r WHERE is_active) r ON r.set_id = e.set_id GROUP BY e.contract_type, s.version""",
    "rule_snapshot_malformed": f"""SELECT contract_type, max(version) AS version, count(rule_id) AS n_rules, CASE WHEN max(set_id) IS NOT NULL AND coalesce(max(version), '') = '' THEN 'VERSION_MISSING' WHEN max(set_id) IS NULL AND count(rule_id) > 0 THEN 'RULES_WITHOUT_SET'
  WHEN count(*) FILTER (WHERE rule_id IS NOT NULL AND (rule_code = '' OR severity IS NULL OR expression IS NULL OR expression NOT LIKE '{{%')) > 0 THEN 'MALFORMED_RULE' ELSE 'OK' END AS verdict FROM ({fx.SNAPSHOTS_SQL}) x GROUP BY contract_type""",
    "merge_metrics": f"SELECT source, count(*) AS n_risks, count(DISTINCT doc_id) AS n_documents FROM ({_merge('true')}) m GROUP BY source",
    "anchor_metrics": f"{_LOCATED} SELECT (SELECT count(*) FROM fi) AS findings, count(*) AS resolved, (SELECT count(*) FROM fi) - count(*) AS dropped, count(*) FILTER (WHERE anchor_method = 'CLAUSE_FALLBACK') AS fallback FROM lo",
    "document_persist": f"{PLACED}, {_META}, {_persist_call(1, 'task_id % 2 = 0', None)}, {_persist_call(2, 'true', 1)} {_persisted(1)} UNION ALL {_persisted(2)}",
    "writeback_sequence": f"SELECT key, {_CARRIED[0]} AS state, CAST({_CARRIED[1]} AS BIGINT) AS attempts, CAST({_CARRIED[2]} AS BIGINT) AS refused FROM ({_folded(fx.WRITEBACK_LOG_SQL, _WRITING, 'none')}) f",
    "status_sequence": f"SELECT key, {_CARRIED[0]} AS state, CAST({_CARRIED[2]} AS BIGINT) AS refused FROM ({_folded(fx.STATUS_LOG_SQL, _MOVING, 'pending')}) f",
    "docx_scan": f"""{CORPUS} SELECT o_custkey AS contract_id, CASE WHEN o_custkey % 20 = 0 THEN 'PDF' ELSE 'DOCX' END AS file_type, CASE WHEN o_custkey % 20 = 0 THEN 'FAILED' ELSE 'PARSED' END AS status, CASE WHEN o_custkey % 20 = 0 THEN 'PARSE_UNSUPPORTED_TYPE' END AS error_code,
  CASE WHEN o_custkey % 20 = 0 THEN 0 ELSE count(*) END AS n_paragraphs, md5(CASE WHEN o_custkey % 20 = 0 THEN '' ELSE string_agg(block_type || ':' || trim(text), chr(10) ORDER BY doc_id, idx) END) AS digest
  FROM p JOIN orders ON o_orderkey = doc_id GROUP BY o_custkey""",
    "orphan_contracts": """SELECT c_custkey AS contract_id, CASE WHEN c_custkey % 6 = 0 THEN 'skipped_not_found' WHEN c_custkey % 5 = 0 THEN 'skipped_task_link_present' WHEN c_custkey % 4 = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) THEN 'skipped_file_exists'
  WHEN c_custkey % 4 = 2 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) THEN 'skipped_task_exists' ELSE 'deleted' END AS outcome FROM customer""",
    "risks_by_task": f"{PLACED}, {_META}, {_RISKS}, {_STORED} SELECT sr.doc_id, CAST(sr.seq AS INTEGER) AS seq, sr.risk_code, sr.named AS clause_id, sc.clause_no, sc.clause_type FROM sr LEFT JOIN sc ON sc.doc_id = sr.doc_id AND sc.clause_id = sr.named",
    "rule_catalogue_hits": f"""{CORPUS} SELECT doc_id, 'SUPPLIER_' || s_suppkey AS risk_code, CASE WHEN s_suppkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level, idx AS paragraph_index, '）：' || x.s_name AS quote,
  '命中规则关键词：「）：' || x.s_name || '」、「' || x.s_name || '」' AS reason FROM p JOIN supplier x ON contains(p.text, x.s_name) WHERE s_suppkey % 3 <> 0""",
    "workbench_nested": f"""{_NESTED}
SELECT t.task_id AS doc_id, t.stage, coalesce(jc.clauses, '[]') AS clauses, coalesce(jr.risks, '[]') AS risks, coalesce(jm.metadata, '[]') AS metadata, coalesce(jf.ids, '') AS foreign_clause_ids FROM ({_TASKS}) t LEFT JOIN jc ON jc.doc_id = t.task_id LEFT JOIN jr ON jr.doc_id = t.task_id LEFT JOIN jm ON jm.doc_id = t.task_id LEFT JOIN jf ON jf.doc_id = t.task_id""",
    "workbench_pages": f"""{_NESTED},
pb AS (SELECT doc_id AS file_id, '[' || string_agg('{{"order_index":' || idx || CASE WHEN block_type = 'PARAGRAPH' THEN ',"paragraph_index":' || idx ELSE '' END || ',"block_type":"' || block_type || '","text":' || to_json(text) || '}}', ',' ORDER BY idx) || ']' AS blocks FROM p GROUP BY doc_id),
al AS (SELECT t.*, c.c_custkey AS found_contract, c.c_name, c.c_mktsegment, f.file_id AS found_file, f.file_name, f.file_ext, f.parse_status FROM ({fx.PAGE_TASKS_SQL}) t LEFT JOIN customer c ON c.c_custkey = t.contract_id AND c.c_custkey % 10 <> 0 LEFT JOIN ({fx.PAGE_FILES_SQL}) f ON f.file_id = t.file_id),
ok AS (SELECT *, CASE WHEN found_contract IS NULL THEN 'CONTRACT_NOT_FOUND' WHEN found_file IS NULL THEN 'FILE_NOT_FOUND' END AS error_code FROM al)
SELECT ok.task_id AS doc_id, error_code,
  CASE WHEN error_code IS NULL THEN '{{"task_id":' || task_id || ',"status":"' || status || '","current_stage":"' || stage || '","progress":' || CASE stage WHEN 'UPLOADED' THEN 0 WHEN 'PARSED' THEN 30 WHEN 'CLAUSED' THEN 60 WHEN 'REVIEWED' THEN 100 ELSE 0 END || '}}' END AS task,
  CASE WHEN error_code IS NULL THEN '{{"contract_id":' || contract_id || ',"contract_no":' || to_json(c_name) || ',"title":' || to_json(c_mktsegment) || '}}' END AS contract,
  CASE WHEN error_code IS NULL THEN '{{"file_id":' || ok.file_id || ',"file_name":' || to_json(file_name) || ',"file_type":"' || CASE file_ext WHEN '.pdf' THEN 'PDF' WHEN '.docx' THEN 'DOCX' ELSE file_ext END || '","parse_status":"' || parse_status || '"}}' END AS file,
  CASE WHEN error_code IS NULL THEN coalesce(pb.blocks, '[]') END AS blocks, CASE WHEN error_code IS NULL THEN coalesce(jc.clauses, '[]') END AS clauses, CASE WHEN error_code IS NULL THEN coalesce(jr.risks, '[]') END AS risks,
  CASE WHEN error_code IS NULL THEN coalesce(jm.metadata, '[]') END AS metadata, CASE WHEN error_code IS NULL THEN coalesce(jf.ids, '') END AS foreign_clause_ids
FROM ok LEFT JOIN pb ON pb.file_id = ok.file_id LEFT JOIN jc ON jc.doc_id = ok.task_id LEFT JOIN jr ON jr.doc_id = ok.task_id LEFT JOIN jm ON jm.doc_id = ok.task_id LEFT JOIN jf ON jf.doc_id = ok.task_id""",
    "contract_number_conflict": f"SELECT upload_id, contract_no, CASE WHEN contract_no IN (SELECT contract_no FROM ({fx.STORED_CONTRACTS_SQL}) c) OR row_number() OVER (PARTITION BY contract_no ORDER BY upload_id) > 1 THEN 'CONFLICT' ELSE 'OK' END AS verdict FROM ({fx.UPLOADS_SQL}) u",
    "task_reuse": f"""WITH q AS (SELECT *, sha256(concat_ws(chr(31), contract_id, sha256, coalesce(version, 'NONE'), 'ingest-v1')) AS task_key FROM ({fx.REQUESTS_SQL}) r),
t AS (SELECT task_id, sha256(concat_ws(chr(31), contract_id, 's1', 'NONE', 'ingest-v1')) AS task_key FROM ({fx.TASKED_SQL}) x),
m AS (SELECT q.*, t.task_id, t.task_id IS NOT NULL OR row_number() OVER (PARTITION BY q.task_key ORDER BY request_id) > 1 AS task_reused FROM q LEFT JOIN t ON t.task_key = q.task_key)
SELECT request_id, task_key, task_id, task_reused, NOT (reused AND task_reused) AS created FROM m""",
    "clause_block_ranges": f"SELECT c.clause_id, least(a.paragraph_index, b.paragraph_index) AS paragraph_start, greatest(a.paragraph_index, b.paragraph_index) AS paragraph_end FROM ({fx.BLOCK_CLAUSES_SQL}) c JOIN ({fx.PARAGRAPH_BLOCKS_SQL}) a ON a.block_id = c.start_block_id JOIN ({fx.PARAGRAPH_BLOCKS_SQL}) b ON b.block_id = c.end_block_id",
    "block_paragraphs": f"SELECT r.doc_id, r.ord, r.block_id, (SELECT paragraph_index FROM ({fx.PARAGRAPH_BLOCKS_SQL}) b WHERE b.block_id = r.block_id) AS paragraph_index FROM ({fx.BLOCK_ROWS_SQL}) r",
    "parse_state": f"SELECT *, CASE WHEN parse_status = 'PARSED' AND incoming = 'FAILED' THEN 'PARSE_STATUS_ALREADY_FINAL' ELSE 'OK' END AS verdict, CASE WHEN parse_status = 'PARSED' THEN 'PARSED' ELSE incoming END AS next_status FROM ({fx.PARSES_SQL}) f",
    "review_patch_verdicts": f"""SELECT p.*, CASE WHEN NOT coalesce(CASE review_status WHEN 'MODIFIED' THEN new_level IN ('HIGH', 'MEDIUM', 'LOW') WHEN 'CONFIRMED' THEN new_level IS NULL WHEN 'REJECTED' THEN new_level IS NULL ELSE false END, false) THEN 'INVALID_REVIEW' WHEN t.task_id IS NULL THEN 'TASK_NOT_FOUND' WHEN t.stage <> 'REVIEWED' THEN 'RISK_REVIEW_NOT_READY'
  WHEN NOT EXISTS (SELECT 1 FROM ({fx.TASK_RISKS_SQL}) r WHERE r.risk_id = p.risk_id AND r.task_id = p.task_id) THEN 'RISK_NOT_FOUND' ELSE 'OK' END AS verdict FROM ({fx.PATCHES_SQL}) p LEFT JOIN ({fx.TASKS_SQL}) t ON t.task_id = p.task_id""",
    "comment_recovery": f"""WITH e AS (SELECT instance_id, idempotency_key, min(comment_id) AS comment_id FROM ({fx.COMMENTS_SQL}) c GROUP BY instance_id, idempotency_key)
SELECT record_id, CASE WHEN w.instance_id IS NULL THEN 'REFUSED' WHEN e.comment_id IS NOT NULL THEN 'RECOVERED' ELSE 'POSTED' END AS action, e.comment_id, CASE WHEN w.instance_id IS NOT NULL AND (e.comment_id IS NOT NULL OR outcome = 'ok') THEN 'success' ELSE 'failed' END AS next_status
FROM ({fx.WRITES_SQL}) w LEFT JOIN e ON e.instance_id = w.instance_id AND e.idempotency_key = w.idempotency_key""",
    "display_labels": "SELECT doc_id, left(sha256(text), 8) || '…' || right(sha256(text), 8) AS short, lang AS lang_short, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = doc_id % 4 THEN '第 ' || (doc_id % 5) || ' 段' ELSE '第 ' || (doc_id % 5) || '–' || (doc_id % 4) || ' 段' END AS range FROM documents",
    "rule_converge": f"SELECT coalesce(a.rule_code, b.rule_code) AS rule_code, CASE WHEN a.rule_code IS NULL THEN 'INSERT' WHEN b.rule_code IS NULL THEN 'DELETE' WHEN a.severity IS NOT DISTINCT FROM b.severity AND a.sort_order = b.sort_order THEN 'KEEP' ELSE 'UPDATE' END AS action FROM ({fx.OLD_RULES_SQL}) a FULL JOIN ({fx.NEW_RULES_SQL}) b ON a.rule_code = b.rule_code",
    "approval_bind": f"WITH f AS (SELECT sha256, min(contract_id) AS found FROM ({fx.APPROVAL_CONTRACTS_SQL}) c GROUP BY sha256) SELECT instance_no, coalesce(contract_id, found) AS contract_id, contract_id IS NULL AND found IS NOT NULL AS newly_bound FROM ({fx.INSTANCES_SQL}) i LEFT JOIN f ON f.sha256 = i.sample_sha256",
    "writeback_resolve": f"SELECT t.task_id, t.task_id AS contract_id, i.instance_no, CASE WHEN i.instance_no IS NULL THEN 'WRITEBACK_APPROVAL_NOT_READY' END AS error_code FROM ({fx.TASKS_SQL}) t LEFT JOIN ({fx.APPROVAL_CONTRACTS_SQL}) c ON c.contract_id = t.task_id LEFT JOIN ({fx.INSTANCES_SQL}) i ON i.instance_id = c.instance_id",
    "document_batch": f"{CORPUS} SELECT doc_id, idx AS order_index, block_type, text, 0 AS char_start_in_block, CAST(length(text) AS INTEGER) AS char_end_in_block, CAST(e - length(text) AS BIGINT) AS char_start_global, CAST(e AS BIGINT) AS char_end_global FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS e FROM p) x",
    # planted: block 17 is missing, order 3 became 2, the first clause begins at 18
    "document_batch_violations": f"""{PLACED}, {_META}, bl AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND idx = 3 THEN 2 ELSE idx END AS i FROM p WHERE NOT (doc_id % 5 = 0 AND idx = 17)),
cu AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND clause_index = 0 THEN 18 ELSE start_idx END AS a, end_idx AS b FROM clt)
SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS repeated_order, (SELECT count(*) FROM cu WHERE cu.doc_id = d.doc_id AND b < a) AS inverted_clauses,
  CAST(CASE WHEN d.doc_id % 9 = 0 THEN 2 ELSE 0 END AS BIGINT) AS inverted_offsets,
  (SELECT count(*) FROM (SELECT doc_id, a AS i FROM cu UNION ALL SELECT doc_id, b FROM cu) e WHERE e.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.doc_id = e.doc_id AND bl.i = e.i)) AS dangling_clauses,
  (SELECT count(*) FROM meta WHERE meta.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.doc_id = meta.doc_id AND bl.i = meta.idx)) AS dangling_metadata
FROM (SELECT DISTINCT doc_id FROM p) d""",
    "risk_payload": f"SELECT doc_id, seq, risk_code, risk_title, dimension, risk_level, source, reason, legal_basis, quote AS original_text, paragraph_index, anchor_method FROM ({fx.RISKS_SQL}) r",
    # only CLAUSED tasks without rows take risks; a batch with rule b's level (CRITICAL) is refused
    "risk_persist": f"""{PLACED} SELECT r.doc_id, r.seq, CAST(CASE r.risk_code WHEN 'A' THEN 1 WHEN 'B' THEN 2 END AS BIGINT) AS rule_id, clt.clause_index, 'PENDING' AS review_status FROM ({fx.RISKS_SQL}) r JOIN clt ON clt.doc_id = r.doc_id AND r.paragraph_index BETWEEN clt.start_idx AND clt.end_idx
WHERE r.seq NOT IN (1, 8) AND r.doc_id % 3 <> 0 AND r.doc_id % 4 = 2""",
    "writeback_render": _WRITEBACK,
    "writeback_hash_key": f"SELECT doc_id, sha256(content_md) AS content_hash, sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(content_md)) AS idempotency_key FROM ({_WRITEBACK}) w",
    "prompt_render": f"""{PLACED}, {_META}, {_RISKS},
ca AS (SELECT doc_id, count(*) AS n, string_agg('--- 条款 #' || clause_index || '（' || CASE WHEN clause_no IS NULL THEN '' ELSE concat_ws(' ', clause_no, title) || '·' END || clause_type || '）---' || chr(10) || text || chr(10), chr(10) ORDER BY clause_index) AS c FROM clt GROUP BY doc_id),
ru AS (SELECT doc_id, string_agg('- rule_code=' || risk_code || ' | ' || {_TITLES} || ' | 维度=' || {_DIMS} || ' | 等级=' || risk_level || ' | 命中证据：' || quote, chr(10) ORDER BY seq) AS r FROM rr GROUP BY doc_id)
SELECT ca.doc_id, '【合同类型】PURCHASE' || chr(10) || chr(10) || '【本批条款】（共 ' || n || ' 条，clause_index 请原样回显）' || chr(10) || c || chr(10) || coalesce('【规则已命中】（不要重复报告；相关的请在 related_rule_code 里回填对应编码）' || chr(10) || r, '【规则已命中】（无）') AS user_prompt FROM ca LEFT JOIN ru ON ru.doc_id = ca.doc_id""",
    "evaluation_metrics": f"""{PLACED}, {_META}, {_RISKS}, d AS (SELECT DISTINCT doc_id FROM p), n AS (SELECT risk_code, count(*) AS n_risks, count(DISTINCT doc_id) AS matched FROM rr GROUP BY risk_code),
f AS (SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM meta WHERE field_key = 'prepay_ratio') AS failed)
SELECT c.rule_code, coalesce(n.matched, 0) AS matched, (SELECT count(*) FROM d) - coalesce(n.matched, 0) - CASE WHEN c.rule_code = 'PAY_PREPAY_RATIO_001' THEN f.failed ELSE 0 END AS not_matched, CASE WHEN c.rule_code = 'PAY_PREPAY_RATIO_001' THEN f.failed ELSE 0 END AS failed, coalesce(n.n_risks, 0) AS n_risks
FROM (VALUES ('IP_OWNER_SUPPLIER_001'), ('LIAB_UNLIMITED_001'), ('PAY_PREPAY_RATIO_001')) c(rule_code) CROSS JOIN f LEFT JOIN n ON n.risk_code = c.rule_code""",
}
