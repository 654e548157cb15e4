"""Tables derived from orders for the operators whose inputs the benchmark data lack.

Each is one SQL text that Spark and the SQL of the checks both run, so it says nothing about how an
operator computes its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

_GOOD = """'{"clause_index": 4, "dimension": "违约责任", "risk_title": "无限责任", "risk_level": "HIGH", "reason": "过重", "quote": "无限责任", "context_before": "", "related_rule_code": "LIAB_UNLIMITED_001"}'"""
_MORE = """'{"clause_index": 3, "dimension": "知识产权", "risk_title": "归属", "risk_level": "LOW", "reason": "不清", "quote": "知识产权", "context_before": "本项目", "context_after": "归", "occurrence_hint": 1, "legal_basis": null, "suggestion": {"type": "REPLACE", "text": "改"}}'"""

#: (doc_id, raw_text): a model's raw output for each order, good and bad by k % 13.
RAW_FINDINGS_SQL = f"""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 13
  WHEN 0 THEN replace('{{"findings": [' || {_GOOD} || ']}}', '"clause_index": 4', '"clause_index": "4"')
  WHEN 1 THEN '```json' || chr(10) || '{{"findings": [' || {_GOOD} || ']}}' || chr(10) || '```'
  WHEN 2 THEN '[' || {_GOOD} || ']'
  WHEN 3 THEN replace('{{"findings": [' || {_GOOD} || ',' || {_MORE} || ']}}', '"LOW"', '"SEVERE"')
  WHEN 4 THEN ''
  WHEN 5 THEN '{{"findings": []}}'
  WHEN 6 THEN '{{"findings": [' || {_GOOD}
  WHEN 7 THEN replace('{{"findings": [' || {_GOOD} || ']}}', '"context_before": ""', '"context_before": "0123456789012345678901234567890"')
  WHEN 8 THEN replace('{{"findings": [' || {_MORE} || ']}}', '"occurrence_hint": 1', '"occurrence_hint": 0')
  WHEN 9 THEN '{{}}'
  WHEN 10 THEN '```' || chr(10) || '{{"findings": [' || {_MORE} || ']}}'
  ELSE '{{"findings": [' || {_GOOD} || ', ' || {_MORE} || ']}}' END AS raw_text
FROM orders"""

_FINDING_ROWS = [
    (0, 4, "无限责任", "", "", "CASE WHEN o_orderkey % 2 = 0 THEN 'LIAB_UNLIMITED_001' ELSE 'NOPE' END"),
    (1, 3, "知识产权", "", "", "CAST(NULL AS STRING)"),
    (2, 3, "知识产权", "本项目", "归", "'IP_OWNER_SUPPLIER_001'"),
    (3, 99, "采购", "", "", "CAST(NULL AS STRING)"),
    (4, 0, "采购", "", "", "CAST(NULL AS STRING)"),
    (5, 0, "", "", "", "'LIAB_UNLIMITED_001'"),
    (6, 4, "责任", "双方", "以", "CAST(NULL AS STRING)"),
    (7, 2, "付款", "预", "", "CAST(NULL AS STRING)"),
]

#: (doc_id, seq, ...): findings as rows.
FINDINGS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {seq} AS seq, {clause} AS clause_index, '违约责任' AS dimension, 'T{seq}' AS risk_title, CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level, "
    f"'r{seq}' AS reason, CAST(NULL AS STRING) AS legal_basis, '{quote}' AS quote, '{before}' AS context_before, '{after}' AS context_after, {code} AS related_rule_code FROM orders"
    for seq, clause, quote, before, after, code in _FINDING_ROWS
)

_N = "CAST(NULL AS STRING)"
_RISK_ROWS = [
    (0, "'RULE'", "'A'", "'rule a'", "'X'", "'LOW'", _N, 3, _N, _N),
    (1, "'RULE'", "'A'", "'rule a again'", "'X'", "CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'WEIRD' END", "'law 1'", 3, _N, _N),
    (2, "'LLM'", _N, "'Big Risk'", "'X'", "'MEDIUM'", "'law 2'", 3, "'CLAUSE_SCOPED'", "'A'"),
    (3, "'LLM'", _N, "'bigrisk '", "'X'", "'HIGH'", _N, 3, "'CLAUSE_FALLBACK'", _N),
    (4, "'LLM'", _N, "'Other'", "'X'", "'HIGH'", _N, 3, "'CLAUSE_SCOPED'", "CASE WHEN o_orderkey % 3 = 0 THEN 'A' END"),
    (5, "'LLM'", _N, "'T5'", "'Y'", "'LOW'", _N, 5, "'CLAUSE_SCOPED'", _N),
    (6, "'LLM'", _N, "'t 5'", "'Y'", "'MEDIUM'", "'law 6'", 5, "'CLAUSE_SCOPED'", "'GONE'"),
    (7, "'RULE+LLM'", "'A'", "'done'", "'X'", "'LOW'", _N, 3, "'CLAUSE_SCOPED'", "'A'"),
    (8, "'RULE'", "'B'", "'rule b'", "'Y'", "'CRITICAL'", _N, 5, _N, _N),
    (9, "'LLM'", _N, "'T9'", "'Y'", "'HIGH'", _N, 5, "'CLAUSE_SCOPED'", "'B'"),
]

#: Risks in one shape, with every kind of repetition.
RISKS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, CAST({seq} AS BIGINT) AS seq, {source} AS source, {code} AS risk_code, {title} AS risk_title, {dim} AS dimension, {level} AS risk_level, 'why {seq}' AS reason, "
    f"{law} AS legal_basis, 'text {idx}' AS original_text, 'quote {seq}' AS quote, {idx} AS paragraph_index, {anchor} AS anchor_method, {related} AS related_rule_code FROM orders"
    for seq, source, code, title, dim, level, law, idx, anchor, related in _RISK_ROWS
)

#: (task_id, contract_id, stage, status, has_rows): a task an order.
TASKS_SQL = """
SELECT o_orderkey AS task_id, o_custkey AS contract_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PARSED' WHEN 2 THEN 'CLAUSED' ELSE 'REVIEWED' END AS stage,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'blocked' ELSE 'completed' END AS status,
  o_orderkey % 3 = 0 AS has_rows
FROM orders"""

#: (event_id, from_status, to_status).
MOVES_SQL = """
SELECT o_orderkey AS event_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'blocked' ELSE 'completed' END AS from_status,
  CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'blocked' WHEN 4 THEN 'completed' ELSE 'lost' END AS to_status
FROM orders"""

#: (file_no, file_name, content_type, size, head_hex).
FILES_SQL = """
SELECT o_orderkey AS file_no,
  'f' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 7 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tif' WHEN 3 THEN '.exe' WHEN 4 THEN '' WHEN 5 THEN '.jpeg' ELSE '.a.png' END AS file_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf; q=1' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN 'APPLICATION/octet-stream' ELSE 'image/tiff' END AS content_type,
  CASE o_orderkey % 11 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(52428801 AS BIGINT) ELSE CAST(52428800 AS BIGINT) END AS size,
  CASE o_orderkey % 6 WHEN 0 THEN '504B0304AA' WHEN 1 THEN '255044462D31' WHEN 2 THEN '4D4D002A00' WHEN 3 THEN 'FFD8FFE0' WHEN 4 THEN '89504E470D0A1A0A' ELSE '00' END AS head_hex
FROM orders"""

#: (file_id, order_index) of blocks that are stored and of blocks that come in.
OLD_BLOCKS_SQL = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS file_id, l_linenumber AS order_index FROM lineitem"
NEW_BLOCKS_SQL = "SELECT CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 2000000000 ELSE l_orderkey END AS file_id, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS order_index FROM lineitem"

#: (risk_id, risk_level) and decisions (risk_id, seq, review_status, review_comment, new_level).
OPEN_RISKS_SQL = "SELECT o_orderkey AS risk_id, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM orders"
DECISIONS_SQL = """
SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 1000000000 END AS risk_id, l_partkey * 10 + l_linenumber AS seq,
  CASE l_partkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'MODIFIED' WHEN 3 THEN 'MODIFIED' ELSE 'PENDING' END AS review_status,
  'c' || CAST(l_partkey AS STRING) AS review_comment,
  CASE WHEN l_partkey % 5 = 2 THEN 'LOW' WHEN l_partkey % 10 = 0 THEN 'HIGH' END AS new_level
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) l"""

#: (record_id, status, attempt).
RECORDS_SQL = """
SELECT o_orderkey AS record_id, CASE o_orderkey % 5 WHEN 0 THEN 'not_written' WHEN 1 THEN 'writing' WHEN 2 THEN 'success' WHEN 3 THEN 'failed' END AS status,
  CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 3 + 1 AS INTEGER) END AS attempt
FROM orders"""

#: (comment_id, instance_id, idempotency_key, content).
COMMENTS_SQL = """
SELECT o_orderkey AS comment_id, o_custkey % 100 AS instance_id, 'key-' || CAST(o_custkey % 7 AS STRING) AS idempotency_key, 'text ' || CAST(o_orderkey AS STRING) AS content
FROM orders"""

#: Rule sets and their rules, active or not.
RULE_SETS_SQL = "SELECT s_suppkey AS set_id, CASE s_suppkey % 4 WHEN 0 THEN 'PURCHASE' WHEN 1 THEN 'SALES' WHEN 2 THEN 'SERVICE' ELSE 'LABOR' END AS contract_type, 'v' || CAST(s_suppkey AS STRING) AS version, s_suppkey % 3 <> 0 AS is_active FROM supplier"
SET_RULES_SQL = "SELECT p_partkey AS rule_id, p_partkey % 150 AS set_id, 'R' || CAST(p_partkey AS STRING) AS rule_code, p_size AS sort_order, p_partkey % 5 <> 0 AS is_active FROM part"


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table; it reads orders, lineitem, supplier, part and customer only, each once.

    A UNION ALL of selects from orders, as the other engine runs it, is one scan here, its rows made by ``inline``.
    """
    parts = [p.removesuffix(" FROM orders").removeprefix("SELECT ") for p in sql.split(" UNION ALL ")]
    if len(parts) > 1 and sql.endswith(" FROM orders") and " WHERE " not in sql:
        names = ("orders",)
        sql = "SELECT r.* FROM (SELECT inline(array(" + ", ".join(f"struct(struct({p}) AS r)" for p in parts) + ")) FROM {orders})"
        return spark.sql(_escaped(sql, names), orders=table(spark, sf_dir, "orders"))
    names = tuple(n for n in ("orders", "lineitem", "supplier", "part", "customer") if f"FROM {n}" in sql)
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(_escaped(sql, names), **{name: table(spark, sf_dir, name) for name in names})


def _escaped(sql: str, names: tuple[str, ...]) -> str:
    """Braces of JSON texts doubled, as they aren't names of tables."""
    for name in names:
        sql = sql.replace(f"{{{name}}}", f"\x00{name}\x01")
    return sql.replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")


#: (run_id, contract_id, file_id, review_task_id, sha256, error_code, file_valid, parse_status, llm_error_code, has_findings).
RUNS_SQL = """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS contract_id, CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS BIGINT) ELSE o_orderkey + 1 END AS file_id, CASE WHEN o_orderkey % 11 = 0 THEN CAST(-1 AS BIGINT) ELSE o_orderkey + 2 END AS review_task_id,
  CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'abc' END AS sha256,
  CASE o_orderkey % 9 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN 'PARSE_UNSUPPORTED_TYPE' WHEN 2 THEN 'TASK_ALREADY_PERSISTED' WHEN 3 THEN 'OTHER_ERROR' WHEN 4 THEN 'OCR_LOW_QUALITY' WHEN 5 THEN 'LLM_TIMEOUT' END AS error_code,
  CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE true END AS file_valid,
  CASE o_orderkey % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN 'EMPTY' ELSE 'PARSED' END AS parse_status,
  CASE WHEN o_orderkey % 8 = 0 THEN 'LLM_UNAVAILABLE' END AS llm_error_code, CASE o_orderkey % 10 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN false ELSE true END AS has_findings
FROM orders"""

#: (task_id, status, reason_code).
BLOCKS_SQL = """
SELECT o_orderkey AS task_id, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'blocked' WHEN 4 THEN 'completed' ELSE 'lost' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'FILE_CORRUPTED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'NOT_A_REASON' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'INTERNAL_ERROR' END AS reason_code
FROM orders"""

#: (row_id, extension, status, stage, raw_key).
NAMES_SQL = """
SELECT o_orderkey AS row_id, CASE o_orderkey % 6 WHEN 0 THEN '.docx' WHEN 1 THEN ' DOCX ' WHEN 2 THEN 'pdf' WHEN 3 THEN '.TIFF' WHEN 4 THEN 'exe' ELSE CAST(NULL AS STRING) END AS extension,
  CASE o_orderkey % 3 WHEN 0 THEN 'blocked' ELSE 'pending' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'REVIEWED' ELSE 'PARSED' END AS stage,
  CASE o_orderkey % 10 WHEN 0 THEN ' uploads/./1//a.docx ' WHEN 1 THEN '/abs/a' WHEN 2 THEN 'C:x' WHEN 3 THEN 'a/../b' WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN './/' WHEN 7 THEN 'a..b/c' WHEN 8 THEN replace('a#b', '#', chr(92)) ELSE 'k' || CAST(o_orderkey AS STRING) END AS raw_key
FROM orders"""

#: (rule_code, severity, sort_order): what is stored and what is wanted.
OLD_RULES_SQL = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'OLD' ELSE 'R' END || CAST(p_partkey AS STRING) AS rule_code, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS severity, p_size AS sort_order FROM part"
NEW_RULES_SQL = "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'NEW' ELSE 'R' END || CAST(p_partkey AS STRING) AS rule_code, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS severity, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS sort_order FROM part"

#: Approval instances, some bound, with the digest of their sample; contracts with their file's digest and instance.
INSTANCES_SQL = "SELECT CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey + 1000000000 ELSE s_suppkey END AS instance_id, 'AP-' || CAST(s_suppkey AS STRING) AS instance_no, 'd' || CAST(s_suppkey % 40 AS STRING) AS sample_sha256, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 1000 END AS contract_id FROM supplier"
APPROVAL_CONTRACTS_SQL = "SELECT CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS contract_id, 'd' || CAST(o_orderkey % 60 AS STRING) AS sha256, CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 120 END AS instance_id FROM orders"

#: Write-back tasks and their risks with a human review.
WRITEBACK_TASKS_SQL = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'HT-' || CAST(o_orderkey AS STRING) END AS contract_no, CASE WHEN o_orderkey % 3 = 0 THEN 'a|b' ELSE '合同' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'REVIEWED' ELSE 'ODD' END AS stage, o_orderdate AS created_at FROM orders"
WRITEBACK_RISKS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {n} AS seq, '{level}' AS risk_level, 'T{n}' AS risk_title, {code} AS risk_code, 'D' AS dimension, 'RULE' AS source, {idx} AS paragraph_index, 'why' || chr(10) || ' not' AS reason, {law} AS legal_basis, 'q{n}' AS quote, '{status}' AS review_status, {comment} AS review_comment FROM orders WHERE o_orderkey % {m} = 0"
    for n, level, code, idx, law, status, comment, m in [(0, "HIGH", "'A'", "3", "'law'", "MODIFIED", "'fine'", 2), (1, "ODD", "CAST(NULL AS STRING)", "CAST(NULL AS INT)", "CAST(NULL AS STRING)", "PENDING", "CAST(NULL AS STRING)", 3)]
)

#: A task with its contract and file for each order, some columns empty; the reviews of some risks.
REPORT_HEADS_SQL = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' ELSE 'reviewing' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PARSED' WHEN 2 THEN 'CLAUSED' WHEN 3 THEN 'ODD|STAGE' ELSE 'REVIEWED' END AS stage, o_orderdate AS created_at,
  'HT-' || CAST(o_orderkey AS STRING) AS contract_no, CASE WHEN o_orderkey % 3 = 0 THEN 'a|b' || chr(10) || 'c' ELSE ' 采购合同 ' END AS title, 'PURCHASE' AS contract_type,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'Party ' || CAST(o_custkey AS STRING) END AS our_party, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'Seller ' || o_orderstatus END AS counterparty,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN '' END AS currency,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS sign_date, CAST(CAST(o_orderdate AS DATE) AS STRING) AS effective_date, CAST(NULL AS STRING) AS expire_date,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS dept,
  '合同|样本.docx' AS file_name, CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS STRING) ELSE 'DOCX' END AS file_type, 'PARSED' AS parse_status, 'ab' || CAST(o_orderkey AS STRING) AS sha256, 'PARAGRAPH' AS locator_type
FROM orders"""
REVIEWS_SQL = """
SELECT o_orderkey AS doc_id, 1 AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'MODIFIED' ELSE 'ODD' END AS review_status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'see' || chr(10) || ' clause' WHEN o_orderkey % 3 = 1 THEN '' END AS review_comment, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS reviewed_at
FROM orders"""

#: Tasks, two a file; some are written already, some files are parsed, some gone. Requests, some of tasks that aren't there or of parses that failed.
PERSIST_TASKS_SQL = """
SELECT o_orderkey AS task_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS file_id, CASE o_orderkey % 11 WHEN 0 THEN 'CLAUSED' WHEN 1 THEN 'REVIEWED' WHEN 2 THEN 'UPLOADED' ELSE 'PARSED' END AS stage
FROM orders WHERE o_orderkey % 13 <> 0"""
PERSIST_FILES_SQL = """
SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS file_id, max(CASE WHEN floor(o_orderkey / 4) % 5 = 0 THEN 'PARSED' ELSE 'PENDING' END) AS parse_status
FROM orders WHERE floor(o_orderkey / 4) % 17 <> 0 GROUP BY floor(o_orderkey / 4)"""
PERSIST_REQUESTS_SQL = "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 6 = 1 THEN 'FAILED' ELSE 'PARSED' END AS parse_status FROM orders"

#: Logs of events in order, a third of them of one key.
WRITEBACK_LOG_SQL = """
SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey END AS key, l_orderkey * 10 + l_linenumber AS seq,
  CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'error' ELSE 'start' END AS event
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l"""
STATUS_LOG_SQL = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS key, o_orderkey AS seq,
  CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'parsing' WHEN 4 THEN 'blocked' WHEN 5 THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'reviewing' END END AS event
FROM orders"""

#: A rule for each supplier: its name and an older spelling, in all clauses, or in those of a type where it isn't.
CATALOGUE_SQL = """
SELECT 'SUPPLIER_' || CAST(s_suppkey AS STRING) AS rule_code, s_name AS rule_name, '主体资质' AS dimension, 'KEYWORD' AS rule_type,
  '{"keywords": ["' || s_name || '", "' || '）：' || s_name || '"]}' AS expression, CASE WHEN s_suppkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
  CASE WHEN s_suppkey % 3 = 0 THEN array('DISPUTE') END AS target_clause_types, CAST(s_suppkey AS INT) AS sort_order
FROM supplier"""

#: Tasks with their contract and file, two or three a file, and the files that are still there.
PAGE_TASKS_SQL = """
SELECT o_orderkey AS task_id, o_custkey AS contract_id, o_orderkey - o_orderkey % 3 AS file_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PARSED' WHEN 2 THEN 'CLAUSED' WHEN 3 THEN 'ODD' ELSE 'REVIEWED' END AS stage, o_orderstatus AS status
FROM orders"""
PAGE_FILES_SQL = """
SELECT o_orderkey - o_orderkey % 3 AS file_id, max('f' || CAST(o_orderkey - o_orderkey % 3 AS STRING)) AS file_name,
  max(CASE WHEN o_orderkey % 12 < 3 THEN '.txt' WHEN o_orderkey % 12 < 6 THEN '.pdf' ELSE '.docx' END) AS file_ext, 'PARSED' AS parse_status
FROM orders WHERE (o_orderkey - o_orderkey % 3) % 7 <> 0 GROUP BY o_orderkey - o_orderkey % 3"""

#: Uploads and the contracts that are stored.
UPLOADS_SQL = "SELECT o_orderkey AS upload_id, 'HT-' || CAST(o_custkey AS STRING) AS contract_no FROM orders"
STORED_CONTRACTS_SQL = "SELECT 'HT-' || CAST(c_custkey * 3 AS STRING) AS contract_no FROM customer"

#: Requests for tasks; the contracts that have a task of content s1 without a rule set.
REQUESTS_SQL = "SELECT o_orderkey AS request_id, o_custkey AS contract_id, 's' || CAST(o_orderkey % 3 AS STRING) AS sha256, CASE WHEN o_orderkey % 4 = 0 THEN 'v4' END AS version, o_orderkey % 2 = 0 AS reused FROM orders"
TASKED_SQL = "SELECT c_custkey * 10 AS task_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS contract_id FROM customer"

#: Clauses with their blocks, rows that name a block, and blocks with their paragraph.
BLOCK_CLAUSES_SQL = "SELECT l_orderkey * 10 + l_linenumber AS clause_id, l_partkey AS start_block_id, CASE WHEN l_linenumber = 7 THEN l_suppkey + 1000000000 ELSE l_suppkey END AS end_block_id FROM lineitem"
BLOCK_ROWS_SQL = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 9 = 0 THEN CAST(NULL AS BIGINT) WHEN l_partkey % 9 = 1 THEN l_partkey + 1000000000 ELSE l_partkey END AS block_id FROM lineitem"
PARAGRAPH_BLOCKS_SQL = "SELECT p_partkey AS block_id, p_size AS paragraph_index FROM part"

#: (file_id, parse_status, incoming).
PARSES_SQL = "SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PARSED' ELSE 'FAILED' END AS parse_status, CASE WHEN o_orderkey % 2 = 0 THEN 'PARSED' ELSE 'FAILED' END AS incoming FROM orders"

#: Patches of risks; each risk is one of its order's task.
PATCHES_SQL = """
SELECT CASE WHEN l_partkey % 11 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS task_id, CASE WHEN l_partkey % 7 = 0 THEN l_orderkey * 10 + 1 ELSE l_orderkey * 10 END AS risk_id, l_partkey AS seq,
  CASE l_partkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'MODIFIED' WHEN 3 THEN 'PENDING' END AS review_status, 'c' AS review_comment, CASE l_partkey % 6 WHEN 2 THEN 'LOW' WHEN 3 THEN 'ODD' END AS new_level
FROM lineitem"""
TASK_RISKS_SQL = "SELECT o_orderkey * 10 AS risk_id, o_orderkey AS task_id FROM orders"

#: Write-backs with what their post would give.
WRITES_SQL = "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 150 END AS instance_id, 'key-' || CAST(o_custkey % 9 AS STRING) AS idempotency_key, CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'business error' ELSE 'no answer' END AS outcome FROM orders"

#: Snapshots of rule sets, one row a rule, some malformed.
SNAPSHOTS_SQL = """
SELECT 'T' || CAST(p_partkey % 40 AS STRING) AS contract_type, CASE WHEN p_partkey % 40 = 3 THEN CAST(NULL AS BIGINT) ELSE p_partkey % 40 END AS set_id, CASE p_partkey % 40 WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'v1' END AS version,
  CASE WHEN p_partkey % 40 = 6 THEN CAST(NULL AS BIGINT) ELSE p_partkey END AS rule_id, CASE WHEN p_partkey % 40 = 7 AND p_partkey % 3 = 0 THEN '' ELSE 'R' END AS rule_code, CASE WHEN p_partkey % 40 = 8 THEN CAST(NULL AS STRING) ELSE 'HIGH' END AS severity,
  CASE p_partkey % 40 WHEN 9 THEN '[1]' WHEN 10 THEN 'no json' WHEN 11 THEN CAST(NULL AS STRING) ELSE '{"pattern": "x"}' END AS expression
FROM part"""
