"""Parquet tables and the contract corpus that is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _marker(n: int) -> str:
    chinese = "一二三四五"[n - 1]
    return f"CASE WHEN k % 11 = 0 THEN '' WHEN k % 4 IN (0, 1) THEN '第{chinese}条 ' WHEN k % 4 = 2 THEN '{chinese}、' ELSE '{n}. ' END"


#: The lines of a contract as (block type, SQL); the text is the same in Spark SQL and in the SQL of the checks.
CONTRACT_LINES = [
    ("PARAGRAPH", "'采购合同'"),
    ("PARAGRAPH", "'合同编号：HT-' || CAST(k AS STRING)"),
    ("PARAGRAPH", "'甲方（采购方）：' || c_name"),
    ("PARAGRAPH", "CASE WHEN k % 5 = 0 THEN '' ELSE '统一社会信用代码：91310115MA' || lpad(CAST(k AS STRING), 8, '0') END"),
    ("PARAGRAPH", "'乙方（供应方）：' || coalesce(s_name, '未定')"),
    ("PARAGRAPH", f"{_marker(1)} || '合同标的与金额'"),
    ("PARAGRAPH", "CASE k % 3 WHEN 0 THEN '合同总价 ¥' || amt WHEN 1 THEN '合同总价为美元 ' || amt ELSE '合同总价为 ' || amt || ' 元' END"),
    ("PARAGRAPH", f"{_marker(2)} || '付款方式'"),
    ("TABLE_ROW", "'付款阶段' || chr(9) || '比例' || chr(9) || '付款条件'"),
    ("TABLE_ROW", "'1. 预付款' || chr(9) || CASE WHEN k % 7 = 0 THEN '三成' ELSE CAST((k % 6) * 10 + 10 AS STRING) || '%' END || chr(9) || '合同生效后支付'"),
    ("TABLE_ROW", "'2. 尾款' || chr(9) || CAST(90 - (k % 6) * 10 AS STRING) || '%' || chr(9) || '验收后支付'"),
    ("PARAGRAPH", f"{_marker(3)} || '知识产权'"),
    ("PARAGRAPH", "'本项目知识产权归' || CASE WHEN k % 3 = 0 THEN '乙方' ELSE '甲方' END || '所有'"),
    ("PARAGRAPH", f"{_marker(4)} || '违约责任'"),
    ("PARAGRAPH", "CASE WHEN k % 4 = 0 THEN '甲方承担无限责任并赔偿全部损失' ELSE '双方责任以合同金额为上限' END"),
    ("PARAGRAPH", f"{_marker(5)} || '争议解决'"),
    ("PARAGRAPH", "'争议提交仲裁委员会；本合同自 ' || d || ' 起生效'"),
    ("PARAGRAPH", "'签订日期：' || d"),
]

_BASE = """
SELECT o.o_orderkey AS k, c.c_name, s.s_name,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS d
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN supplier s ON s.s_suppkey = l.sk
"""

#: The corpus for the SQL of the checks, as a common table ``p``(doc_id, idx, block_type, text).
CORPUS_SQL = (
    f"b AS ({_BASE}), p AS (SELECT k AS doc_id, i.idx, CASE WHEN i.idx IN (8, 9, 10) THEN 'TABLE_ROW' ELSE 'PARAGRAPH' END AS block_type, CASE i.idx "
    + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(CONTRACT_LINES))
    + " END AS text FROM b CROSS JOIN (SELECT CAST(unnest(range(18)) AS INTEGER) AS idx) i)"
)


#: Contracts that a task takes, roughly; how many partitions there are follows from the corpus.
CONTRACTS_A_TASK = 20_000


def contracts(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, o_custkey, lines): one contract an order, its lines as structs (block_type, text).

    A contract's row is many times smaller than its lines, so rows are dealt by ``key`` (doc_id or o_custkey), in a number of partitions that
    isn't coalesced by their size, before they get them: whatever works by that key goes on from there without a shuffle.
    """
    o, c, s, li = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier", "lineitem"))
    first = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"))
    base = (
        o.join(c.hint("merge"), o.o_custkey == c.c_custkey)  # customers grow with the orders, so they aren't broadcast
        .join(first, o.o_orderkey == first.l_orderkey, "left")
        .join(s, s.s_suppkey == F.col("sk"), "left")
        .select(
            F.col("o_orderkey").alias("k"),
            "o_custkey",
            "c_name",
            "s_name",
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amt"),
            F.col("o_orderdate").cast("date").cast("string").alias("d"),
        )
    )
    base = base.repartition(1 + o.count() // CONTRACTS_A_TASK, "k" if key == "doc_id" else key)
    lines = F.array(*(F.struct(F.lit(kind).alias("block_type"), F.expr(sql).alias("text")) for kind, sql in CONTRACT_LINES))
    return base.select(F.col("k").alias("doc_id"), "o_custkey", lines.alias("lines"))


def contract_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, block_type, text): the lines of the contracts, dealt by document."""
    return contracts(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("idx", "line")).select("doc_id", "idx", "line.block_type", "line.text")
