"""Uploads, tasks, patches and block ranges: what exists is used again, what clashes is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .persist import task_key


def contract_numbers(uploads: DataFrame, contracts: DataFrame) -> DataFrame:
    """(upload_id, contract_no, verdict): CONFLICT if the number is stored, or an earlier upload of the batch has it.

    Both sides are combined by number before they meet, so a number that many uploads share is one row.
    """
    first = uploads.groupBy("contract_no").agg(F.min("upload_id").alias("_first"))
    taken = contracts.select("contract_no").distinct().withColumn("_taken", F.lit(True))
    met = uploads.join(first.join(taken, "contract_no", "left"), "contract_no")
    return met.select("upload_id", "contract_no", F.when(F.col("_taken") | (F.col("upload_id") > F.col("_first")), "CONFLICT").otherwise("OK").alias("verdict"))


def ensure_tasks(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds ``task_key``, ``task_id``, ``task_reused`` and ``created`` to (request_id, contract_id, sha256, version, reused).

    A request takes the stored task of its key, whatever the task's status; without one the first request of the key makes it
    (``task_id`` null as yet) and later ones use it again. Something was created unless file and task are both used again.
    """
    keyed = requests.withColumn("task_key", task_key(F.col("contract_id"), F.col("sha256"), F.col("version")))
    first = keyed.groupBy("task_key").agg(F.min("request_id").alias("_first"))
    met = keyed.join(first, "task_key").join(tasks.select("task_key", "task_id"), "task_key", "left")
    again = F.col("task_id").isNotNull() | (F.col("request_id") > F.col("_first"))
    return met.select(*requests.columns, "task_key", "task_id", again.alias("task_reused"), (~(F.col("reused") & again)).alias("created"))


def clause_ranges(clauses: DataFrame, blocks: DataFrame) -> DataFrame:
    """(clause_id, paragraph_start, paragraph_end) from the paragraphs of a clause's first and last block; without either there is no range."""
    at = lambda name: blocks.select(F.col("block_id").alias(f"{name}_block_id"), F.col("paragraph_index").alias(f"_{name}"))
    met = clauses.join(at("start"), "start_block_id").join(at("end"), "end_block_id")
    return met.select("clause_id", F.least("_start", "_end").alias("paragraph_start"), F.greatest("_start", "_end").alias("paragraph_end"))


def with_paragraph(rows: DataFrame, blocks: DataFrame, block: str = "block_id") -> DataFrame:
    """``rows`` with the paragraph of the block they name; null if there is none."""
    return rows.join(blocks.select(F.col("block_id").alias(block), "paragraph_index"), block, "left")


def parse_state(files: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``next_status`` to (parse_status, incoming): only what is PARSED may not become FAILED."""
    final = (F.col("parse_status") == "PARSED") & (F.col("incoming") == "FAILED")
    return files.withColumn("verdict", F.when(final, "PARSE_STATUS_ALREADY_FINAL").otherwise("OK")).withColumn("next_status", F.when(final, F.col("parse_status")).otherwise(F.col("incoming")))


def review_patches(patches: DataFrame, risks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds ``verdict`` to (task_id, risk_id, seq, review_status, review_comment, new_level).

    In this order: the decision must be one (a level if and only if it is MODIFIED, never PENDING), the task must exist and be
    REVIEWED, and the risk must be that task's.
    """
    level = F.col("new_level").isin("HIGH", "MEDIUM", "LOW")
    fine = F.coalesce(F.when(F.col("review_status") == "MODIFIED", level).otherwise(F.col("review_status").isin("CONFIRMED", "REJECTED") & F.col("new_level").isNull()), F.lit(False))
    met = patches.join(tasks.select("task_id", "stage"), "task_id", "left").join(risks.select("risk_id", "task_id").distinct().withColumn("_own", F.lit(True)), ["risk_id", "task_id"], "left")
    verdict = F.when(~fine, "INVALID_REVIEW").when(F.col("stage").isNull(), "TASK_NOT_FOUND").when(F.col("stage") != "REVIEWED", "RISK_REVIEW_NOT_READY").when(F.col("_own").isNull(), "RISK_NOT_FOUND").otherwise("OK")
    return met.select(*patches.columns, verdict.alias("verdict"))


def post_comments(writes: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``action``, ``comment_id`` and ``next_status`` to (record_id, instance_id, idempotency_key, outcome).

    A comment that is there already (its answer got lost) is taken, not posted again; else the post's outcome decides.
    """
    met = writes.join(existing.groupBy("instance_id", "idempotency_key").agg(F.min("comment_id").alias("comment_id")), ["instance_id", "idempotency_key"], "left")
    found = F.col("comment_id").isNotNull()
    action = F.when(F.col("instance_id").isNull(), "REFUSED").when(found, "RECOVERED").otherwise("POSTED")
    status = F.when(found | (F.col("instance_id").isNotNull() & (F.col("outcome") == "ok")), "success").otherwise("failed")
    return met.select("record_id", action.alias("action"), "comment_id", status.alias("next_status"))


def short_hash(value: Column) -> Column:
    return F.when(F.length(value) > 16, F.concat(F.left(value, F.lit(8)), F.lit("…"), F.right(value, F.lit(8)))).otherwise(value)


def paragraph_range(start: Column, end: Column) -> Column:
    number = lambda c: c.cast("string")
    one, two = F.concat(F.lit("第 "), number(start), F.lit(" 段")), F.concat(F.lit("第 "), number(start), F.lit("–"), number(end), F.lit(" 段"))
    return F.when(start.isNull() | end.isNull(), "").when(start == end, one).otherwise(two)
