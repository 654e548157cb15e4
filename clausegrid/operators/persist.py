"""Gates, identities and state changes as functions from tables to tables: what is written, what is refused and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FILE_TYPES, MIME_FALLBACK, MOST_BYTES, MOST_RULES, TASK_MOVES
from ..functions.joins import broadcast_if_small
from ..functions.text import last_path_extension, sha_key


def validate_files(files: DataFrame) -> DataFrame:
    """Adds ``type_code`` and ``error_code`` to (file_name, content_type, size, head): size, extension, MIME type, first bytes, in this order."""
    rows = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(ext).alias("ext"), F.array(*map(F.lit, mimes)).alias("mimes"), F.array(*map(F.lit, heads)).alias("heads")) for code, ext, mimes, heads in FILE_TYPES))
    spec = F.get(F.filter(rows, lambda s: s["ext"] == F.col("_ext")), F.lit(0))
    of_mime = F.get(F.filter(rows, lambda s: F.array_contains(s["mimes"], F.col("_mime"))), F.lit(0))
    base = files.withColumn("_ext", last_path_extension(F.col("file_name"))).withColumn("_mime", F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0])))
    base = base.withColumn("_spec", spec).withColumn("_of_mime", of_mime)
    magic = F.exists(F.col("_spec.heads"), lambda h: F.startswith(F.hex("head"), h))
    error = (
        F.when(F.col("size") <= 0, "FILE_CORRUPTED")
        .when(F.col("size") > MOST_BYTES, "FILE_TOO_LARGE")
        .when(F.col("_spec").isNull(), "UNSUPPORTED_FORMAT")
        .when(~F.col("_mime").isin(MIME_FALLBACK) & ~F.coalesce(F.col("_of_mime.code") == F.col("_spec.code"), F.lit(False)), "UNSUPPORTED_FORMAT")
        .when(~magic, "UNSUPPORTED_FORMAT")
    )
    return base.withColumn("error_code", error).withColumn("type_code", F.when(F.col("error_code").isNull(), F.col("_spec.code"))).drop("_ext", "_mime", "_spec", "_of_mime")


def dedupe_files(files: DataFrame, content: str, arrival: str) -> DataFrame:
    """The first file of each content wins: adds ``sha256``, ``kept`` (its arrival) and ``reused``."""
    hashed = files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = hashed.groupBy("sha256").agg(F.min(arrival).alias("kept"))
    return hashed.join(first, "sha256").withColumn("reused", F.col(arrival) != F.col("kept"))


def task_key(contract: Column, sha: Column, version: Column) -> Column:
    """A task's identity: contract, file, rule set version (NONE without one) and the ingest's own version."""
    return sha_key(contract.cast("string"), sha, F.coalesce(version, F.lit("NONE")), F.lit("ingest-v1"))


def block_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(file_id, verdict): INSERT without blocks so far, REUSE if the sets of order_index are equal, else DOCUMENT_BLOCKS_CONFLICT."""
    a = existing.select("file_id", "order_index", F.lit(1).alias("old"))
    b = incoming.select("file_id", "order_index", F.lit(1).alias("new"))
    both = a.join(b, ["file_id", "order_index"], "full").groupBy("file_id").agg(F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("n_both"))
    verdict = F.when(F.col("n_new") == 0, None).when(F.col("n_old") == 0, "INSERT").when((F.col("n_old") == F.col("n_both")) & (F.col("n_new") == F.col("n_both")), "REUSE").otherwise("DOCUMENT_BLOCKS_CONFLICT")
    return both.withColumn("verdict", verdict).where("verdict IS NOT NULL").select("file_id", "n_old", "n_new", "verdict")


def locate_risks_in_clauses(risks: DataFrame, clauses: DataFrame) -> DataFrame:
    """Adds ``clause_index`` (null outside of all ranges) and ``ambiguous`` if several ranges hold the paragraph. Repeated risks stay as they are."""
    ranges = clauses.groupBy("doc_id").agg(F.collect_list(F.struct("clause_index", F.least("start_idx", "end_idx").alias("s"), F.greatest("start_idx", "end_idx").alias("e"))).alias("_ranges"))
    inside = F.filter("_ranges", lambda r: F.col("paragraph_index").between(r["s"], r["e"]))  # bounded by a document's clauses
    met = risks.join(ranges, "doc_id", "left").withColumn("_in", inside)
    return met.select(*risks.columns, F.when(F.size("_in") == 1, F.col("_in")[0]["clause_index"]).alias("clause_index"), (F.coalesce(F.size("_in"), F.lit(0)) > 1).alias("ambiguous"))


def resolve_rules(risks: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule_id``; a document with a code that the set lacks is refused as a whole (``batch_error``)."""
    found = risks.join(broadcast_if_small(rules.select(F.col("rule_code").alias("risk_code"), "rule_id"), MOST_RULES), "risk_code", "left")
    missing = F.max(F.col("risk_code").isNotNull() & F.col("rule_id").isNull()).over(W.partitionBy("doc_id"))
    return found.withColumn("batch_error", F.when(missing, "RULE_NOT_FOUND")).withColumn("rule_id", F.when(~missing, F.col("rule_id")))


def stage_gate(tasks: DataFrame) -> DataFrame:
    """For (task_id, stage, has_rows): may the document, the risks, a report be written or read?"""
    stage, rows = F.col("stage"), F.col("has_rows")
    document = F.when(stage.isin("CLAUSED", "REVIEWED") | rows, "DOCUMENT_ALREADY_PERSISTED").otherwise("OK")
    risks = F.when(stage == "REVIEWED", "TASK_ALREADY_PERSISTED").when(stage != "CLAUSED", "DOCUMENT_NOT_PERSISTED").when(rows, "TASK_ALREADY_PERSISTED").otherwise("OK")
    ready = lambda code: F.when(stage != "REVIEWED", code).otherwise("OK")
    return tasks.select("*", document.alias("document_gate"), risks.alias("risk_gate"), ready("REPORT_NOT_READY").alias("report_gate"), ready("RISK_REVIEW_NOT_READY").alias("review_gate"), ready("WRITEBACK_NOT_READY").alias("writeback_gate"))


def move_status(events: DataFrame, moves: list[tuple[str, str]] = TASK_MOVES) -> DataFrame:
    """Adds ``verdict`` to (from_status, to_status): OK or INVALID_STATE_TRANSITION."""
    pairs = [f"{a}>{b}" for a, b in moves]
    return events.withColumn("verdict", F.when(F.concat_ws(">", "from_status", "to_status").isin(pairs), "OK").otherwise("INVALID_STATE_TRANSITION"))


def review_overlay(risks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Risks with the last valid decision of each: state, comment, and the level if it was MODIFIED.

    A decision (risk_id, seq, review_status, review_comment, new_level) is valid if it confirms, rejects, or
    modifies with a level; only MODIFIED has one.
    """
    fine = F.when(F.col("review_status") == "MODIFIED", F.col("new_level").isin("HIGH", "MEDIUM", "LOW")).otherwise(F.col("review_status").isin("CONFIRMED", "REJECTED") & F.col("new_level").isNull())
    last = decisions.where(fine).groupBy("risk_id").agg(F.max_by(F.struct("review_status", "review_comment", "new_level"), "seq").alias("d"))
    met = risks.join(last, "risk_id", "left")
    return met.select(
        *[c for c in risks.columns if c != "risk_level"],
        F.when(F.col("d.review_status") == "MODIFIED", F.col("d.new_level")).otherwise(F.col("risk_level")).alias("risk_level"),
        F.coalesce("d.review_status", F.lit("PENDING")).alias("review_status"),
        F.col("d.review_comment").alias("review_comment"),
    )


def start_writeback(records: DataFrame) -> DataFrame:
    """For (status or null, attempt): the next status and attempt, whether work starts, and the error if it is done already."""
    s = F.col("status")
    free = s.isNull() | s.isin("failed", "not_written")
    return records.select(
        "*",
        F.when(free, "writing").otherwise(s).alias("next_status"),
        F.when(s.isNull(), F.lit(1)).when(free, F.col("attempt") + 1).otherwise(F.col("attempt")).cast("int").alias("next_attempt"),
        free.alias("started"),
        F.when(s == "success", "WRITEBACK_ALREADY_SUCCESS").alias("error_code"),
    )


def dedupe_comments(comments: DataFrame) -> DataFrame:
    """The first comment of each (instance_id, idempotency_key), with its external id."""
    first = comments.groupBy("instance_id", "idempotency_key").agg(F.min("comment_id").alias("comment_id"), F.min_by("content", "comment_id").alias("content"))
    return first.withColumn("external_id", F.concat(F.lit("MOCK-CMT-"), F.col("comment_id").cast("string")))
