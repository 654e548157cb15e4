"""Workflow predicates as columns: gates, routes, states and what an error means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALREADY_DONE, BLOCK_REASON_OF, BLOCK_REASONS, ERRORS, FILE_TYPES, TASK_MOVES


def upload_gate(uploads: DataFrame) -> DataFrame:
    """Adds ``file_valid``, ``missing`` (what the upload didn't give) and ``gate_error`` to (contract_id, file_id, review_task_id, sha256, error_code).

    An upload's own error stays; a complete-looking upload without a result is BACKEND_CONTRACT_INCOMPLETE.
    """
    absent = lambda c: F.when(~(F.coalesce(F.col(c), F.lit(0)) > 0), c)
    failed = F.when(F.coalesce("error_code", F.lit("")) != "", "upload")
    missing = F.array_compact(F.array(failed, absent("contract_id"), absent("file_id"), absent("review_task_id"), F.when(F.coalesce("sha256", F.lit("")) == "", "sha256")))
    out = uploads.withColumn("_m", missing)
    return out.select(*uploads.columns, (F.size("_m") == 0).alias("file_valid"), F.array_join("_m", ",").alias("missing"), F.when(F.coalesce("error_code", F.lit("")) != "", F.col("error_code")).when(F.size("_m") > 0, "BACKEND_CONTRACT_INCOMPLETE").alias("gate_error"))


def usable(parse_status: Column) -> Column:
    """A parse result that is there and hasn't failed."""
    return F.coalesce(parse_status != "FAILED", F.lit(False))


def routes(states: DataFrame) -> DataFrame:
    """The branch after each gate for (file_valid, parse_status, error_code, llm_error_code, has_findings): missing evidence stops or falls back."""
    go = lambda ok, other: F.when(ok, "continue").otherwise(other)
    clear = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return states.select(
        "*",
        go(F.coalesce("file_valid", F.lit(False)), "stop").alias("after_validate"),
        go(usable(F.col("parse_status")), "stop").alias("after_parse"),
        go(clear("error_code"), "stop").alias("after_persist"),
        go(clear("llm_error_code") & F.coalesce("has_findings", F.lit(False)), "fallback").alias("after_llm"),
    )


def workflow_status(states: DataFrame) -> DataFrame:
    """Adds ``workflow_status`` and, for a run that must be reported, the reason to block its task."""
    done = F.col("error_code").isNull() & F.coalesce("file_valid", F.lit(False)) & usable(F.col("parse_status"))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in BLOCK_REASON_OF for x in pair)), F.coalesce("error_code", F.lit("")))
    reason = F.when(~done & ~F.coalesce(F.col("error_code").isin(ALREADY_DONE), F.lit(False)), F.coalesce(known, F.lit("INTERNAL_ERROR")))
    return states.select("*", F.when(done, "completed").otherwise("rejected").alias("workflow_status"), reason.alias("block_reason"))


def review_phase(status: Column, stage: Column) -> Column:
    return F.when(status == "blocked", "blocked").when(stage == "REVIEWED", "reviewed").otherwise("processing")


def locator_type(extension: Column) -> Column:
    """DOCX has paragraphs only, everything else pages."""
    return F.when(F.ltrim(F.lower(F.trim(extension)), F.lit(".")) == "docx", "PARAGRAPH").otherwise("PAGE")


def type_code(extension: Column) -> Column:
    """The type of an extension, with or without dot, in any case; null if it is unknown."""
    dotted = F.lower(F.when(F.startswith(extension, F.lit(".")), extension).otherwise(F.concat(F.lit("."), extension)))
    return F.try_element_at(F.create_map(*(F.lit(x) for code, ext, _, _ in FILE_TYPES for x in (ext, code))), dotted)


def classify_errors(events: DataFrame, code: str = "error_code") -> DataFrame:
    """Adds HTTP status, category, whether to try again and whether to block; an unknown code is an internal error."""
    entries = [x for name, status, category in ERRORS for x in (F.lit(name), F.struct(F.lit(status).alias("http"), F.lit(category).alias("category")))]
    table = F.create_map(*entries)
    spec = F.coalesce(F.try_element_at(table, F.col(code)), F.try_element_at(table, F.lit("INTERNAL_ERROR")))
    out = events.withColumn("_s", spec)
    category = F.col("_s.category")
    return out.select(*events.columns, F.col("_s.http").alias("http_status"), category.alias("category"), (category == "SYSTEM_ERROR").alias("retryable"), category.isin("USER_ERROR", "FATAL").alias("should_block"))


def block_tasks(tasks: DataFrame) -> DataFrame:
    """For (status, reason_code): the status after blocking, or why it is refused."""
    may = F.coalesce(F.col("status").isin([a for a, b in TASK_MOVES if b == "blocked"]), F.lit(False))
    error = F.when(~may, "INVALID_STATE_TRANSITION").when(~F.coalesce(F.col("reason_code").isin(BLOCK_REASONS), F.lit(False)), "VALIDATION_ERROR")
    return tasks.select("*", error.alias("error_code"), F.when(error.isNull(), "blocked").otherwise(F.col("status")).alias("next_status"))


def object_key(contract: Column, sha: Column, extension: Column) -> Column:
    return F.concat(F.lit("uploads/"), contract.cast("string"), F.lit("/"), sha, F.lower(extension))


def normalised_key(key: Column) -> Column:
    """A relative key with clean segments; null if it is empty, absolute, has a backslash, a drive or a parent segment."""
    raw = F.trim(key)
    parts = F.filter(F.split(raw, "/"), lambda x: ~x.isin("", "."))
    bad = F.contains(raw, F.lit("\\")) | F.startswith(raw, F.lit("/")) | (F.substr(raw, F.lit(2), F.lit(1)) == ":") | (F.size(parts) == 0) | F.array_contains(parts, "..")
    return F.when(~F.coalesce(bad, F.lit(True)), F.array_join(parts, "/"))
