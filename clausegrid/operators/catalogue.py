"""Catalogues and what is exchanged about documents: snapshots, convergent seeds, bindings, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .paragraphs import block_offsets


#: What a rule of a snapshot must have, each a text that isn't empty.
RULE_TEXTS = ["rule_code", "rule_name", "dimension", "rule_type", "severity"]


def check_snapshots(sets: DataFrame) -> DataFrame:
    """(contract_type, version, n_rules, verdict): a set without rules is fine, rules without a set, a set without a version, or one malformed rule fail the whole snapshot.

    ``sets``: one row a contract type and rule (contract_type, set_id, version, rule_id and what rules have), or a null rule_id without rules.
    Of ``RULE_TEXTS`` the columns that are there are checked, and ``expression``, which must be a JSON object.
    """
    missing = [F.coalesce(F.col(c), F.lit("")) == "" for c in RULE_TEXTS if c in sets.columns]
    if "expression" in sets.columns:
        missing.append(~F.coalesce(F.expr("schema_of_variant(try_parse_json(expression)) LIKE 'OBJECT%'"), F.lit(False)))
    bad = F.lit(False)
    for m in missing:
        bad = bad | m
    grouped = sets.groupBy("contract_type").agg(F.max("set_id").alias("set_id"), F.max("version").alias("version"), F.count("rule_id").alias("n_rules"), F.count_if(F.col("rule_id").isNotNull() & bad).alias("bad"))
    verdict = F.when(F.col("set_id").isNotNull() & (F.coalesce("version", F.lit("")) == ""), "VERSION_MISSING").when(F.col("set_id").isNull() & (F.col("n_rules") > 0), "RULES_WITHOUT_SET").when(F.col("bad") > 0, "MALFORMED_RULE").otherwise("OK")
    return grouped.select("contract_type", "version", "n_rules", verdict.alias("verdict"))


def converge(existing: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): INSERT, UPDATE, KEEP or DELETE, so that afterwards exactly ``wanted`` is there."""
    a = existing.select(key, F.struct(*columns).alias("_old"), F.lit(True).alias("_a"))
    b = wanted.select(key, F.struct(*columns).alias("_new"), F.lit(True).alias("_b"))
    action = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "DELETE").when(F.col("_old").eqNullSafe(F.col("_new")), "KEEP").otherwise("UPDATE")
    return a.join(b, key, "full").select(key, action.alias("action"))


def bind_by_digest(instances: DataFrame, contracts: DataFrame) -> DataFrame:
    """Instances (instance_no, sample_sha256, contract_id) bound to the smallest contract of the same content, unless they are bound already."""
    first = contracts.groupBy("sha256").agg(F.min("contract_id").alias("_found"))
    met = instances.join(first, instances["sample_sha256"] == first["sha256"], "left")
    return met.select("instance_no", F.coalesce("contract_id", "_found").alias("contract_id"), (F.col("contract_id").isNull() & F.col("_found").isNotNull()).alias("newly_bound"))


def approvals_of_tasks(tasks: DataFrame, contracts: DataFrame, instances: DataFrame) -> DataFrame:
    """Tasks with the approval instance of their contract, or WRITEBACK_APPROVAL_NOT_READY."""
    met = tasks.join(contracts.select("contract_id", "instance_id"), "contract_id", "left").join(instances.select("instance_id", "instance_no"), "instance_id", "left")
    return met.select("task_id", "contract_id", "instance_no", F.when(F.col("instance_no").isNull(), "WRITEBACK_APPROVAL_NOT_READY").alias("error_code"))


def document_batch(paragraphs: DataFrame) -> DataFrame:
    """Blocks as they are handed over: order, offsets in the block and in the document."""
    placed = block_offsets(paragraphs)
    return placed.select("doc_id", F.col("idx").alias("order_index"), "block_type", "text", F.lit(0).alias("char_start_in_block"), F.length("text").alias("char_end_in_block"), F.col("char_start").alias("char_start_global"), F.col("char_end").alias("char_end_global"))


def batch_violations(blocks: DataFrame, clauses: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc_id, ...) counts of what makes a batch unfit: repeated order, dangling or inverted references, offsets that end before they begin.

    Blocks and references become rows of one shape by (doc_id, place), so that one aggregation tells a reference without a block.
    """
    if "char_start_in_block" in blocks.columns:
        backward = (F.col("char_end_in_block") < F.col("char_start_in_block")) | (F.col("char_end_global") < F.col("char_start_global"))
    else:
        backward = F.lit(False)
    names = ("blocks", "ends", "sources", "inverted", "backward")
    row = lambda place, **n: [F.col("doc_id"), place.cast("int").alias("place"), *(F.coalesce(n.get(x, F.lit(0)).cast("long"), F.lit(0)).alias(x) for x in names)]
    one = F.lit(1)
    rows = blocks.select(*row(F.col("order_index"), blocks=one, backward=backward))
    ends = clauses.select("doc_id", F.posexplode(F.array("start_idx", "end_idx")).alias("_n", "_i"), (F.col("end_idx") < F.col("start_idx")).alias("_less"))
    rows = rows.unionByName(ends.select(*row(F.col("_i"), ends=one, inverted=F.col("_less") & (F.col("_n") == 0))))
    rows = rows.unionByName(metadata.select(*row(F.col("idx"), sources=one)))
    places = rows.groupBy("doc_id", "place").agg(*(F.sum(x).alias(x) for x in names))
    nowhere = lambda x: F.sum(F.when(F.col("blocks") == 0, F.col(x)).otherwise(0))
    return places.groupBy("doc_id").agg(
        F.count_if(F.col("blocks") > 1).alias("repeated_order"),
        F.sum("inverted").alias("inverted_clauses"),
        F.sum("backward").alias("inverted_offsets"),
        nowhere("ends").alias("dangling_clauses"),
        nowhere("sources").alias("dangling_metadata"),
    )


def risk_payload(risks: DataFrame) -> DataFrame:
    """Risks as they are handed over: the quote goes as the original text, the claimed rule stays behind."""
    return risks.select("doc_id", "seq", "risk_code", "risk_title", "dimension", "risk_level", "source", "reason", "legal_basis", F.col("quote").alias("original_text"), "paragraph_index", "anchor_method")


def persist_risks(tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Risks that get stored: their task's gate is open and no risk of the task is refused; they start as PENDING.

    ``tasks``: (doc_id, risk_gate); ``resolved``: risks with clause_index, ambiguous, rule_id, batch_error, risk_level.
    """
    levels = F.max(F.coalesce(~F.col("risk_level").isin("HIGH", "MEDIUM", "LOW"), F.lit(True))).over(W.partitionBy("doc_id"))
    refused = F.max(F.col("ambiguous") | F.col("batch_error").isNotNull()).over(W.partitionBy("doc_id"))
    checked = resolved.withColumn("_r", refused | levels).where("NOT _r").drop("_r")
    return checked.join(tasks.where("risk_gate = 'OK'").select("doc_id"), "doc_id").withColumn("review_status", F.lit("PENDING"))


def evaluation_metrics(evaluations: DataFrame) -> DataFrame:
    """How often each rule matched, didn't match or couldn't be evaluated."""
    n = lambda s: F.count_if(F.col("status") == s)
    return evaluations.groupBy("rule_code").agg(n("MATCHED").alias("matched"), n("NOT_MATCHED").alias("not_matched"), n("EVALUATION_FAILED").alias("failed"), F.sum("n_risks").cast("long").alias("n_risks"))


def merge_metrics(merged: DataFrame) -> DataFrame:
    """Documents' merged risks counted by source, over the whole corpus."""
    return merged.groupBy("source").agg(F.count("*").alias("n_risks"), F.countDistinct("doc_id").alias("n_documents"))


def anchor_metrics(resolved: DataFrame) -> DataFrame:
    """One row over all findings with their places (``findings.resolve``): findings, those placed, those dropped, those placed by their clause alone. One pass."""
    n, placed = F.count("*"), F.count("paragraph_index")
    return resolved.agg(n.alias("findings"), placed.alias("resolved"), (n - placed).alias("dropped"), F.count_if(F.col("anchor_method") == "CLAUSE_FALLBACK").alias("fallback"))
