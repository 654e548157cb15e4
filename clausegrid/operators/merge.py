"""Merging of risks that are the same: by rule, by title, and one rule with one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import LEVELS
from ..functions.text import without_spaces_folded
from .findings import RISK_COLUMNS

#: Risks that a task takes, roughly: their columns repeat and compress well, so that partitions by their shuffled size would be too large.
RISKS_A_TASK = 250_000


def _rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in reversed(LEVELS))), level)


def merge_risks(risks: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each unit, ordered by ``seq`` (its first member).

    Rule risks unite by (code, paragraph, dimension), findings by (title without spaces and case,
    paragraph, dimension). A unit of findings joins a rule unit if it claims that rule only and the rule
    is claimed by it only. Rows that are merged already stay as they are. The first rule risk (else the
    first row) is the anchor: its fields win, gaps are filled in order, the level is the highest known. ``tasks``: into how many partitions a
    table of many risks is dealt by document; without it Spark goes by their shuffled size.
    """
    kind = F.col("source")
    own = F.struct(
        F.when(kind == "RULE", "RULE").when(kind == "LLM", "LLM").otherwise("MERGED").alias("kind"),
        F.when(kind == "RULE", F.col("risk_code")).when(kind == "LLM", without_spaces_folded(F.col("risk_title"))).otherwise(F.col("seq").cast("string")).alias("name"),
        F.col("paragraph_index").alias("paragraph"),
        F.col("dimension").alias("dimension"),
    )
    keyed = risks.withColumn("unit", own)
    named = F.struct(F.lit("RULE").alias("kind"), F.col("related_rule_code").alias("name"), F.col("paragraph_index").alias("paragraph"), F.col("dimension").alias("dimension"))
    claims = (kind == "LLM") & F.col("related_rule_code").isNotNull() & F.col("doc_id").isNotNull()
    # windows on one partitioning by document, as claims and rule units are as many as the risks: a join might broadcast them
    dealt = (keyed.repartition(tasks, "doc_id") if tasks else keyed.repartition("doc_id")).withColumn("_rule", F.when(kind == "RULE", F.col("unit")).when(claims, named))
    met, own_rows = W.partitionBy("doc_id", "_rule"), W.partitionBy("doc_id", "unit")
    claimant = F.when(claims, F.col("unit"))
    single = F.min(claimant).over(met).eqNullSafe(F.max(claimant).over(met))
    claimed = dealt.withColumns({"_there": F.max(F.coalesce(kind == "RULE", F.lit(False))).over(met), "_single": single})
    valid = claims & F.col("_there")
    target = F.when(valid, F.col("_rule"))
    lone = F.min(target).over(own_rows).eqNullSafe(F.max(target).over(own_rows)) & F.coalesce(F.bool_and(F.when(valid, F.col("_single"))).over(own_rows), F.lit(False))
    united = claimed.withColumns({"_lone": lone, "_target": F.min(target).over(own_rows)}).withColumn("unit", F.when(F.col("_lone"), F.col("_target")).otherwise(F.col("unit")))

    order = F.struct((F.col("source") != "RULE").alias("later"), F.col("seq").alias("seq"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), *(F.col(c) for c in RISK_COLUMNS if c != "doc_id"))))
    groups = united.groupBy("doc_id", "unit").agg(rows.alias("rows"), F.min("seq").alias("first_seq"))  # a unit is the copies of one risk in one paragraph
    anchor = F.get("rows", F.lit(0))
    filled = lambda c: F.get(F.filter(F.transform("rows", lambda r: r[c]), lambda x: x.isNotNull()), F.lit(0)).alias(c)
    both = F.exists("rows", lambda r: r["source"] == "RULE") & F.exists("rows", lambda r: r["source"] == "LLM")
    ranks = F.array_max(F.transform("rows", lambda r: _rank(r["risk_level"])))
    level = F.when(_rank(anchor["risk_level"]) == 0, anchor["risk_level"]).otherwise(F.get(F.array(*(F.lit(x) for x in reversed(LEVELS))), (ranks - 1).cast("int")))
    taken = lambda c: anchor[c].alias(c)
    return groups.select(
        "doc_id",
        F.col("first_seq").alias("seq"),
        F.when(both, "RULE+LLM").otherwise(anchor["source"]).alias("source"),
        filled("risk_code"),
        taken("risk_title"),
        taken("dimension"),
        level.alias("risk_level"),
        taken("reason"),
        filled("legal_basis"),
        taken("original_text"),
        taken("quote"),
        taken("paragraph_index"),
        filled("anchor_method"),
        filled("related_rule_code"),
    )
