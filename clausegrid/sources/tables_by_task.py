"""Dossiers as tables bucketed by task: a task is read from one bucket, tables meet without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossier

#: Rows that a bucket's file should have, roughly; their number follows from the corpus.
ROWS_A_BUCKET = 1_000_000
PARTS = ("clauses", "risks", "metadata")


def write(docs: DataFrame, name: str) -> int:
    """Write ``docs`` (dossiers as stored) as the tables ``name``_clauses, _risks and _metadata of the session's catalogue; the number of buckets.

    ``docs`` is read four times, so it had better be a table.
    """
    frames = {"clauses": dossier.clauses_of(docs), "risks": dossier.risks_of(docs), "metadata": dossier.metadata_of(docs)}
    buckets = 1 + (docs.agg(F.sum(F.size("clauses") + F.size("risks"))).first()[0] or 0) // ROWS_A_BUCKET
    for part, frame in frames.items():
        frame.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(f"{name}_{part}")
    return buckets


def read(spark: SparkSession, name: str, part: str) -> DataFrame:
    return spark.table(f"{name}_{part}")


def of_task(spark: SparkSession, name: str, task_id: int) -> dict[str, DataFrame]:
    """A task's rows of each part; the scan takes the one bucket that may have them."""
    return {part: read(spark, name, part).where(F.col("doc_id") == task_id) for part in PARTS}


def risks_with_clauses(spark: SparkSession, name: str) -> DataFrame:
    """(doc_id, seq, risk_code, clause_id, clause_no, clause_type): stored risks with the clause that their id names, both sides as they lie."""
    own = read(spark, name, "clauses").groupBy("doc_id").agg(F.collect_list(F.struct("clause_id", "clause_no", "clause_type")).alias("_c"))  # bounded by a document
    met = read(spark, name, "risks").join(own.hint("merge"), "doc_id", "left")  # by the bucket's column alone, so neither side moves
    found = F.get(F.filter("_c", lambda c: c["clause_id"] == F.col("clause_id")), F.lit(0))
    return met.select("doc_id", "seq", "risk_code", "clause_id", found["clause_no"].alias("clause_no"), found["clause_type"].alias("clause_type"))
