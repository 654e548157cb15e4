"""Deleting only what nothing refers to: orphan contracts and stored objects, by mark and sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def orphan_contracts(candidates: DataFrame, contracts: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(contract_id, outcome) of contracts that a failed ingest may have left: ``deleted``, or the first reason to keep one.

    In this order: it isn't there, it has a current task, a file refers to it, a task refers to it. Candidates that repeat are one row; a null one isn't there.
    """
    mark = lambda df, name: df.select("contract_id").where("contract_id IS NOT NULL").distinct().withColumn(name, F.lit(True))
    known = contracts.select("contract_id", F.col("current_task_id").isNotNull().alias("_linked"), F.lit(True).alias("_there"))
    met = candidates.select("contract_id").distinct().join(known, "contract_id", "left").join(mark(files, "_file"), "contract_id", "left").join(mark(tasks, "_task"), "contract_id", "left")
    outcome = F.when(F.col("_there").isNull(), "skipped_not_found").when(F.col("_linked"), "skipped_task_link_present").when(F.col("_file"), "skipped_file_exists").when(F.col("_task"), "skipped_task_exists").otherwise("deleted")
    return met.select("contract_id", outcome.alias("outcome"))


def swept(contracts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The contracts that stay."""
    return contracts.join(outcomes.where("outcome = 'deleted'").select("contract_id"), "contract_id", "left_anti")


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(storage_key, length, modified) of all objects below ``root``; their content isn't read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return listed.select(F.substring_index("path", f"{base}/", -1).alias("storage_key"), "length", "modified")


def object_outcomes(objects: DataFrame, references: DataFrame, before: Column) -> DataFrame:
    """(storage_key, outcome): ``orphan`` if no reference names it and it is older than ``before``; ``referenced`` or ``too_new`` else; ``missing`` if only a reference knows it."""
    named = references.select("storage_key").where("storage_key IS NOT NULL").distinct().withColumn("_named", F.lit(True))
    met = objects.select("storage_key", (F.col("modified") < before).alias("_old")).join(named, "storage_key", "full")
    outcome = F.when(F.col("_old").isNull(), "missing").when(F.col("_named"), "referenced").when(F.col("_old"), "orphan").otherwise("too_new")
    return met.select("storage_key", outcome.alias("outcome"))
