"""Clauses: numbering mode, segmentation, type and title, with one shuffle by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CLAUSE_TYPE_WORDS, NUMBERING_MODES, NUMBERING_SIGNS, OTHER, PARAGRAPH, TABLE_ROW
from ..functions.text import contains_any, ordered_text, stripped, unicode_pattern


def clause_type(heading: Column) -> Column:
    """The first type of the table with a word in the heading, else OTHER."""
    name, words = CLAUSE_TYPE_WORDS[0]
    out = F.when(contains_any(heading, words), name)
    for name, words in CLAUSE_TYPE_WORDS[1:]:
        out = out.when(contains_any(heading, words), name)
    return out.otherwise(OTHER)


def _number(name: str, pattern: str) -> Column:
    """The number that opens a numbered paragraph of this mode; empty or null for all others. A text without the mode's signs isn't looked at."""
    return F.when((F.col("block_type") == PARAGRAPH) & contains_any(F.col("text"), NUMBERING_SIGNS[name]), F.regexp_extract("text", unicode_pattern(pattern), 0))


def _mode(hits: list[Column]) -> Column:
    out = None
    for (name, _, least), n in zip(NUMBERING_MODES, hits):
        out = F.when(n >= least, name) if out is None else out.when(n >= least, name)
    return out


def numbering_mode(paragraphs: DataFrame) -> DataFrame:
    """The first mode with enough numbered paragraphs (table rows don't count); null if none has."""
    hits = [F.count_if(_number(name, p) != "") for name, p, _ in NUMBERING_MODES]
    counted = paragraphs.groupBy("doc_id").agg(*(h.alias(f"n_{name.lower()}") for (name, _, _), h in zip(NUMBERING_MODES, hits)))
    return counted.withColumn("mode", _mode([F.col(f"n_{name.lower()}") for name, _, _ in NUMBERING_MODES]))


def with_places(paragraphs: DataFrame) -> DataFrame:
    """``with_clauses``, and of each paragraph: the ``nth`` it is, from 1; its ``number``, which opens a clause, as does the first; ``run``, how many paragraphs that are no table rows there were up to it."""
    placed = W.partitionBy("doc_id").orderBy("idx")  # one sort for both
    whole, ordered = placed.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), placed.rowsBetween(W.unboundedPreceding, 0)
    # what is grouped by document goes on in that order, without hashing or another sort
    paragraphs.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    # the JVM interprets methods of more than 8000 bytes; expressions whose code is longer are split into smaller ones instead
    paragraphs.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    flagged = paragraphs.withColumns({f"_{name}": _number(name, p) for name, p, _ in NUMBERING_MODES})
    mode = _mode([F.count_if(F.col(f"_{name}") != "").over(whole) for name, _, _ in NUMBERING_MODES])
    flagged = flagged.withColumn("_mode", mode)
    number = None
    for name, _, _ in NUMBERING_MODES:
        hit = (F.col("_mode") == name) & (F.col(f"_{name}") != "")
        number = F.when(hit, F.col(f"_{name}")) if number is None else number.when(hit, F.col(f"_{name}"))
    flagged = flagged.withColumn("_no", number)
    opened = F.count("_no").over(ordered)
    first = F.first(F.col("_no").isNotNull()).over(ordered)
    last = lambda c: F.last(c, ignorenulls=True).over(ordered)
    heading = lambda c: last(F.when(F.col("_no").isNotNull(), c))
    return flagged.select(
        *paragraphs.columns,
        (opened - F.when(first, 1).otherwise(0)).cast("int").alias("clause_index"),
        last("_no").alias("clause_no"),
        heading(F.col("text")).alias("heading"),
        # words are looked for once a clause, in its heading
        F.coalesce(heading(clause_type(F.col("text"))), F.lit(OTHER)).alias("clause_type"),
        F.count(F.lit(1)).over(ordered).cast("int").alias("nth"),
        F.col("_no").alias("number"),
        F.count(F.when(F.col("block_type") != TABLE_ROW, 1)).over(ordered).alias("run"),
    )


def with_clauses(paragraphs: DataFrame) -> DataFrame:
    """Adds ``clause_index``, ``clause_no``, ``clause_type`` and ``heading`` to each paragraph.

    What precedes the first numbered paragraph is a clause of its own, without number and of type OTHER,
    as is a document without a mode.
    """
    return with_places(paragraphs).select(*paragraphs.columns, "clause_index", "clause_no", "heading", "clause_type")


def _title(number: str, heading: str) -> Column:
    title = stripped(F.substr(heading, F.length(number) + 1))
    return F.nullif(title, F.lit(""))


def clause_aggregates() -> list[Column]:
    """The aggregates by document that ``with_clause_array`` reads, of rows of ``with_places``; bounded by one document.

    What a clause has once is taken from the paragraph that opens it, while paragraphs are rows: functions on arrays are evaluated node by node.
    """
    opening = F.when((F.col("nth") == 1) | F.col("number").isNotNull(), F.struct("nth", "clause_index", F.col("number").alias("clause_no"), _title("number", "text").alias("title"), "clause_type"))
    return [F.sort_array(F.collect_list(F.struct("nth", "idx", "text"))).alias("_ps"), F.sort_array(F.collect_list(opening)).alias("_opens")]


def with_clause_array(docs: DataFrame) -> DataFrame:
    """Adds ``clauses`` in order to rows of documents with ``clause_aggregates``."""

    def clause(o: Column, n: Column) -> Column:
        after = F.coalesce(F.get("_opens", n + 1)["nth"], F.size("_ps") + 1)
        return F.struct(
            o["clause_index"].alias("clause_index"),
            o["clause_no"].alias("clause_no"),
            o["title"].alias("title"),
            o["clause_type"].alias("clause_type"),
            F.get("_ps", o["nth"] - 1)["idx"].alias("start_idx"),
            F.get("_ps", after - 2)["idx"].alias("end_idx"),
            F.array_join(F.slice(F.col("_ps")["text"], o["nth"], after - o["nth"]), "\n").alias("text"),
            F.lit("RULE").alias("extract_method"),
        )

    return docs.withColumn("clauses", F.transform("_opens", clause))


def segment_clauses(paragraphs: DataFrame) -> DataFrame:
    """One row a clause: number, title, type, first and last paragraph, text."""
    return (
        with_clauses(paragraphs)
        .groupBy("doc_id", "clause_index")
        .agg(
            F.first("clause_no").alias("clause_no"),
            F.first("heading").alias("heading"),
            F.first("clause_type").alias("clause_type"),
            F.min("idx").alias("start_idx"),
            F.max("idx").alias("end_idx"),
            ordered_text("idx", "text").alias("text"),
        )
        .select("doc_id", "clause_index", "clause_no", _title("clause_no", "heading").alias("title"), "clause_type", "start_idx", "end_idx", "text", F.lit("RULE").alias("extract_method"))
    )
