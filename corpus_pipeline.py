"""A pipeline over the documents table: language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before; all but the last return
the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm import languages, neardup, packing, substrings
from clausegrid.llm._common import delete_unread, fresh_name, owned, stored, table

#: A document of which fewer n-grams than this share belong to its best language is in none that was learned.
LEAST_LANGUAGE_SCORE = 0.2
#: So is one that scores less, for its length, than all but this share of its language's labelled documents.
LOWEST = 0.001


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tidy(stage: Stage) -> Stage:
    """``stage``, which deletes at its end the tables that it has stored and its result doesn't read; no other table is touched."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned() as made:
            out = stage(spark, docs, sf_dir)
            delete_unread(made, out)
        return out

    return run


@_tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; rejects those without letters or in no learned language.

    So null and empty texts go, and all documents where none is labelled. Repeated rows share their fate; other columns pass
    unchanged, whatever their names; no rows give no rows.
    """
    return languages.keep_known(docs, languages.learn(docs), LOWEST, LEAST_LANGUAGE_SCORE)


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the document of the smallest doc_id of each group stays.

    Null texts and texts without words resemble nothing and stay. Rows that repeat the kept doc_id and rows with a null one
    stay too. Other columns pass unchanged; no rows give no rows.
    """
    return neardup.keep_one(docs, k=5, percent=80)


@_tidy
def drop_repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, and runs of 20 words or more in sentences, that an earlier document (or place) has go; ``n_chars`` follows the text.

    A null text stays null, and a text may become empty; no row goes. Rows that repeat (doc_id, text) get one result. Other
    columns pass unchanged; no rows give no rows.
    """
    removed = fresh_name(docs.columns, "removed")
    out = substrings.dedup_units(docs, unit="line", passages=20, removed=removed).drop(removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@_tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence. A null or empty text is its end token alone; repeated rows are packed each; no rows give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_units),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each one's rows replace those of the one before; the last one's table stays for the result, which reads it when it runs."""
    docs = table(spark, sf_dir, "documents")
    left: list[str] = []  # this run's own tables
    for name, stage in STAGES[:-1]:
        with owned() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        left += made
        delete_unread(left, docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising and packing have no SQL form; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None
