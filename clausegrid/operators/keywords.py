"""Topic words in paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LEXICON
from ..functions.terms import term_scan

#: Terms that are looked for one by one; a larger lexicon is one scan. Both give the same rows.
EXPRESSIONS = 64


def keyword_hits(paragraphs: DataFrame, lexicon: list[str] = LEXICON) -> DataFrame:
    """(doc_id, idx, ord, term): each term of the lexicon in each paragraph that contains it, table rows too."""
    if len(lexicon) > EXPRESSIONS:
        found = term_scan(paragraphs.sparkSession, lexicon)("text")
    else:
        found = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.struct(F.lit(i).alias("ord"), F.lit(t).alias("term"))) for i, t in enumerate(lexicon))))
    return paragraphs.select("doc_id", "idx", F.explode(found).alias("hit")).select("doc_id", "idx", "hit.ord", "hit.term")


def distinct_terms(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_hits"))
