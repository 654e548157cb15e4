"""Documents to paragraphs, and what follows from a paragraph's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import PARAGRAPH
from ..functions.text import has_text, normalised


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, block_type, text): a line is a paragraph, empty ones are kept. A null text has none."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("idx", "text")).select("doc_id", "idx", F.lit(PARAGRAPH).alias("block_type"), "text")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, idx, block_type, text) from the h1, p and li elements of a page, tags inside dropped."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:h1|p|li)\b[^>]*>(.*?)</(?:h1|p|li)>"), F.lit(1))
    plain = F.transform(found, lambda x: normalised(F.regexp_replace(x, r"(?s)<[^>]*>", "")))
    return pages.select(F.col(key).alias("doc_id"), F.posexplode(plain).alias("idx", "text")).select("doc_id", "idx", F.lit(PARAGRAPH).alias("block_type"), "text")


def normalise_paragraphs(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("text", normalised(F.col("text")))


def block_offsets(paragraphs: DataFrame) -> DataFrame:
    """Adds ``char_start`` and ``char_end``: the paragraph's code points in the document's text (lines joined by line feeds)."""
    before = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return paragraphs.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def parse_status(paragraphs: DataFrame) -> DataFrame:
    """PARSED if a paragraph has text, else EMPTY."""
    has = F.max(has_text(F.col("text")))
    return paragraphs.groupBy("doc_id").agg(F.when(has, "PARSED").otherwise("EMPTY").alias("status"), F.count("*").alias("n_paragraphs"))
