"""Contract metadata by patterns: the first paragraph that has a field gives it.

All fields but the payment terms come from one aggregation by document; ``min_by`` over the paragraph's
place keeps the first match and combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import AMOUNT, CREDIT_CODE, CURRENCIES, EFFECTIVE_DATE, EXPIRE_DATE, METADATA_FIELDS, PARAGRAPH, PARTY, PERCENT, SIGN_DATE, TABLE_ROW
from ..functions.text import contains_any, ordered_text, stripped, unicode_pattern


def _group(pattern: str, n: int) -> Column:
    return F.regexp_extract("text", unicode_pattern(pattern), n)


def _first(hit: Column, value: Column, quote: Column) -> Column:
    """The struct of the first row with ``hit``, which is a pattern behind a cheap test, so that patterns run on few rows.

    The test is a ``when``: both sides of an AND are evaluated ahead where they repeat.
    """
    found = F.when(hit, F.struct(value.alias("value"), F.col("idx").alias("idx"), quote.alias("quote")))
    return F.min_by(found, F.when(hit, F.col("idx")))


def _has(*words: str) -> Column:
    """A text without any of these words can't match the pattern that follows."""
    return contains_any(F.col("text"), list(words))


def _party(role: str) -> Column:
    """The name behind a role that opens the paragraph."""
    return F.when((F.col("block_type") == PARAGRAPH) & F.startswith("text", F.lit(role)), stripped(_group(PARTY, 2)))


def _amount() -> Column:
    raw = F.concat(*(_group(AMOUNT, n) for n in (1, 2, 3)))  # one of them, the others are empty
    # each sign of the pattern is or has one of these
    return F.when(_has("元", "¥", "币", "￥", "$", "€"), F.bround(F.replace(raw, F.lit(","), F.lit("")).try_cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"))


def _year(pattern: str, *words: str) -> Column:
    year = F.when(_has(*words), _group(pattern, 1))
    return F.when(_has("期"), year) if all("期" in w for w in words) else year


def _date(pattern: str, year: Column) -> tuple[Column, Column, Column]:
    return year != "", F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(_group(pattern, 2), 2, "0"), F.lpad(_group(pattern, 3), 2, "0")), _group(pattern, 0)


def _ratio(n: Column) -> tuple[Column, Column, Column]:
    share = (n.try_cast("decimal(30,10)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,14)").cast("string")
    return n != "", F.regexp_replace(F.regexp_replace(share, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.col("text")


def _currency(text: Column) -> Column:
    out = None
    for code, tokens in CURRENCIES:
        out = F.when(contains_any(text, tokens), code) if out is None else out.when(contains_any(text, tokens), code)
    return out


def has_percentage() -> Column:
    return F.contains("text", F.lit("%")) | F.contains("text", F.lit("百分之"))


def with_units(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with the place where their unit begins: a paragraph, or a run of table rows."""
    ordered = W.partitionBy("doc_id").orderBy("idx")
    opens = (F.col("block_type") != TABLE_ROW) | F.coalesce(F.lag("block_type").over(ordered) != TABLE_ROW, F.lit(True))
    return paragraphs.withColumn("_start", F.max(F.when(opens, F.col("idx"))).over(ordered.rowsBetween(W.unboundedPreceding, 0)))


def payment_terms(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, value, idx): the first content with a percentage; a table row brings its whole run of rows."""
    # a paragraph is a unit of its own, so one without a percentage can go before the grouping
    kept = with_units(paragraphs).where((F.col("block_type") == TABLE_ROW) | has_percentage())
    units = kept.groupBy("doc_id", "_start").agg(F.min(F.when(has_percentage(), F.col("idx"))).alias("hit"), ordered_text("idx", "text").alias("value"))
    return units.where("hit IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("value", F.col("_start").alias("idx")), "hit").alias("m")).select("doc_id", "m.value", "m.idx")


def field_names() -> list[str]:
    """The fields of ``field_aggregates``: all but the payment terms."""
    return [key for key, _, _ in METADATA_FIELDS if key != "payment_terms"]


def _probes() -> dict[str, Column]:
    """What tells by itself whether a paragraph has a field: null or empty unless it has."""
    return {
        "our_party_name": _party("甲方"),
        "counterparty_name": _party("乙方"),
        "credit_code": F.when(_has("统一社会信用代码"), _group(CREDIT_CODE, 1)),
        "contract_amount": _amount(),
        "sign_date": _year(SIGN_DATE, "签订日期", "签署日期", "签约日期"),
        "effective_date": _year(EFFECTIVE_DATE, "起生效"),
        "expire_date": _year(EXPIRE_DATE, "有效期至", "到期日", "终止日期"),
        "prepay_ratio": F.when((F.col("block_type") == TABLE_ROW) & F.contains("text", F.lit("预付")), _group(PERCENT, 1)),
    }


def _found(probes: dict[str, Column]) -> dict[str, tuple[Column, Column, Column]]:
    """(whether a paragraph has it, value, quote) of each field."""
    plain = lambda key, quote: (probes[key] != "", probes[key], quote)
    return {
        "our_party_name": plain("our_party_name", F.col("text")),
        "counterparty_name": plain("counterparty_name", F.col("text")),
        "credit_code": plain("credit_code", _group(CREDIT_CODE, 0)),
        "contract_amount": plain("contract_amount", _group(AMOUNT, 0)),
        "currency": (probes["contract_amount"] != "", _currency(F.col("text")), F.col("text")),
        "sign_date": _date(SIGN_DATE, probes["sign_date"]),
        "effective_date": _date(EFFECTIVE_DATE, probes["effective_date"]),
        "expire_date": _date(EXPIRE_DATE, probes["expire_date"]),
        "prepay_ratio": _ratio(probes["prepay_ratio"]),
    }


def field_aggregates() -> list[Column]:
    """The aggregates by document that give ``wide_metadata``."""
    return [_first(*f).alias(key) for key, f in _found(_probes()).items()]


def with_fields(paragraphs: DataFrame) -> DataFrame:
    """Adds ``fields``: what a paragraph gives of each field, as one struct; null, and so not collected, where it gives none.

    Probes are columns, so each pattern that decides runs once a paragraph.
    """
    probes = {key: F.col(f"_{key}") for key in _probes()}
    given = {key: F.when(hit, F.struct(value.alias("value"), F.col("idx").alias("idx"), quote.alias("quote"))) for key, (hit, value, quote) in _found(probes).items()}
    some = F.lit(False)
    for p in probes.values():
        some = some | (p != "")
    out = paragraphs.withColumns({f"_{key}": p for key, p in _probes().items()})
    return out.withColumn("fields", F.when(some, F.struct("idx", *(c.alias(key) for key, c in given.items())))).drop(*(f"_{key}" for key in probes))


def first_fields(found: str) -> dict[str, Column]:
    """The fields of ``wide_metadata`` from a document's array of ``fields`` in the order of ``idx``."""

    def first(key: str) -> Column:
        return F.get(F.filter(found, lambda x: x[key].isNotNull()), F.lit(0))[key]

    return {key: first(key) for key in field_names()}


def known_currency(wide: DataFrame) -> DataFrame:
    return wide.withColumn("currency", F.when(F.col("currency.value").isNotNull(), F.col("currency")))


def wide_metadata(paragraphs: DataFrame) -> DataFrame:
    """One row a document with a struct (value, idx, quote) a field, but for the payment terms."""
    return known_currency(paragraphs.groupBy("doc_id").agg(*field_aggregates()))


def fields(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (doc_id, ord, field_key, field_label, field_value, value_type, idx, quote) of the fields that were found."""
    entry = lambda n, key, label, kind: F.struct(F.lit(n).alias("ord"), F.lit(key).alias("field_key"), F.lit(label).alias("field_label"), F.col(f"{key}.value").alias("field_value"), F.lit(kind).alias("value_type"), F.col(f"{key}.idx").alias("idx"), F.col(f"{key}.quote").alias("quote"))
    rows = F.array(*(entry(n, *f) for n, f in enumerate(METADATA_FIELDS) if f[0] in keys))
    return wide.select("doc_id", F.explode(F.filter(rows, lambda r: r["idx"].isNotNull())).alias("f")).select("doc_id", "f.*")


def extract_metadata(paragraphs: DataFrame) -> DataFrame:
    """All fields in catalogue order (``ord``); an absent field has no row. One pass: by unit, then by document."""
    units = with_units(paragraphs).groupBy("doc_id", "_start").agg(F.min(F.when(has_percentage(), F.col("idx"))).alias("_hit"), ordered_text("idx", "text").alias("_text"), *field_aggregates())
    terms = F.struct(F.col("_text").alias("value"), F.col("_start").alias("idx"), F.col("_text").alias("quote"))
    wide = units.groupBy("doc_id").agg(F.min_by(terms, "_hit").alias("payment_terms"), *(F.min_by(c, F.col(c)["idx"]).alias(c) for c in field_names()))
    return fields(known_currency(wide), [key for key, _, _ in METADATA_FIELDS]).withColumn("extract_method", F.lit("REGEX"))
