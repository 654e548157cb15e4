"""Findings from outside: strict JSON check, anchoring of quotes, rule codes, one shape with rule risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIMENSIONS, LEVELS, SUGGESTION_TYPES
from ..functions.text import has_text, occurrences, stripped

RISK_COLUMNS = ["doc_id", "seq", "source", "risk_code", "risk_title", "dimension", "risk_level", "reason", "legal_basis", "original_text", "quote", "paragraph_index", "anchor_method", "related_rule_code"]


def _text(v: str, path: str) -> str:
    return f"variant_get({v}, '{path}', 'string')"


def _type(v: str, path: str) -> str:
    """The strict type of a member: null if it is absent, VOID if it is JSON null."""
    return f"schema_of_variant(variant_get({v}, '{path}', 'variant'))"


def _is_string(v: str, path: str) -> str:
    return f"coalesce({_type(v, path)} = 'STRING', false)"


def _optional(v: str, path: str, check: str) -> str:
    return f"({_type(v, path)} IS NULL OR {_type(v, path)} = 'VOID' OR {check})"


def _one_of(v: str, path: str, values: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in values)
    return f"({_is_string(v, path)} AND {_text(v, path)} IN ({listed}))"


def _integer(v: str, path: str, least: int) -> str:
    return f"(coalesce({_type(v, path)} = 'BIGINT', false) AND try_variant_get({v}, '{path}', 'bigint') >= {least})"


def _context(v: str, path: str) -> str:
    return f"({_type(v, path)} IS NULL OR ({_is_string(v, path)} AND length({_text(v, path)}) <= 30))"


def _finding_check(v: str) -> str:
    filled = lambda p: f"({_is_string(v, p)} AND length({_text(v, p)}) >= 1)"
    suggestion = f"({_one_of(v, '$.suggestion.type', SUGGESTION_TYPES)} AND {_is_string(v, '$.suggestion.text')} AND {_optional(v, '$.suggestion.reason', _is_string(v, '$.suggestion.reason'))})"
    return " AND ".join(
        [
            f"coalesce({_type(v, '$')} LIKE 'OBJECT%', false)",
            _integer(v, "$.clause_index", 0),
            _one_of(v, "$.dimension", DIMENSIONS),
            filled("$.risk_title"),
            _one_of(v, "$.risk_level", LEVELS),
            filled("$.reason"),
            _optional(v, "$.legal_basis", _is_string(v, "$.legal_basis")),
            filled("$.quote"),
            _context(v, "$.context_before"),
            _context(v, "$.context_after"),
            _optional(v, "$.occurrence_hint", _integer(v, "$.occurrence_hint", 1)),
            _optional(v, "$.suggestion", suggestion),
            _optional(v, "$.related_rule_code", _is_string(v, "$.related_rule_code")),
        ]
    )


def guard_json(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``json_status`` (VALID or LLM_SCHEMA_INVALID) and ``findings`` (array of variants, null if invalid).

    White space of any kind and one code fence are stripped, at any line end; the rest must be a JSON object; one
    bad finding fails the whole output; types aren't coerced. An absent ``findings`` is an empty array. Of a key that an
    object repeats the last value counts, as Python's parser has it; that is a setting of the session, which this makes.
    """
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bare = stripped(F.col(text))
    line = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    unfenced = F.regexp_replace(bare, r"(?s)^.*?(?:" + line + r"|\z)", "")
    unfenced = stripped(F.regexp_replace(stripped(unfenced), r"```\z", ""))
    plain = F.when(bare.startswith("```"), unfenced).otherwise(bare)
    parsed = raw.withColumn("_v", F.try_parse_json(plain))
    listed = parsed.withColumn("_f", F.expr(f"CASE WHEN {_type('_v', '$.findings')} IS NULL THEN array() WHEN {_type('_v', '$.findings')} LIKE 'ARRAY%' THEN variant_get(_v, '$.findings', 'array<variant>') END"))
    valid = F.expr(f"coalesce({_type('_v', '$')} LIKE 'OBJECT%', false) AND _f IS NOT NULL AND forall(_f, x -> {_finding_check('x')})")
    checked = listed.withColumn("_ok", valid)
    return checked.select(*raw.columns, F.when(F.col("_ok"), "VALID").otherwise("LLM_SCHEMA_INVALID").alias("json_status"), F.when(F.col("_ok"), F.col("_f")).alias("findings"))


def findings_rows(guarded: DataFrame) -> DataFrame:
    """Valid findings as rows (doc_id, seq, ...)."""
    at = guarded.where("json_status = 'VALID'").select("doc_id", F.posexplode("findings").alias("seq", "v"))
    text = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'string')").alias(name)
    empty = lambda name: F.coalesce(F.expr(f"try_variant_get(v, '$.{name}', 'string')"), F.lit("")).alias(name)
    return at.select("doc_id", "seq", F.expr("try_variant_get(v, '$.clause_index', 'int')").alias("clause_index"), *(text(n) for n in ("dimension", "risk_title", "risk_level", "reason", "legal_basis", "quote")), empty("context_before"), empty("context_after"), text("related_rule_code"))


def locate(findings: DataFrame, placed: DataFrame) -> DataFrame:
    """Findings with their position; those that can't be placed are gone."""
    return resolve(findings, placed).where("paragraph_index IS NOT NULL")


def resolve(findings: DataFrame, placed: DataFrame) -> DataFrame:
    """All findings with their position, null for those that can't be placed.

    ``placed``: paragraphs with ``clause_index``. A quote (with its neighbours, if given) that confirms
    exactly one paragraph of the clause is CLAUSE_SCOPED there; else the clause's first paragraph with
    text stands in (CLAUSE_FALLBACK) and its text becomes the quote.
    """
    f = findings.withColumn("_key", F.concat("context_before", "quote", "context_after"))
    p = placed.select("doc_id", "clause_index", F.col("idx").alias("_idx"), F.col("text").alias("_text"))
    bare = (F.col("context_before") == "") & (F.col("context_after") == "")
    confirmed = (F.col("quote") != "") & F.when(bare, F.contains("_text", F.col("quote"))).otherwise(F.contains("_text", F.col("_key")) & (occurrences(F.col("_text"), F.col("_key")) == 1))
    met = f.join(p, ["doc_id", "clause_index"], "left").withColumn("_hit", confirmed)
    here = F.struct(F.col("_idx").alias("idx"), F.col("_text").alias("text"))
    keys = [c for c in findings.columns if c not in ("doc_id", "seq")]
    found = met.groupBy("doc_id", "seq").agg(
        *(F.first(c).alias(c) for c in keys),
        F.count_if("_hit").alias("_n"),
        F.min_by(here, F.when(F.col("_hit"), F.col("_idx"))).alias("_at"),
        F.min_by(here, F.when(has_text(F.col("_text")), F.col("_idx"))).alias("_first"),
    )
    scoped = F.col("_n") == 1
    at = F.when(scoped, F.col("_at")).otherwise(F.col("_first"))
    out = found.withColumn("_p", at)
    return out.select(
        "doc_id",
        "seq",
        *(c for c in keys if c != "quote"),
        F.when(scoped, F.col("quote")).otherwise(F.col("_p.text")).alias("quote"),
        F.col("_p.idx").alias("paragraph_index"),
        F.col("_p.text").alias("original_text"),
        F.when(scoped, "CLAUSE_SCOPED").when(F.col("_p").isNotNull(), "CLAUSE_FALLBACK").alias("anchor_method"),
    )


def check_related(located: DataFrame, known_codes: list[str]) -> DataFrame:
    """A related rule code that the snapshot doesn't have is cleared; the finding stays."""
    return located.withColumn("related_rule_code", F.when(F.col("related_rule_code").isin(known_codes), F.col("related_rule_code")))


#: What a finding's number begins with: more than a rule risk's, which is a 32-bit integer, can be.
AFTER_RULES = 1 << 31


def unify(rule_risks: DataFrame, located: DataFrame) -> DataFrame:
    """Rule risks and findings in one shape; rule risks come first."""
    null = F.lit(None).cast("string")
    rules = rule_risks.withColumns({"source": F.lit("RULE"), "anchor_method": null, "related_rule_code": null}).withColumn("seq", F.col("seq").cast("long"))
    models = located.withColumns({"source": F.lit("LLM"), "risk_code": null}).withColumn("seq", F.col("seq").cast("long") + AFTER_RULES)
    return rules.select(RISK_COLUMNS).unionByName(models.select(RISK_COLUMNS))
