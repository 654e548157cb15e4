"""Rules as data: validation, keyword / regex / threshold evaluation and the three-state verdict.

The rule catalogue is small (its size is checked): it is read and validated on the driver. The plan has the
same size for any number of rules: a few rules that look at paragraphs are column expressions, more of them are
one scan (``functions/terms.py``); what the rules say and the bounds of thresholds are one literal table, which
an index looks up; verdicts join a row a rule to the documents.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CLAUSE_TYPES, METADATA_FIELDS, MOST_RULES, SEED_RULES
from ..functions.joins import broadcast_if_small
from ..functions.shared import new_folder
from ..functions.terms import rule_scan
from ..functions.text import contains_any
from .clauses import with_clauses
from .metadata import field_aggregates, known_currency

_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "ne": "<>"}


@dataclass(frozen=True)
class Rule:
    rule_code: str
    rule_name: str
    dimension: str
    rule_type: str
    expression: dict
    severity: str
    target_clause_types: list[str] = field(default_factory=list)
    legal_basis: str | None = None
    sort_order: int = 0

    def failure(self) -> str | None:
        """Why the rule can't be evaluated on any document, or None."""
        if set(self.target_clause_types) - set(CLAUSE_TYPES):
            return "INVALID_TARGET_CLAUSE_TYPE"
        x = self.expression
        if self.rule_type == "KEYWORD":
            words = x.get("keywords")
            fine = x.get("logic", "ANY") == "ANY" and isinstance(words, list) and words and all(isinstance(w, str) and w for w in words)
        elif self.rule_type == "REGEX":
            fine = isinstance(x.get("pattern"), str) and x["pattern"] != "" and _compiles(x["pattern"])
        elif self.rule_type == "THRESHOLD":
            fine = isinstance(x.get("field"), str) and x["field"] != "" and isinstance(x.get("op"), str) and x["op"] in _OPS and isinstance(x.get("value"), (int, float)) and not isinstance(x["value"], bool)
            fine = fine and not (isinstance(x["value"], float) and math.isnan(x["value"]))  # an order needs a number
        else:
            return "UNSUPPORTED_RULE_TYPE"
        return None if fine else "INVALID_EXPRESSION"


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


#: The pieces of a pattern that mean the same in both engines, or that can be said in the other; anything else keeps Python's engine.
_PIECES = re.compile(
    r"""(?P<plain>[^\\\[\](){}^$.|?*+\x00-\x1f\x7f])
    | (?P<escape>\\[dDwWsSZ.\\()\[\]{}|?*+^$/-])
    | (?P<set>\[\^?(?:[^\\\[\]&^\x00-\x1f]|\\[dws.\\()\[\]{}|?*+^$/-])+\])
    | (?P<open>\((?:\?:|\?=|\?!|\?P<[A-Za-z][A-Za-z0-9]*>|(?!\?)))
    | (?P<mark>[)|^]|(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??)
    | (?P<dot>[.$])""",
    re.VERBOSE,
)
#: What white space and word characters are for Python, inside a set of Java's.
_WIDE = {r"\s": r"\s\x1c-\x1f", r"\w": r"\p{L}\p{N}_"}
_ALONE = {".": r"[^\n]", "$": r"(?=\n?\z)", r"\Z": r"\z"} | {k: f"[{v}]" for k, v in _WIDE.items()} | {k.upper(): f"[^{v}]" for k, v in _WIDE.items()}


def java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """``pattern`` for Spark's engine, or None where its pieces might mean something else there.

    Line ends, white space and word characters are spelled out; look-behind, back references, inline flags, word borders and sets with ``[`` or ``&`` aren't translated.
    """
    out, at = ["(?U)"], 0
    while at < len(pattern):
        piece = _PIECES.match(pattern, at)
        if piece is None:
            return None
        text, at = piece.group(), piece.end()
        if piece.lastgroup == "set":
            text = re.sub(r"\\.", lambda m: _WIDE.get(m.group(), m.group()), text)
        elif piece.lastgroup == "open":
            text = text.replace("(?P<", "(?<")
        out.append(_ALONE.get(text, text) if piece.lastgroup in ("escape", "dot") else text)
    text = "".join(out)
    try:
        spark._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return None
    return text


def seed_rules() -> list[Rule]:
    return [Rule(**{**r, "expression": json.loads(r["expression"])}) for r in SEED_RULES]


def effective_rule_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The active rules, by (sort_order, rule_id), of the newest active set of each contract type; a set without rules has one null row.

    ``sets``: (set_id, contract_type, version, is_active); ``rules``: (rule_id, set_id, rule_code, sort_order, is_active).
    """
    newest = sets.where("is_active").groupBy("contract_type").agg(F.max_by(F.struct("set_id", "version"), "set_id").alias("s")).select("contract_type", "s.set_id", "s.version")
    active = rules.where("is_active").select("set_id", "rule_id", "rule_code", "sort_order")
    nth = F.row_number().over(W.partitionBy("contract_type").orderBy("sort_order", "rule_id"))
    return newest.join(active, "set_id", "left").withColumn("nth", nth)


def collect_rules(rules: DataFrame) -> list[Rule]:
    """A rule table to the driver, its size checked; any malformed row is an error."""
    rows = rules.orderBy("sort_order", "rule_code").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a catalogue has {MOST_RULES} rules at most")
    return [Rule(r.rule_code, r.rule_name, r.dimension, r.rule_type, json.loads(r.expression), r.severity, list(r.target_clause_types or []), r["legal_basis"] if "legal_basis" in r else None, r.sort_order) for r in rows]


def _in_scope(rule: Rule) -> Column:
    return F.col("clause_type").isin(rule.target_clause_types) if rule.target_clause_types else F.lit(True)


#: Rules that look at paragraphs and are column expressions; a larger catalogue is one scan. Both give the same rows.
EXPRESSIONS = 8


def _names(words: Column | str) -> Column:
    return F.concat(F.lit("命中规则关键词："), F.array_join(F.transform(words, lambda w: F.concat(F.lit("「"), w, F.lit("」"))), "、"))


def _keyword_hit(rule: Rule) -> tuple[Column, Column, Column]:
    """(whether a term is in the paragraph, quote, reason): the terms in it, leftmost first, ties as in the expression."""
    words = list(dict.fromkeys(rule.expression["keywords"]))
    at = F.array(*(F.struct(F.locate(w, F.col("text")).alias("at"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)))
    found = F.transform(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda x: x["w"])
    return contains_any(F.col("text"), words), F.get(found, F.lit(0)), _names(found)


def _regex_hit(spark: SparkSession, rule: Rule) -> tuple[Column, Column, Column]:
    """(whether the paragraph has a match that isn't empty, quote, reason): the first match of the paragraph."""
    pattern = rule.expression["pattern"]
    java = java_pattern(spark, pattern)
    if java is not None:
        quote = F.regexp_extract("text", java, 0)
    else:

        @F.pandas_udf("string")
        def search(texts):
            import pandas as pd

            find = re.compile(pattern).search
            return pd.Series([m.group(0) if isinstance(t, str) and (m := find(t)) else "" for t in texts])

        quote = search("text")
    return quote != "", quote, F.concat(F.lit(f"命中规则正则（{pattern}）：「"), quote, F.lit("」"))


def _text_rules(rules: list[Rule]) -> list[tuple[int, Rule]]:
    return [(n, r) for n, r in enumerate(rules) if r.failure() is None and r.rule_type in ("KEYWORD", "REGEX")]


def _found(spark: SparkSession, rules: list[Rule], ords: bool = False) -> Column:
    """(rule_ord, quote, reason) of each rule in scope that hits a placed paragraph, by rule, as an array; ``ords``: rule_ord alone.

    Without a hit it is null (a scan's is empty), so that arrays, which are evaluated node by node, are made for paragraphs with hits only.
    """
    some = _text_rules(rules)
    if len(some) > EXPRESSIONS:
        found = rule_scan(spark, [(n, r.rule_type, r.expression["keywords"] if r.rule_type == "KEYWORD" else r.expression["pattern"], r.target_clause_types) for n, r in some])("text", "clause_type")
        return F.transform(found, lambda x: x["rule_ord"]) if ords else found
    hits, any_hit = [], F.lit(False)
    for n, rule in some:
        hit, quote, reason = _keyword_hit(rule) if rule.rule_type == "KEYWORD" else _regex_hit(spark, rule)
        hit = F.when(_in_scope(rule), hit)  # not an AND, both sides of which may be evaluated ahead
        any_hit = any_hit | hit
        hits.append(F.when(hit, F.lit(n) if ords else F.struct(F.lit(n).alias("rule_ord"), quote.alias("quote"), reason.alias("reason"))))
    return F.when(any_hit, F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("array<int>" if ords else "array<struct<rule_ord:int,quote:string,reason:string>>")


def _literal(rows: list[dict], schema: str) -> Column:
    """A small table as one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


_SAYS = "risk_code:string,risk_title:string,dimension:string,risk_level:string,legal_basis:string"


def _says(rule: Rule) -> dict:
    return {"risk_code": rule.rule_code, "risk_title": rule.rule_name, "dimension": rule.dimension, "risk_level": rule.severity, "legal_basis": rule.legal_basis}


def _risk(n: Column, says: Column, idx: Column, original: Column, quote: Column, reason: Column) -> Column:
    return F.struct(
        n.alias("rule_ord"),
        *(says[c].alias(c) for c in ("risk_code", "risk_title", "dimension", "risk_level")),
        reason.alias("reason"),
        says["legal_basis"].alias("legal_basis"),
        original.alias("original_text"),
        quote.alias("quote"),
        idx.alias("paragraph_index"),
    )


def paragraph_hits(spark: SparkSession, rules: list[Rule]) -> Column:
    """The risks of keyword and regex rules in a placed paragraph, as an array."""
    says = _literal([_says(r) for r in rules], _SAYS)
    return F.transform(_found(spark, rules), lambda x: _risk(x["rule_ord"], F.get(says, x["rule_ord"]), F.col("idx"), F.col("text"), x["quote"], x["reason"]))


def paragraph_risks(paragraphs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each keyword or regex rule and paragraph that it hits."""
    found = with_clauses(paragraphs).select("doc_id", "clause_index", F.explode(paragraph_hits(paragraphs.sparkSession, rules)).alias("r"))
    return found.select("doc_id", "clause_index", "r.*")


#: Characters of a keyword's anchor at most; rows of anchors that are broadcast, more of them are shuffled.
ANCHOR = 8
MOST_ANCHORS = 500_000


def _grams(text: Column, n: int | Column) -> Column:
    """The different substrings of ``n`` characters."""
    last = F.length(text) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n) if isinstance(n, int) else n)))


def keyword_anchors(catalogue: DataFrame) -> DataFrame:
    """(anchor, words, anchors and what a rule says) of the keyword rules that can be evaluated: a row for each different anchor of a rule.

    The anchor of a word is its substring of ``ANCHOR`` characters (the word, if it is shorter) that the fewest words of the catalogue have.
    """

    @F.udf("array<string>")
    def words_of(code, name, dimension, expression, severity, targets):
        rule = Rule(code, name, dimension, "KEYWORD", json.loads(expression), severity, list(targets or []))
        return list(dict.fromkeys(rule.expression["keywords"])) if rule.failure() is None else None

    law = F.col("legal_basis") if "legal_basis" in catalogue.columns else F.lit(None).cast("string")
    says = F.struct(F.col("rule_code").alias("risk_code"), F.col("rule_name").alias("risk_title"), "dimension", F.col("severity").alias("risk_level"), law.alias("legal_basis"))
    kept = catalogue.where("rule_type = 'KEYWORD'").withColumn("words", words_of("rule_code", "rule_name", "dimension", "expression", "severity", "target_clause_types")).where("words IS NOT NULL")
    grams = kept.select(F.explode("words").alias("word")).distinct().select("word", F.explode(_grams(F.col("word"), F.least(F.length("word"), F.lit(ANCHOR)))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = grams.join(counts, "gram").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("anchor"))
    rule = F.struct(says.alias("says"), "words", F.coalesce("target_clause_types", F.array().cast("array<string>")).alias("targets"), F.monotonically_increasing_id().alias("n"))
    of_rule = kept.select(rule.alias("rule")).select("rule", F.explode("rule.words").alias("word")).join(chosen, "word").groupBy("rule").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    return of_rule.select("rule.says", "rule.words", "rule.targets", "anchors", F.explode("anchors").alias("anchor"))


def table_risks(paragraphs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """As ``paragraph_risks``, without ``rule_ord``, for keyword rules in a table of any size: paragraphs meet the rules whose anchors they have."""
    spark = paragraphs.sparkSession
    folder = new_folder(spark, "anchors")
    keyword_anchors(catalogue).write.parquet(folder)
    anchors = spark.read.parquet(folder)
    sizes = sorted(r.n for r in anchors.select(F.length("anchor").alias("n")).distinct().collect())  # ANCHOR of them at most
    found = F.flatten(F.array(*(_grams(F.col("text"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    met = with_clauses(paragraphs).withColumn("anchor", F.explode(found)).join(broadcast_if_small(anchors, MOST_ANCHORS), "anchor")
    # a rule is taken up once, at the first of its anchors that the paragraph has
    once = met.where((F.size("targets") == 0) | F.array_contains("targets", F.col("clause_type"))).where(F.get(F.filter("anchors", lambda a: F.contains("text", a)), F.lit(0)) == F.col("anchor"))
    at = F.transform("words", lambda w, i: F.struct(F.position(w, F.col("text")).alias("at"), i.alias("i"), w.alias("w")))
    hits = once.withColumn("_f", F.transform(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda x: x["w"])).where("size(_f) > 0")
    quote = F.get("_f", F.lit(0))
    return hits.select("doc_id", "clause_index", _risk(F.lit(0), F.col("says"), F.col("idx"), F.col("text"), quote, _names("_f")).dropFields("rule_ord").alias("r")).select("doc_id", "clause_index", "r.*")


def catalogue_risks(paragraphs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``paragraph_risks`` without ``rule_ord`` for a table of rules. One that the driver may hold is one scan; else keyword rules stay a table, and only the others are collected."""
    if catalogue.limit(MOST_RULES + 1).count() <= MOST_RULES:
        return paragraph_risks(paragraphs, collect_rules(catalogue)).drop("rule_ord")
    out = table_risks(paragraphs, catalogue)
    others = collect_rules(catalogue.where("rule_type <> 'KEYWORD'"))
    return out.unionByName(paragraph_risks(paragraphs, others).drop("rule_ord")) if others else out


_LABELS = {key: label for key, label, _ in METADATA_FIELDS}


_BOUNDS = "rule_ord:int,field:string,op:string,bound:string,about:string,wants:string,taken:string," + _SAYS


def _bound(n: int, rule: Rule) -> dict:
    """A threshold rule as a row: its bound exactly, if 38 digits can say it, and as a double (infinite beyond those)."""
    x = rule.expression
    exact = Decimal(x["value"] if isinstance(x["value"], int) else str(x["value"]))
    fits = exact.is_finite() and abs(exact) < Decimal(10) ** 20 and -exact.as_tuple().exponent <= 18
    try:
        about = float(x["value"])
    except OverflowError:  # an integer beyond all doubles
        about = math.inf if x["value"] > 0 else -math.inf
    wants, taken = f"规则要求 {x['field']} {x['op']} {exact}，实际值为 ", f"（取自「{_LABELS.get(x['field'], '')}」）"
    return {"rule_ord": n, "field": x["field"], "op": x["op"], "bound": format(exact, "f") if fits else None, "about": repr(about).replace("inf", "Infinity"), "wants": wants, "taken": taken} | _says(rule)


def _thresholds(rules: list[Rule]) -> list[dict]:
    return [_bound(n, r) for n, r in enumerate(rules) if r.rule_type == "THRESHOLD" and r.failure() is None]


def _items(some: list[dict]) -> Column:
    """The metadata fields of a wide row that these thresholds ask for, by name."""
    asked = [key for key in _LABELS if key != "payment_terms" and key in {r["field"] for r in some}]
    kind = "map<string,struct<value:string,idx:int,quote:string>>"
    return F.create_map(*(x for key in asked for x in (F.lit(key), F.struct(*(F.col(key)[c].alias(c) for c in ("value", "idx", "quote")))))).cast(kind) if asked else F.lit(None).cast(kind)


def _compared(rule: Column, items: Column) -> tuple[Column, Column, Column]:
    """(whether a number is there, whether it passes the bound, the field's struct), for a row of ``_bound``.

    Numbers are compared exactly, as decimals of 38 digits, as far as both fit that; beyond it, and for an infinite bound, as doubles.
    """
    item = F.try_element_at(items, rule["field"])
    text = F.trim(item["value"])
    there = F.coalesce(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.lit(False))

    def passes(a: Column, b: Column) -> Column:
        op = rule["op"]
        return F.when(op == "gt", a > b).when(op == "gte", a >= b).when(op == "lt", a < b).when(op == "lte", a <= b).when(op == "eq", a == b).otherwise(a != b)

    short = (F.length(F.regexp_extract(text, r"\.(\d*)$", 1)) <= 18) & ~text.rlike("[eE]")
    exact, bound = F.when(short, text.try_cast("decimal(38,18)")), rule["bound"].try_cast("decimal(38,18)")
    judged = F.when(exact.isNotNull() & bound.isNotNull(), passes(exact, bound)).otherwise(passes(text.try_cast("double"), rule["about"].cast("double")))
    return there, there & judged, item


def threshold_verdicts(wide: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a document and threshold rule: status, the value compared and where it was read."""
    some = _thresholds(rules)
    if not some:
        raise ValueError("no threshold rule that can be evaluated")
    each = wide.select("doc_id", _items(some).alias("_items"), F.explode(_literal(some, _BOUNDS)).alias("_r"))
    there, passes, item = _compared(F.col("_r"), F.col("_items"))
    status = F.when(~there, "EVALUATION_FAILED").when(passes, "MATCHED").otherwise("NOT_MATCHED")
    value = F.when(there, item["value"].try_cast("decimal(38,18)"))
    return each.select("doc_id", "_r.rule_ord", F.col("_r.risk_code").alias("rule_code"), status.alias("status"), value.alias("value"), item["idx"].alias("paragraph_index"), item["quote"].alias("quote"), item["value"].alias("field_value"))


def threshold_items(rules: list[Rule]) -> Column:
    """What ``threshold_hits`` reads of a wide metadata row: the fields that are there.

    A column of its own, made once a row: the optimizer would put a plain map in place of each of its many mentions in the lambda.
    """
    return F.map_filter(_items(_thresholds(rules)), lambda _, item: item["idx"].isNotNull())


def threshold_hits(rules: list[Rule], held: str) -> Column:
    """The risks of the threshold rules in a row with ``threshold_items`` as ``held``, as an array."""
    items = F.col(held)

    def hit(r: Column) -> Column:
        _, passes, item = _compared(r, items)
        return F.when(passes, _risk(r["rule_ord"], r, item["idx"], item["quote"], item["quote"], F.concat(r["wants"], item["value"], r["taken"])))

    return F.array_compact(F.transform(_literal(_thresholds(rules), _BOUNDS), hit))


def evaluate(paragraphs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a document and rule: MATCHED, NOT_MATCHED or EVALUATION_FAILED with its reason, and the number of risks."""
    spark = paragraphs.sparkSession
    bounds = {r["rule_ord"]: r for r in _thresholds(rules)}
    rows = [(n, r.rule_code, r.failure(), *(bounds[n][c] if n in bounds else None for c in ("field", "op", "bound", "about"))) for n, r in enumerate(rules)]
    table = F.broadcast(spark.createDataFrame(rows, "rule_ord int, rule_code string, failure string, field string, op string, bound string, about string"))  # MOST_RULES rows at most
    # metadata and hits in one aggregation, on the partitioning that the clauses have made
    placed = with_clauses(paragraphs).withColumn("_hits", _found(spark, rules, ords=True))
    docs = known_currency(placed.groupBy("doc_id").agg(*field_aggregates(), F.flatten(F.collect_list("_hits")).alias("_ords")))
    each = docs.select("doc_id", "_ords", _items(list(bounds.values())).alias("_items"), F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))).alias("rule_ord")) if rules else docs.select("doc_id", "_ords", _items(list(bounds.values())).alias("_items"), F.lit(0).alias("rule_ord")).limit(0)
    met = each.join(table, "rule_ord")
    there, passes, _ = _compared(F.struct("field", "op", "bound", "about"), F.col("_items"))
    compared = F.col("field").isNotNull()
    failure = F.coalesce("failure", F.when(compared & ~there, "MISSING_INPUT"))
    count = F.when(compared, F.when(passes, 1).otherwise(0)).otherwise(F.size("_ords") - F.size(F.array_remove("_ords", F.col("rule_ord"))))
    counted = met.select("doc_id", "rule_code", failure.alias("failure_reason"), count.cast("long").alias("n_risks"))
    verdict = F.when(F.col("failure_reason").isNotNull(), "EVALUATION_FAILED").when(F.col("n_risks") > 0, "MATCHED").otherwise("NOT_MATCHED")
    return counted.select("doc_id", "rule_code", verdict.alias("status"), "failure_reason", "n_risks")


def rule_risks(paragraphs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All risks of all rules; ``seq`` orders a document's by rule and then by place. One pass over the paragraphs."""
    from .dossier import dossiers, risks_of

    return risks_of(dossiers(paragraphs, rules))
