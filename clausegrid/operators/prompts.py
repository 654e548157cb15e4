"""Prompts for a model as column expressions, requests as JSON, and the model as a callable over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model: prompts to (text or None, error code or None).
Model = Callable[[list[str]], list[tuple[str | None, str | None]]]


#: Versions of the review prompt, oldest first; a version is the name of its file and is never overwritten.
PROMPT_VERSIONS = ["clause_review.v1", "clause_review.v2", "clause_review.v3"]
CURRENT_PROMPT = PROMPT_VERSIONS[-1]


def load_prompt(spark: SparkSession, folder: str, name: str = CURRENT_PROMPT) -> str:
    """The text of a version, read from ``folder``/``name``.md without white space at its ends; a missing or empty one is an error."""
    found = spark.read.text(f"{folder}/{name}.md", wholetext=True).first()
    if found is None or not found.value.strip():
        raise ValueError(f"prompt {name} is empty")
    return found.value.strip()


def _clause_text(c: Column) -> Column:
    words = F.concat_ws(" ", F.when(c["clause_no"] != "", c["clause_no"]), F.when(c["title"] != "", c["title"]))
    label = F.when(words != "", F.concat(words, F.lit("·"), c["clause_type"])).otherwise(c["clause_type"])
    return F.concat(F.lit("--- 条款 #"), c["clause_index"].cast("string"), F.lit("（"), label, F.lit("）---\n"), c["text"], F.lit("\n"))


def _rule_text(r: Column) -> Column:
    return F.concat(F.lit("- rule_code="), r["risk_code"], F.lit(" | "), r["risk_title"], F.lit(" | 维度="), r["dimension"], F.lit(" | 等级="), r["risk_level"], F.lit(" | 命中证据："), r["quote"])


def prompts_of(docs: DataFrame, contract_type: str = "PURCHASE") -> DataFrame:
    """(doc_id, user_prompt): the clauses of each dossier in order and the rules that hit it. The same rows give the same text."""
    head = F.concat(F.lit(f"【合同类型】{contract_type}\n\n【本批条款】（共 "), F.size("clauses").cast("string"), F.lit(" 条，clause_index 请原样回显）\n"))
    hits = F.array_join(F.transform("risks", lambda x: _rule_text(x["r"])), "\n")
    hit = F.when(F.size("risks") == 0, "【规则已命中】（无）").otherwise(F.concat(F.lit("【规则已命中】（不要重复报告；相关的请在 related_rule_code 里回填对应编码）\n"), hits))
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform("clauses", _clause_text), "\n"), F.lit("\n"), hit).alias("user_prompt"))


def requests(prompts: DataFrame, system_prompt: str, model: str, temperature: float = 0.2, max_tokens: int = 4096) -> DataFrame:
    """(doc_id, request): the JSON body of a chat completion for each prompt."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(system_prompt)), message("user", F.col("user_prompt"))).alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
    )
    return prompts.select("doc_id", F.to_json(body).alias("request"))


def complete(prompts: DataFrame, model: Model | None, column: str = "user_prompt") -> DataFrame:
    """(doc_id, raw_text, llm_error_code): the model's outputs; without a model, or where it fails, rules go on alone."""

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if model is None:
                got = [(None, "LLM_UNAVAILABLE")] * len(pdf)
            else:
                try:
                    got = model(pdf[column].tolist())
                except Exception:  # a service that can't be reached degrades the review, it doesn't end the job
                    got = [(None, "LLM_UNAVAILABLE")] * len(pdf)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "raw_text": [t for t, _ in got], "llm_error_code": [e for _, e in got]})

    return prompts.select("doc_id", column).mapInPandas(task, "doc_id long, raw_text string, llm_error_code string")
