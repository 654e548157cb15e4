"""The whole review of a corpus as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import clauses, dossier, findings, keywords, merge, rules


@dataclass
class Review:
    """The tables that a review gives; all of them are lazy and keyed by doc_id."""

    clauses: DataFrame
    metadata: DataFrame
    keyword_hits: DataFrame
    evaluations: DataFrame
    risks: DataFrame
    #: One row a document with its clauses, metadata and rule risks; whoever needs several of these tables stores it once.
    dossiers: DataFrame


def review(paragraphs: DataFrame, catalogue: list[rules.Rule], raw_findings: DataFrame | None = None) -> Review:
    """``paragraphs`` (doc_id, idx, block_type, text) through every stage.

    ``raw_findings``: (doc_id, raw_text), a model's output for each document; documents without valid
    output are reviewed by rules alone.
    """
    docs = dossier.dossiers(paragraphs, catalogue)
    risks = dossier.risks_of(docs)
    if raw_findings is not None:
        rows = findings.findings_rows(findings.guard_json(raw_findings))
        located = findings.check_related(findings.locate(rows, clauses.with_clauses(paragraphs)), [r.rule_code for r in catalogue])
        risks = merge.merge_risks(findings.unify(risks, located))
    return Review(dossier.clauses_of(docs), dossier.metadata_of(docs), keywords.keyword_hits(paragraphs), rules.evaluate(paragraphs, catalogue), risks, docs)
