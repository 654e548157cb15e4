"""Plans: what moves, and what never does."""

import public_tokenizers as P
import pytest

from clausegrid.llm import bpe, languages, packing, registry
from clausegrid.llm._common import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_only_operators_have_no_exchange(spark, sf):
    docs = table(spark, sf, "documents")
    assert "Exchange" not in plan(packing.pack_documents(docs, P.path("byte_bpe_50k.json")))
    assert "Exchange" not in plan(bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken")))
    assert "Exchange" not in plan(languages.predict(docs, languages.Filters([], [], None)))


def test_scans_read_what_they_need(spark, sf):
    docs = table(spark, sf, "documents")
    for df in (packing.pack_documents(docs, P.path("byte_bpe_50k.json")), bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"))):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(df)


def test_token_counts_shuffle_no_tokens(spark, sf):
    text = plan(registry.op9_token_counts(spark, sf))
    assert "ends:array<bigint>" in text and "binary" not in text  # places of separators, no tokens


@pytest.mark.parametrize("name", ["op6_dual_tree_topk", "op7_histogram_sort_shards", "op8_minhash_fingerprints", "op5_unit_dedup", "op4_minhash_near_duplicates"])
def test_no_cross_joins(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "Cartesian" not in text and "NestedLoop" not in text
