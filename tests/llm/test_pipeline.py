"""corpus_pipeline: each stage and the whole against brute-force versions."""

import random

import public_tokenizers as P
from pyspark.sql import functions as F
from test_fingerprints_substrings import brute_passages
from test_neardup import brute
from test_tokens import check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from clausegrid.llm import _common


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10_001, "12 34 ++ 56"), (10_002, None), (10_003, "中文字符语言" * 20)], "doc_id long, text string")
    for c in ("lang", "source"):
        junk = junk.selectExpr("*", f"CAST(NULL AS string) AS {c}")
    docs = docs.unionByName(junk.selectExpr("*", "CAST(0 AS bigint) AS n_chars"))
    original = {r.doc_id: r.text for r in docs.collect()}

    one = corpus_pipeline.identify_language(spark, docs, sf)
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(original) - set(kept) == {10_001, 10_002, 10_003}

    two = corpus_pipeline.drop_near_duplicates(spark, one, sf)
    assert two.columns == docs.columns
    want = {i for i, _, _, keep in brute(list(kept.items()), 5) if keep}
    kept = {r.doc_id: r.text for r in two.collect()}
    assert set(kept) == want

    three = corpus_pipeline.drop_repeated_units(spark, two, sf)
    assert three.columns == docs.columns
    left = brute_passages(list(kept.items()), 20)
    rows = three.collect()
    assert {r.doc_id: r.text for r in rows} == {i: t for (i, _), (t, _) in left.items()} and all(r.n_chars == len(r.text) for r in rows)

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in rows}
    packed = corpus_pipeline.pack_sequences(spark, three, sf).collect()
    assert check_packed(packed, ids, 2048) < 0.05 and len(packed) < 2.8 * len(ids)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_with_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, very long and empty texts, ids beyond 2**53, columns that clash, no rows."""
    big = (1 << 60) + 1
    same = "the cat and the dog walk home over the hill and sleep there. "
    rows = [(big, same * 3, "en", 1, "x", 2**62 + 1), (big + 2, same * 3, "en", 1, None, None), (None, same * 3, None, None, None, 5), (None, None, None, None, None, None), (7, "", "en", 1, "y", 7), (8, "a b " * 100_000, "en", 1, "z", 8), (8, "a b " * 100_000, "en", 1, "z", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, lang_pred string, removed long").coalesce(1)
    one = corpus_pipeline.identify_language(spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted((r.doc_id or 0, r.removed or 0) for r in one.collect()) == sorted([(big, 2**62 + 1), (big + 2, 0), (0, 5), (8, 8), (8, 8)])
    two = corpus_pipeline.drop_near_duplicates(spark, one, sf)
    assert sorted((r.doc_id or 0) for r in two.collect()) == [0, 8, 8, big]
    three = corpus_pipeline.drop_repeated_units(spark, two, sf).collect()
    assert {r.doc_id: r.removed for r in three if r.doc_id == big} == {big: 2**62 + 1} and all(r.n_chars == len(r.text) for r in three)
    packed = corpus_pipeline.pack_sequences(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {big, big + 2, None, 7, 8}
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_units, corpus_pipeline.pack_sequences):
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_unlearned_languages_and_random_letters_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) >= 200")
    r = random.Random(5)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)) for _ in range(20)]
    junk = spark.createDataFrame([(20_000 + i, t, len(t)) for i, t in enumerate(noise)], "doc_id long, text string, n_chars long")
    foreign = {x.doc_id for x in docs.where("lang = 'de'").collect()}
    known = {x.doc_id for x in docs.where("lang <> 'de'").collect()}
    mixed = docs.withColumn("lang", F.expr("nullif(lang, 'de')")).unionByName(junk, allowMissingColumns=True)
    kept = {x.doc_id for x in corpus_pipeline.identify_language(spark, mixed, sf).collect()}
    assert len(foreign) > 5 and len(kept & foreign) <= 0.1 * len(foreign)
    assert len(kept & known) >= 0.99 * len(known) and not any(i >= 20_000 for i in kept)


def test_results_outlive_other_stages(spark, sf):
    """Two lazy results of a stage, and two runs, in one application; what they leave in the shared folder."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = docs.where("doc_id < 100")
    with _common.owned() as left:
        one, two = (corpus_pipeline.drop_repeated_units(spark, d, sf) for d in (docs, half))
        lang = [corpus_pipeline.identify_language(spark, d, sf) for d in (docs, half)]
        assert one.count() == docs.count() and two.count() == half.count()
        assert lang[1].count() == half.count() and lang[0].count() == docs.count() and one.count() == docs.count()
    assert len(left) <= 4  # at most the places of repeats, and the rejected texts, of each call
    with _common.owned() as left:
        first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
        assert first.count() == second.count() > 0 and first.count() == second.count()
    there = [p for p in left if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert len(there) == 2 and all("stage-substring_dedup" in p for p in there)  # what each result reads
