"""Operator 1: the filters by brute force, held-out accuracy, odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest

from clausegrid.llm import languages, registry


def brute_grams(text):
    """All windows of 1 to 4 characters with letters inside and white space at the ends only."""
    t = " "
    for c in text.lower():
        t += c if c.isalpha() else " " if t[-1] != " " else ""
    t += " " if t[-1] != " " else ""
    out = []
    for n in range(1, 5):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if " " not in g[1:-1] and g.strip():
                out.append(g)
    return out


def test_gram_hashes_brute_force():
    r = random.Random(1)
    texts = ["".join(r.choice("abcÉß .,1\n") for _ in range(r.randrange(30))) for _ in range(300)] + ["", "a", " ", "1", "ab", "x y"]
    orders, at = languages.gram_hashes(texts)
    ends = [*at[1:], len(orders[0][0])]
    name = {}
    for t, a, b in zip(texts, at, ends):
        got = sorted(int(h[i]) for h, valid in orders for i in range(a, min(b, len(h))) if valid[i])
        want = brute_grams(t)
        assert len(got) == len(want)
        # as many different hashes, equally often: a hash stands for one n-gram throughout
        assert sorted(collections.Counter(got).values()) == sorted(collections.Counter(want).values())
        for g, n in collections.Counter(want).items():
            held = {h for h, k in collections.Counter(got).items() if k == n}
            name[g] = name.get(g, held) & held
            assert name[g]
    assert all(len(x) >= 1 for x in name.values())


def test_filters_correct_for_false_positives():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 40))) for _ in range(50)]
    known = {"aa": languages.gram_hashes(texts[:25]), "bb": languages.gram_hashes(texts[25:])}
    grams = {k: np.unique(np.concatenate([h[v] for h, v in o])) for k, (o, _) in known.items()}
    for label in grams:  # fill the filters, so that false positives are many
        grams[label] = np.concatenate([grams[label], rng.integers(0, 1 << 63, 150_000).astype(np.uint64)])
    filters = languages.Filters.build(["aa", "bb"], grams)
    assert (filters.rate > 0.3).all()
    strange = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000)))]
    counts, total = filters.counts(strange)
    assert (np.abs(counts[0] / total[0]) < 0.05).all()
    labels, score = filters.predict([*texts, "", "12 .", "é"])
    assert labels[:50] == ["aa"] * 25 + ["bb"] * 25 and (score[:50] > 0.95).all()
    assert labels[50:] == ["und", "und", "aa"] and score[50] == score[51] == 0


def test_more_labels_than_a_word_has_bits():
    words = {f"l{i}": chr(0x4E00 + 40 * i) * 3 + chr(0x4E01 + 40 * i) * 2 for i in range(130)}
    grams = {k: np.concatenate([h[v] for h, v in languages.gram_hashes([w])[0]]) for k, w in words.items()}
    filters = languages.Filters.build(sorted(words), grams)
    assert len(filters.planes) == 3 and filters.predict([words[k] for k in sorted(words)])[0] == sorted(words)


def test_op1_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op1_language_filters(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.97


def test_odd_rows(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 5, "en" if i % 2 else "fr", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", "fr", 1), (102, "123 !", None, 1), (103, "the dog", None, 1), (None, "le chien", "fr", 1), (103, "the dog", None, 1), (104, "the cat " * 30000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    filters = languages.learn(df)
    got = languages.predict(df, filters)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r.lang_pred)
    assert found[100] == found[101] == found[102] == ["und"] and found[103] == ["en", "en"] and found[None] == ["fr"] and found[104] == ["en"]
    assert all(found[i] == (["en"] if i % 2 else ["fr"]) for i in range(40))
    nothing = languages.learn(df.limit(0))
    assert {r.lang_pred for r in languages.predict(df, nothing).collect()} == {"und"}
    assert languages.predict(df.limit(0), filters).count() == 0


def brute_filters(labelled, grams, share=0.5, least=3):
    """Exact sets of n-grams in place of the filters: those frequent in a language and no rarer than ``share`` of the highest rate."""
    counts = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, collections.Counter()).update(brute_grams(text))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items() if n >= least} for lang, c in counts.items()}
    top = collections.Counter()
    for r in rate.values():
        for g, f in r.items():
            top[g] = max(top[g], f)
    out = {}
    for lang, r in rate.items():
        kept = sorted((g for g, f in r.items() if f >= share * top[g]), key=lambda g: -counts[lang][g])
        assert len(kept) <= grams  # else ties at the limit would matter
        out[lang] = set(kept)
    return out


def test_predictions_brute_force(spark, sf):
    """Corrected counts of the bit-sliced filters against exact sets, and the labels that follow."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", languages.held_out())
    rows = docs.collect()
    filters = languages.learn(docs.where("NOT held_out"))
    exact = brute_filters([(r.text, r.lang) for r in rows if not r.held_out], 1 << 20)
    assert set(filters.labels) == set(exact)
    texts = [r.text for r in rows if r.text and languages.has_letter(r.text)]
    counts, total = filters.counts(texts)
    labels, score = filters.predict(texts)
    for i, t in enumerate(texts):
        grams = brute_grams(t)
        want = np.array([sum(g in exact[lang] for g in grams) for lang in filters.labels])
        assert total[i] == len(grams)
        slack = 4 * np.sqrt(len(grams) * filters.rate + 1) / (1 - filters.rate)  # false positives beyond their rate
        assert (np.abs(counts[i] - want) <= slack + 0.02 * len(grams)).all()
        first, second = np.sort(want)[-1], np.sort(want)[-2]
        if first - second > 2 * (slack.max() + 0.02 * len(grams)):
            assert labels[i] == filters.labels[int(want.argmax())]
            assert abs(score[i] - first / len(grams)) <= (slack.max() + 0.02 * len(grams)) / len(grams)
    decided = np.mean([labels[i] == filters.labels[int(np.array([sum(g in exact[x] for g in set(brute_grams(t))) for x in filters.labels]).argmax())] for i, t in enumerate(texts[:40])])
    assert decided > 0.9


def test_dirty_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some text here", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="3 languages"):
        languages.learn(df)


def test_filters_follow_the_counts():
    assert languages.slot_bits(100, 4) == languages.SLOT_BITS and languages.slot_bits(1 << 17, 4) == 20 and languages.slot_bits(1 << 30, 4) == languages.MOST_BITS
    for labels in (1, 8, 9, 64, 65, 2000):
        width = sum(languages._kind(min(64, labels - at))(0).itemsize for at in range(0, labels, 64))
        assert width << languages.slot_bits(1 << 30, labels) <= languages.MOST_BYTES
