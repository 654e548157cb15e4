"""Operator 4 by brute force."""

import math
import random
import re

import numpy as np
import pytest

from clausegrid.llm import components, neardup, registry


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted((x for x in sets if x[0] is not None and x[1]), key=lambda x: len(x[1]))
    for n, (i, a) in enumerate(by_size):
        for j, b in by_size[n + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


def near_texts(seed, n, length=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(r.randrange(5, length))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else [r.choice(vocab) for _ in range(r.randrange(length))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        out.append(r.choice([" ", "  ", "\n"]).join(x.upper() if r.random() < 0.1 else x for x in w))
    return out


@pytest.mark.parametrize("k,small", [(4, False), (5, True)])
def test_near_duplicates_brute_force(spark, monkeypatch, k, small):
    if small:  # several blocks and salts a bucket
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
        monkeypatch.setattr(neardup, "PIVOT_ROWS", 2)
    texts = near_texts(k, 160)
    docs = list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "\xa0"), (None, texts[0]), (None, "alone"), (3, texts[3]), (2003, "three four"), (2007, "three four"), (2008, "long " * 20000)]
    df = spark.createDataFrame([(i, t, 5, "b") for i, t in docs], "doc_id long, text string, n int, node string").repartition(3)
    want = brute(docs, k)
    got = rows_of(neardup.near_duplicates(df, k))
    assert got == want


def test_nothing_shared_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(df)) == [(1, 2, 1, True), (2, 2, 2, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bound():
    least = neardup.least_matches(80, 1e-6)
    rng = np.random.default_rng(0)
    # by sampling: P(s >= 0.8 | m of n) with a uniform prior
    for n, m in zip(neardup.STEPS, least):
        above = (rng.beta(m + 1, n - m + 1, 2_000_000) >= 0.8).mean()
        assert above < 2e-4
        tail = sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m))
        assert tail < 1e-6
    assert least == sorted(least) and least[-1] > 64


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_op4_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(registry.op4_minhash_near_duplicates(spark, sf)) == brute(docs, 4)


@pytest.mark.parametrize("shape", ["path", "star", "comb"])
def test_components_take_few_rounds(spark, monkeypatch, shape):
    """Numbered in order, with the hub last, or both: what contraction by the smallest id would take many rounds for."""
    n = 600
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "comb": [(i, i + 1) for i in range(n)] + [(i, i + 10_000) for i in range(n)]}[shape]
    made, real = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label: made.append(label) or real(df, label))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == len({x for e in edges for x in e})
    assert made.count("labels") <= 8
