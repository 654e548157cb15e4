"""Operator 11 by brute force."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from clausegrid.llm import filter_audit, registry


def brute(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        parts[source or ""].append((i, {f for f, x in fails.items() if x}))
    out = []
    for part, rows in parts.items():
        removed = {}
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed["".join(order), step] = (f, len(left), gone, len(failing))
        total = defaultdict(int)
        for f, _, gone, _ in removed.values():
            total[f] += len(gone)
        for (order, step), (f, kept, gone, failing) in removed.items():
            alone = sum(r[1] == {f} for r in rows)
            out.append((part, order, step, kept, len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), total[f]))
    return sorted(out)


def some_docs(seed, n):
    r = random.Random(seed)
    words = ["ab", "AB", "é", "x#y", "|", "C", "　", "q"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words[r.randrange(8) :]) for _ in range(r.choice([3, 30, 50, 51, 80]))) for _ in range(n // 2)]
    docs = [(i, r.choice(texts), r.choice(["s", "t", "", None, "größe"])) for i in range(n)]
    docs += [(500, None, "s"), (501, "", None), (None, texts[0], "s"), (None, texts[0], None), (3, docs[3][1], "t"), docs[5], docs[5], (-4, texts[1], "t"), (600, "a\x0bb\x0c" * 30_000, "u"), (601, "a\x0bb\x0c" * 30_000, "u")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, n, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize(("parts", "held"), [(1, 1 << 25), (5, 200)])
def test_audit_brute_force(spark, monkeypatch, parts, held):
    monkeypatch.setattr(filter_audit, "HELD_CHARS", held)
    docs, labels = some_docs(parts, 90)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(parts)
    known = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(df, known)
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    want = {i for i, t, _ in docs if i is not None and any(j is not None and j < i and (x or "") == (t or "") for j, x, _ in docs)}
    assert {r.doc_id for r in filter_audit.identical_ids(df).collect()} == want
    assert filter_audit.audit(df.limit(0), known).count() == 0
    assert filter_audit.audit(df, known.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_texts_of_one_fingerprint_stay_apart(spark, monkeypatch):
    chain = filter_audit.Chain()
    assert chain.add("a", 5, 0, filter_audit.Counter(s=1)) is None and chain.add("b", 3, 0, filter_audit.Counter(s=1)) is None
    assert chain.add("a", 4, 2, filter_audit.Counter(t=1)) == (5, 16, {"s": 1})
    assert chain.add("b", 9, 1, filter_audit.Counter(t=2)) == (9, 17, {"t": 2})
    assert chain.add("a", 4, 2, filter_audit.Counter(t=1)) is None and [e[1:] for e in chain.entries] == [[4, 2, {"t": 2}], [3, 0, {"s": 1}]]


def test_query(spark, sf):
    got = registry.op11_filter_interactions(spark, sf)
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
