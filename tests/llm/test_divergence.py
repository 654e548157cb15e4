"""Operator 13 by brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from clausegrid.llm import divergence as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, smooth=5, scale=10**9, top=50):
    """docs: (text, lang, source)."""
    counts, where = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        where[lang or ""].update(set(terms))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in where[lang].items() if n >= least]
        groups = {s: counts[x, s] for x, s in counts if x == lang}
        groups_p = {}
        for s, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            groups_p[s] = {t: 1 + scale * (c[t] + smooth) // (total + smooth * len(kept)) for t in kept}
        for s, c in groups.items():
            p, q = groups_p[s], groups_p[None]
            pairs = [(-sum(abs(p[t] - groups_p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[t], t.encode()) for t in kept if c[t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found), 1)]
    return sorted(out)


def some_docs(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "Ünï", "ünï", "a1b", "x-y", "\x7f", "é", "日本", "𝒳", "B"] + [f"w{chr(97 + i)}" for i in range(15)]
    docs = [(" ".join(r.choice(words[: r.choice([4, 12, 26])]) for _ in range(r.randrange(12))), r.choice(["en", "fr", None, "zz"]), r.choice(["s", "t", None, "u", "Ü"])) for _ in range(n)]
    docs = [(t, lang, s) for t, lang, s in docs if lang != "zz"] + [("", "zz", "a"), ("rare", "zz", "b"), (None, "zz", "c"), (None, None, None), ("the a " * 50_000, "en", "s"), ("the " * 400, "en", "only")]
    return docs + docs[:5] * 3


@pytest.mark.parametrize(("parts", "least", "small"), [(1, 3, False), (4, 1, True), (3, 6, True)])
def test_divergence_brute_force(spark, monkeypatch, parts, least, small):
    if small:
        monkeypatch.setattr(d, "SLICE_BYTES", 40)
        monkeypatch.setattr(d, "SLICE_ROWS", 8)
    docs = some_docs(parts, 150)
    df = spark.createDataFrame([(*x, 1, "y", "z") for x in docs], "text string, lang string, source string, n long, term string, kind string").repartition(parts)
    got = sorted(map(tuple, d.divergence(df, least_docs=least, top=7).collect()))
    assert got == brute(docs, least, top=7)
    assert d.divergence(df.limit(0)).count() == 0


def test_no_kept_terms(spark):
    df = spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t"), (None, "en", None)], "text string, lang string, source string")
    assert sorted(map(tuple, d.divergence(df).collect())) == brute([("a b", "en", "s"), ("c", "en", "t"), (None, "en", None)], 30)


def test_counts_beyond_64_bit_products(spark):
    """Products of a count and the scale pass 2**63; the shares are exact all the same."""
    con = d._engine()
    assert con.execute("SELECT (1 + 1000000000::HUGEINT * (20000000000::BIGINT + 5) // 30000000000)::BIGINT").fetchone()[0] == 1 + 10**9 * (2 * 10**10 + 5) // (3 * 10**10)
