"""Operator 12 by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import bwt, byte_windows, registry


def brute_windows(strings, w):
    seen = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
    return [[i for i in range(len(s) - w + 1) if seen[s[i : i + w]] > 1] for s in strings]


def brute(texts, w):
    """(kept, stretches) of each text."""
    strings = [(t or "").encode() for t in texts]
    out = []
    for s, starts in zip(strings, brute_windows(strings, w)):
        gone = bytearray(len(s))
        for i in starts:
            gone[i : i + w] = b"\1" * w
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a) if gone.find(0, a) >= 0 else len(gone)
            spans.append((a, at))
        out.append((bytes(b for b, g in zip(s, gone) if not g), spans))
    return out


@pytest.mark.parametrize("long", [2, 5, 512])
def test_repeated_windows_of_a_transform(monkeypatch, long):
    monkeypatch.setattr(bwt, "LONG", long)
    r = random.Random(long)
    for _ in range(80):
        letters = r.choice([b"a", b"ab", b"abc", bytes(range(256)), b"\0\xff"])
        base = bytes(r.choice(letters) for _ in range(r.randrange(1, 300)))
        strings = []
        for _ in range(r.randrange(1, 30)):
            i = r.randrange(len(base))
            strings.append(base[i : i + r.randrange(60)] + bytes(r.choice(letters) for _ in range(r.randrange(10))))
        w = r.choice([1, 2, 5, 8, 9, 20, 40])
        assert [x.tolist() for x in bwt.repeated_windows(strings, w)] == brute_windows(strings, w)


def test_search_stops_at_the_length():
    """Neighbours that share more than the length aren't parted, however much more."""
    strings = [b"x" * 300 + bytes([i]) for i in range(5)]
    assert [len(x) for x in bwt.repeated_windows(strings, 100)] == [201] * 5


@pytest.mark.parametrize(("alphabet", "run"), [("ab", 7), ("abcdefgh", 1024), ("a", 5)])
def test_segments_hold_each_window_once(alphabet, run):
    r = random.Random(run)
    for _ in range(60):
        texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 19, 20, 21, 90]))).encode() for _ in range(6)]
        texts += [texts[-1] * 3]
        begin, end, low, own = byte_windows.segments(b"".join(texts), [len(t) for t in texts], 20, gram=8, run=run)
        starts = [sum(map(len, texts[:i])) for i in range(len(texts))]
        want = [a + i for a, t in zip(starts, texts) for i in range(len(t) - 19)]
        assert sorted(i for a, b in zip(begin, end) for i in range(a, b - 19)) == want
        data, smallest = b"".join(texts), {}
        for a, b, m, x in zip(begin.tolist(), end.tolist(), low.tolist(), own.tolist()):
            inner = [data[i : i + 20] for i in range(a, b - 19)]
            assert x or len(set(inner)) == len(inner)  # what repeats within itself says so
            assert all(smallest.setdefault(w, m) == m for w in inner)  # equal windows choose the same hash


@pytest.mark.parametrize("width", [64, 16, 4, 1])
def test_pieces_with_equal_windows_have_equal_cores(width):
    r = random.Random(width)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(500))
    gram = base[240 : 240 + byte_windows.GRAM]
    k = int(byte_windows.gram_hashes(np.frombuffer(gram, np.uint8), byte_windows.GRAM).view(np.int64)[0])
    cores, seen = {}, 0
    for _ in range(60):
        a, b = r.randrange(150, 241), r.randrange(340, 420)
        segment = bytes(r.choice(b"xyz") for _ in range(r.randrange(30))) + base[a:b] + bytes(r.choice(b"xyz") for _ in range(r.randrange(30)))
        if len(segment) < 200 or segment.index(gram) > 136:
            continue
        n, begins = len(segment) - 199, []
        if n - 1 > segment.index(gram):  # windows without it are another segment's
            segment = segment[: segment.index(gram) + 200]
            n = len(segment) - 199
        for begin, end, core in byte_windows.pieces(segment, k, 200, width):
            begins += range(begin, end - 199)
            for i in range(begin, end - 199):
                assert cores.setdefault(segment[i : i + 200], core) == core
                seen += 1
        assert begins == list(range(n))
    assert seen > len(cores)


def some_texts(seed, n, passage=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé字 ") for _ in range(r.randrange(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(60) for _ in range(4)]
    texts = [line(r.randrange(60)) + r.choice(["", r.choice(shared)[r.randrange(40) :]]) + line(r.randrange(30)) for _ in range(n)]
    stock = "x" + line(80)
    texts += [f"{line(3)}{stock[:passage]}{line(3)}" for _ in range(25)]  # one passage among many different ones
    texts += [texts[0], texts[0], texts[1], "ab" * 4000, "ab" * 150 + line(40), "z" * 150, line(9) * 30, "", None, None]
    return texts


@pytest.mark.parametrize(("parts", "many", "block"), [(1, 1000, 1 << 19), (5, 3, 700), (3, 0, 1 << 19)])
def test_removal_brute_force(spark, monkeypatch, parts, many, block):
    monkeypatch.setattr(byte_windows, "BLOCK", block)
    monkeypatch.setattr(byte_windows, "TRANSFORM", 3000)
    texts = some_texts(parts, 40)
    ids = [(i * 7) % 1000 for i in range(len(texts))]
    rows = [*zip(ids, texts), (None, texts[2]), (None, texts[3]), (ids[4], texts[4]), (ids[5], texts[6])]
    df = spark.createDataFrame([(i, t, n, 2, "y") for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, k int, removed string").repartition(parts)
    got = byte_windows.remove_repeats(df, many=many).collect()
    want = brute([t for _, t in rows], 200)
    assert {r.n: (r.doc_id, r.text, bytes(r.kept), [tuple(s) for s in r.removed]) for r in got} == {n: (i, t, *w) for n, ((i, t), w) in enumerate(zip(rows, want))} and len(got) == len(rows)
    assert byte_windows.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_windows.remove_repeats(df, least=40)


def test_long_texts(spark):
    """Texts of several MB: a period, copies that are shifted, and repeats at a block's edge."""
    r = random.Random(4)
    noise = bytes(r.randrange(33, 127) for _ in range(2_100_000)).decode()
    df = spark.createDataFrame([(1, noise), (2, "!" + noise[1_048_000:1_049_000]), (3, "qrs" * 1_000_000), (4, noise[:199]), (5, noise[7:207])], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.removed] for x in byte_windows.remove_repeats(df).select("doc_id", "removed").collect()}
    assert got == {1: [(7, 207), (1_048_000, 1_049_000)], 2: [(1, 1001)], 3: [(0, 3_000_000)], 4: [], 5: [(0, 200)]}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, len((t or "").encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (i, t), (kept, spans) in zip(rows, brute([t for _, t in rows], 200)))
    assert sorted(map(tuple, registry.op12_byte_windows(spark, sf).collect())) == want
    assert any(x[2] for x in want)


def test_report_of_no_rows(spark):
    assert byte_windows.removal_report(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).count() == 0
