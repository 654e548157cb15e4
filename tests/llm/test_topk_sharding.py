"""Operators 6 and 7 by brute force."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from clausegrid.llm import registry, sharding, topk


def brute_topk(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        if sum(a * a for a in x) < 2**62:
            seen[i, x] = None
    near = {}
    for q, qx in seen:
        if q % every == 0:
            near.setdefault(q, []).extend((-sum(a * b for a, b in zip(qx, x)), i) for i, x in seen if i != q and len(x) == len(qx))
    return sorted((q, r + 1, i, -s) for q, some in near.items() for r, (s, i) in enumerate(sorted(some)[:k]))


def small(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 24)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 6)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    monkeypatch.setattr(topk, "DATA_GROUP", 2)
    monkeypatch.setattr(topk, "BOUND_GROUPS", 2)


def test_topk_brute_force(spark, monkeypatch):
    small(monkeypatch)
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.6]) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [0.1, 0.2, 0.3]) for i in range(40)]  # a large group of equal vectors
    rows += [(300, None), (301, []), (302, [None, 1.0, 2.0]), (303, [float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0]), (310, [1.0, 2.0]), (300, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), rows[0], rows[10]]
    rows += [(400, [0.9, 0.1, -0.3]), (400, [-0.8, 0.3, 0.3]), (60, [0.3, -0.3, 0.9])]  # ids with two vectors
    rows += [(410, [3.0e38, 1.0, 1.0]), (420, [5.0e6, 4.0e6, -3.0e6]), (421, [-4.0e6, 6.0e6, 1.0])]  # too large, and large
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted(map(tuple, topk.exact_topk(df, k=5, query_every=10).collect()))
    assert got == brute_topk(rows, 5, 10)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 8, (150, 6)) for c in (0, 300, -400, 900)]).astype(np.int64)
    t = topk.CoverTree(np.arange(600), x, leaf=8)
    for n in range(len(t.radius)):
        d = np.sqrt(((t.x[t.lo[n] : t.hi[n]] - t.center[n]) ** 2).sum(1))
        assert d.max() <= t.radius[n] + 1e-9
    back = topk.CoverTree.load(t.dump())
    assert back.kids == t.kids and (back.ids == t.ids).all()
    best = topk.Best(600, 3)
    made = topk.dual_search(t, t, best, np.full(600, np.iinfo(np.int64).min))
    s = t.x @ t.x.T
    np.fill_diagonal(s, np.iinfo(np.int64).min)
    assert (np.sort(best.score, 1) == np.sort(np.sort(s, 1)[:, -3:], 1)).all() and made < 360_000


def clustered(n, dim, seed=2):
    """Points of 12 far and narrow clusters of different sizes."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 4, (12, dim))
    of = rng.choice(12, n, p=np.arange(1, 13) / 78)
    return centers[of] + rng.normal(0, 0.02, (n, dim))


def searched(spark, x, **options):
    made = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    rows = topk.exact_topk(df, made=made, **options).collect()
    return sorted(map(tuple, rows)), made.value


def test_blocks_are_pruned_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "DATA_GROUP", 2)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    x = clustered(4000, 8)
    got, made = searched(spark, x)
    f = np.floor(256 * x).astype(np.int64)
    s = f[::50] @ f.T
    s[np.arange(80), np.arange(80) * 50] = -(2**62)
    order = np.lexsort((np.broadcast_to(np.arange(4000), s.shape), -s), axis=-1)[:, :5]
    assert got == sorted((50 * q, r + 1, int(i), int(s[q, i])) for q in range(80) for r, i in enumerate(order[q]))
    assert made < 0.35 * 80 * 4000


def test_vectors_that_cannot_be_pruned_meet_once(spark):
    x = np.random.default_rng(3).normal(0, 1, (1500, 24))
    x /= np.sqrt((x**2).sum(1))[:, None]
    got, made = searched(spark, x)
    assert len(got) == 150 and made <= 30 * 1500


def test_op6_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, registry.op6_dual_tree_topk(spark, sf).collect())) == brute_topk(rows, 5, 50)


def check_shards(docs, rows, n, most):
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1) for d, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in rows) == want
    by = {}
    for r in rows:
        assert 0 <= r.shard < n
        by.setdefault(r.shard, []).append(r)
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    sizes = [sum(r.size for r in by.get(i, [])) for i in range(n)]
    share = sum(sizes) / n
    assert max(abs(s - share) for s in sizes) <= most, (sizes, share)


@pytest.mark.parametrize("parts", [1, 40])
def test_shards_brute_force(spark, parts):
    r = random.Random(parts)
    docs = [(i, "x" * r.randrange(0, 40) + str(r.randrange(90))) for i in range(900)]
    docs += [(1000 + i, "the same long text of a hot group " * 2) for i in range(500)] + [(None, None), (3, None), (5000, "é" * 300), (5000, "é" * 300)]
    r.shuffle(docs)
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id long, text string, h int, slot string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sharding.shard_rows(df, 16)
        assert got.columns == ["doc_id", "text", "h", "size", "shard", "slot"]
        check_shards(docs, got.collect(), 16, 700)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sharding.shard_rows(df.limit(0)).count() == 0
    assert len(sharding.shard_rows(df.where("doc_id = 3")).collect()) == 2


def test_splitters_keep_groups_where_tolerance_allows(spark):
    rows = [(h, d, 1) for h in range(-50, 50) for d in range(10)]
    keys = spark.createDataFrame(rows, "h long, d long, w long")
    found, total = sharding.find_splitters(keys, [(250, 5), (503, 5), (756, 2)])
    assert total == 1000 and [p for p in found[:2]] == [(-25, sharding._LOW), (0, sharding._LOW)]
    assert found[2][0] == 25 and 4 <= found[2][1] <= 8


def test_op7_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = registry.op7_histogram_sort_shards(spark, sf).collect()
    check_shards(docs, rows, 16, max(len(t.encode()) for _, t in docs) + 1)
    crc = {d: zlib.crc32((t or "").encode()) for d, t in docs}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows)
