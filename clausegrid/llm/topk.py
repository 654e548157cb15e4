"""Exact top-k by inner product with a dual-tree search over cover trees (operator 6).

Data and queries are cut into blocks of near vectors: a net of centres from a bounded sample names the
cells, cells larger than a block are split by hash. Each block gets a cover tree: a node's children are
a greedy net of its points at half its scale, the first child being the node's own centre, so children
cover within the scale and lie apart by more than it. Where such a net would need nearly as many centres
as there are points the node is a leaf, since no child would be smaller. A pair of nodes (Q, D) can't hold
a score above <cq,cd> + |cq| rd + |cd| rq + rq rd; the pair is pruned when that is below the worst k-th
score of the queries in Q.

1. Each query meets one block of its own cell, which sets its k-th score.
2. The bound is taken for pairs of whole blocks, from their centres and radii alone. Blocks that are pruned
   for a group of the other side never travel to it.
3. Groups of query blocks meet the groups of data blocks that are left, pruning pairs of nodes as k-th
   scores rise; a last window takes the best k of what the groups found.

Every row is indexed and the search is exact; the sample only shapes the blocks. Scores are integer
inner products (in doubles where they are exact there, else in 64-bit integers).

Defined results: vectors that are null, empty or hold null or non-finite components take no part; nor do
those with a scaled squared norm of 2**62 or more, whose scores wouldn't fit 64 bits. Equal vectors keep
their k + 1 smallest ids in the index, more can't enter a result. A repeated (id, vector) counts once.
Different vectors of one id are one query with the k best scores of them all, and as many candidates. Ties
go to the smaller id; a query has fewer rows if there are fewer candidates of its dimension. Extra columns
play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stored

#: Rows of the sample that shapes the cells; cells at most; vectors in a block; queries in a block; points in a leaf.
SAMPLE, CELLS, BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 4096, 512, 64
#: Query blocks and data blocks that one search task holds; groups of either whose bounds one task takes.
QUERY_GROUP, DATA_GROUP, BOUND_GROUPS = 128, 32, 64
_NONE = np.iinfo(np.int64).min


def scaled(df: DataFrame, vector: str = "embedding", scale: int = 256):
    """``vector`` as floor(scale * x) longs, null where it takes no part."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda n, v: n + F.pow(F.floor(v.cast("double") * scale).cast("double"), 2))
    return F.when(fine & (square < 2.0**62), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


class CoverTree:
    """Points in tree order; nodes as arrays (centre, radius, range of points, range of children)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.center, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        order: list[np.ndarray] = []
        f = x.astype(np.float64)
        size = 0

        def build(at: np.ndarray, center: int, scale: float) -> int:
            nonlocal size
            me = len(self.center)
            dist = np.sqrt(((f[at] - f[center]) ** 2).sum(1))
            self.center.append(center)
            self.radius.append(float(dist.max()))
            self.lo.append(size)
            self.hi.append(size)
            self.kids.append([])
            if len(at) <= leaf or self.radius[me] == 0:
                order.append(at)
                size += len(at)
            else:
                half = min(scale, self.radius[me]) / 2
                near, owner, centers = dist.copy(), np.zeros(len(at), np.int64), [center]
                most = max(8, int(4 * len(at) ** 0.5))
                while near.max() > half and len(centers) <= most:
                    c = at[int(near.argmax())]
                    d = np.sqrt(((f[at] - f[c]) ** 2).sum(1))
                    owner[d < near] = len(centers)
                    near = np.minimum(near, d)
                    centers.append(c)
                if near.max() > half:  # points nearly all apart: no net of half the scale is much smaller than they are
                    order.append(at)
                    size += len(at)
                else:
                    for k, c in enumerate(centers):
                        if (owner == k).any():
                            self.kids[me].append(build(at[owner == k], c, half))
            self.hi[me] = size
            return me

        if len(ids):
            mean = f.mean(0)
            build(np.arange(len(ids)), int(((f - mean) ** 2).sum(1).argmin()), np.inf)
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.x = ids[at], x[at]
        self.center = f[self.center] if len(ids) else f[:0]
        self.norm = np.sqrt((self.center**2).sum(1))

    def dump(self) -> bytes:
        out = io.BytesIO()
        kids = np.array([k for ks in self.kids for k in ks], np.int64)
        most = int(np.abs(self.x).max(initial=0))
        small = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)  # what travels
        np.savez(out, ids=self.ids, x=self.x.astype(small), center=self.center, norm=self.norm, radius=np.array(self.radius), lo=np.array(self.lo), hi=np.array(self.hi), kids=kids, n_kids=np.array([len(k) for k in self.kids], np.int64))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        self = cls.__new__(cls)
        got = np.load(io.BytesIO(data))
        for name in ("ids", "x", "center", "norm", "radius", "lo", "hi"):
            setattr(self, name, got[name])
        self.x = self.x.astype(np.int64)
        self.kids = [x.tolist() for x in np.split(got["kids"], np.cumsum(got["n_kids"])[:-1])]
        return self


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query of a tree, in its order."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        use = (scores >= self.score[rows, -1:]).any(1)
        if not use.any():
            return
        rows, scores = rows[use], scores[use]
        s = np.hstack([self.score[rows], scores])
        i = np.hstack([self.id[rows], np.broadcast_to(ids, scores.shape)])
        i = np.where(s == _NONE, np.iinfo(np.int64).max, i)
        at = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s != _NONE]).max(initial=0) < 2**52 else ~s), axis=-1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def bounds(qc: np.ndarray, qr: np.ndarray, dc: np.ndarray, dr: np.ndarray) -> np.ndarray:
    """What no inner product exceeds of a point within ``qr`` of ``qc`` and one within ``dr`` of ``dc``, for all pairs."""
    qn, dn = np.sqrt((qc**2).sum(1)), np.sqrt((dc**2).sum(1))
    v = qc @ dc.T + qn[:, None] * dr[None] + qr[:, None] * (dn + dr)[None]
    return v + 1e-9 * (np.abs(v) + qn[:, None] * dn[None]) + 1e-6


def dual_search(q: CoverTree, d: CoverTree, best: Best, floor: np.ndarray) -> int:
    """Fill ``best`` with candidates from ``d``; ``floor`` has k-th scores known from elsewhere. Returns the products made."""
    if not len(q.ids) or not len(d.ids):
        return 0
    made = 0

    def bound(a: int, b: int) -> float:
        v = float(q.center[a] @ d.center[b]) + q.norm[a] * d.radius[b] + d.norm[b] * q.radius[a] + q.radius[a] * d.radius[b]
        return v + 1e-9 * (abs(v) + q.norm[a] * d.norm[b]) + 1e-6

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        limit, a, b = stack.pop()
        rows = slice(q.lo[a], q.hi[a])
        if limit < np.maximum(best.score[rows, -1], floor[rows]).min():
            continue
        q_kids, d_kids = q.kids[a], d.kids[b]
        if not q_kids and not d_kids or (q.hi[a] - q.lo[a]) * (d.hi[b] - d.lo[b]) <= LEAF * LEAF:
            scores = _products(q.x[rows], d.x[d.lo[b] : d.hi[b]])
            ids = d.ids[d.lo[b] : d.hi[b]]
            made += scores.size
            scores[q.ids[rows, None] == ids[None]] = _NONE
            best.add(np.arange(q.lo[a], q.hi[a]), scores, ids)
            continue
        if not d_kids or q_kids and q.radius[a] > d.radius[b]:
            pairs = [(bound(k, b), k, b) for k in q_kids]
        else:
            pairs = [(bound(a, k), a, k) for k in d_kids]
        stack += sorted(pairs, key=lambda p: p[0])  # the highest bound comes next
    return made


def _net(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x`` by farthest-first traversal, near ones one after the other."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))

    def halves(at: np.ndarray) -> list[int]:
        if len(at) < 3:
            return at.tolist()
        c = x[at]
        a = c[((c - c[0]) ** 2).sum(1).argmax()]
        b = c[((c - a) ** 2).sum(1).argmax()]
        side = np.argsort(c @ (b - a), kind="stable")
        return halves(at[side[: len(at) // 2]]) + halves(at[side[len(at) // 2 :]])

    return x[halves(np.array(chosen))]


def _vectors(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["x"]), "<i8").reshape(len(pdf), dim)


def exact_topk(df: DataFrame, k: int = 5, query_every: int = 50, key: str = "vec_id", vector: str = "embedding", made: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``, against all rows.

    ``made`` counts the inner products that the search makes (tasks that run again count again).
    """
    spark = df.sparkSession
    found = df.select(df[key].cast("long").alias("vec_id"), scaled(df, vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "dim": [len(v) for v in pdf["v"]], "x": [np.asarray(v, "<i8").tobytes() for v in pdf["v"]]})

    rows = found.mapInPandas(pack, "vec_id long, dim int, x binary")
    own = W.partitionBy("dim", "x").orderBy("vec_id")
    data = rows.withColumn("nth", F.dense_rank().over(own)).where(F.col("nth") <= k + 1).dropDuplicates(["dim", "x", "vec_id"]).drop("nth")
    queries = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["dim", "x", "vec_id"])

    sample: dict[int, list[bytes]] = {}
    for r in data.select("dim", "x", F.xxhash64("x", "vec_id").alias("h")).orderBy("h").limit(SAMPLE).collect():
        sample.setdefault(r.dim, []).append(bytes(r.x))
    cells = min(CELLS, max(2, -(-2 * found.count() // BLOCK)))
    centers = {dim: _net(np.frombuffer(b"".join(x), "<i8").reshape(-1, dim).astype(np.float64), cells) for dim, x in sample.items()}

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.zeros(len(pdf), np.int64)
            for dim, part in pdf.groupby("dim").indices.items():
                if (c := centers.get(int(dim))) is None:  # a dimension that the sample missed is one cell
                    continue
                x = _vectors(pdf.iloc[part], int(dim)).astype(np.float64)
                at[part] = (((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)).astype(np.int64)
            yield pdf.assign(cell=at)

    block_schema = "dim int, cell long, part long, center binary, radius double, tree binary"

    def blocks(part: DataFrame, size: int, label: str) -> DataFrame:
        celled = part.mapInPandas(cell, "vec_id long, dim int, x binary, cell long")
        sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") * 1.25 / size).alias("parts"))
        split = celled.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts"))

        def build(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            dim = int(name[0])
            pdf = pdf.sort_values("vec_id")
            tree = CoverTree(pdf["vec_id"].to_numpy(np.int64), _vectors(pdf, dim))
            return pd.DataFrame({"dim": [dim], "cell": [name[1]], "part": [name[2]], "center": [tree.center[0].tobytes()], "radius": [tree.radius[0]], "tree": [tree.dump()]})

        return stored(split.groupBy("dim", "cell", "part").applyInPandas(build, block_schema), label)

    of_data = _numbered(blocks(data, BLOCK, "topk-data"), DATA_GROUP)
    of_queries = _numbered(blocks(queries, QUERY_BLOCK, "topk-queries"), QUERY_GROUP)

    def first(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of each query within the first block of its own cell."""
        out = []
        home = int(right["block"].iloc[0]) if len(right) else -1
        for r in left.itertuples():
            q = CoverTree.load(r.tree)
            best = Best(len(q.ids), k)
            if home >= 0:
                n = dual_search(q, CoverTree.load(right["tree"].iloc[0]), best, np.full(len(q.ids), _NONE))
                if made is not None:
                    made.add(n)
            out.append((r.dim, r.block, r.grp, r.center, r.radius, r.tree, home, best.score.tobytes(), best.id.tobytes(), int(best.score[:, -1].min())))
        return pd.DataFrame(out, columns=["dim", "block", "grp", "center", "radius", "tree", "home", "score", "found", "worst"])

    homes = of_data.where("part = 0")
    ready = of_queries.groupBy("dim", "cell").cogroup(homes.groupBy("dim", "cell")).applyInPandas(first, "dim int, block long, grp long, center binary, radius double, tree binary, home long, score binary, found binary, worst long")
    ready = stored(ready, "topk-ready")

    def left_over(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Which blocks still have to meet a group of the other side."""
        out = set()
        for dim in set(left["dim"]) & set(right["dim"]):
            q, d = left[left["dim"] == dim], right[right["dim"] == dim]
            qc, dc = (np.frombuffer(b"".join(x["center"]), np.float64).reshape(len(x), dim) for x in (q, d))
            keep = bounds(qc, q["radius"].to_numpy(), dc, d["radius"].to_numpy()) >= q["worst"].to_numpy()[:, None]
            qb, qg, db, dg = (x.to_numpy() for x in (q["block"], q["grp"], d["block"], d["grp"]))
            keep &= q["home"].to_numpy()[:, None] != db  # they have met
            i, j = np.nonzero(keep)
            out.update(zip(qg[i].tolist(), dg[j].tolist(), [0] * len(i), qb[i].tolist()))
            out.update(zip(qg[i].tolist(), dg[j].tolist(), [1] * len(j), db[j].tolist()))
        return pd.DataFrame(sorted(out), columns=["qg", "dg", "side", "block"]).astype("int64")

    # summaries of blocks, in large groups: a few hundred bytes a block
    groups = lambda df: max(1, -(-(1 + (df.agg(F.max("grp")).first()[0] or 0)) // BOUND_GROUPS))
    n_left, n_right = groups(ready), groups(of_data)
    all_of = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    q_short = ready.select("dim", "block", "grp", "center", "radius", "worst", "home", F.expr(f"grp div {BOUND_GROUPS}").alias("a"), all_of(n_right).alias("b"))
    d_short = of_data.select("dim", "block", "grp", "center", "radius", F.expr(f"grp div {BOUND_GROUPS}").alias("b"), all_of(n_left).alias("a"))
    needed = stored(q_short.groupBy("a", "b").cogroup(d_short.groupBy("a", "b")).applyInPandas(left_over, "qg long, dg long, side long, block long"), "topk-needed")

    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    def rows_of(ids: np.ndarray, score: np.ndarray, found: np.ndarray) -> pd.DataFrame:
        have = score != _NONE
        return pd.DataFrame({"query_id": np.repeat(ids, have.sum(1)), "vec_id": found[have], "score": score[have]})

    def meet(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [empty]
        trees = [(b, CoverTree.load(t)) for b, t in zip(right["block"], right["tree"])]
        for r in left.itertuples():
            q = CoverTree.load(r.tree)
            best, floor = Best(len(q.ids), k), np.frombuffer(r.score, np.int64).reshape(-1, k)[:, -1]
            near = [d for b, d in trees if b != r.home and d.x.shape[1] == q.x.shape[1]]
            for d in sorted(near, key=lambda d: -float(q.center[0] @ d.center[0])):
                n = dual_search(q, d, best, floor)
                if made is not None:
                    made.add(n)
            out.append(rows_of(q.ids, best.score, best.id))
        return pd.concat(out)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield rows_of(CoverTree.load(r.tree).ids, *(np.frombuffer(x, np.int64).reshape(-1, k) for x in (r.score, r.found)))

    # the stated query set against all rows, in blocks
    left = needed.where("side = 0").select("qg", "dg", "block").join(ready.select("block", "tree", "score", "home"), "block")
    right = needed.where("side = 1").select(*(F.col(c).alias(c) for c in ("qg", "dg", "block"))).join(of_data.select("block", "tree"), "block")
    schema = "query_id long, vec_id long, score long"
    met = left.groupBy("qg", "dg").cogroup(right.groupBy("qg", "dg")).applyInPandas(meet, schema).unionByName(ready.select("tree", "score", "found").mapInPandas(at_home, schema))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Cells of all dimensions together, a row each on the driver; a table of embeddings has one dimension, or a few.
MOST_CELLS = 1_000_000


def _numbered(blocks: DataFrame, size: int) -> DataFrame:
    """``blocks`` with a unique ``block`` and ``grp``: runs of ``size`` or fewer of them, near cells together."""
    per_cell = blocks.groupBy("dim", "cell").agg((F.max("part") + 1).alias("n")).orderBy("dim", "cell").limit(MOST_CELLS + 1).collect()  # as many rows as cells and dimensions
    if len(per_cell) > MOST_CELLS:
        raise ValueError(f"vectors of so many lengths that they make more than {MOST_CELLS} cells: not a column of embeddings")
    begin, total = [], 0
    for r in per_cell:
        begin.append((r.dim, r.cell, total))
        total += r.n
    at = blocks.sparkSession.createDataFrame(begin, "dim int, cell long, begin long")
    block = F.col("begin") + F.col("part")
    return blocks.join(F.broadcast(at), ["dim", "cell"]).withColumn("block", block).withColumn("grp", F.expr(f"(begin + part) div {size}")).drop("begin")
