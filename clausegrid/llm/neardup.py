"""MinHash near-duplicates with sequential Bayesian verification (operator 4).

1. Each text gives its set of word shingles (64-bit hashes), a 128-bit digest of the set and its band
   keys. Equal sets are one node, named by its smallest doc_id; only nodes go on.
2. Nodes that share a band key are candidates. First each node meets the smallest node of each of its
   buckets. Then, with the components found so far, the buckets that still hold several components are
   searched in blocks: all pairs of different components within a bucket, none within a component.
3. A pair of candidates is compared signature batch by signature batch. After n of its minima with m
   equal, the posterior probability (uniform prior) that the similarity reaches the threshold is a
   binomial tail; below ``miss`` the pair is pruned. What survives all batches is verified on the full
   sets. Within a task, pairs that a found link has joined already are skipped.
4. Links are joined into components.

A bucket's rows are dealt to tasks in blocks of bounded size and come with their sets, so no pair is
ever a row: tasks give only links that join components, fewer than their rows. Texts are read again
only for nodes in shared buckets, through a Bloom filter of fixed size (its errors cost shuffle, not
results) and an exact join. Bands of 4 minima in 28 bands miss a pair of similarity 0.8 with
probability 4e-7.

Defined results: no text or no words: an empty set, linked with nothing. Rows with a null doc_id take
no part (component null, kept). Rows of one doc_id are one node, linked with whatever one of them is
linked with. Equal sets are linked. Extra columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLOOM_BITS, bound_batches, id_column, ids_back, maybe_among, mix64, stored, text_of
from .components import connected_components
from .shingles import MinHash, batches, shingle_hashes

HASHES, BANDS, ROWS, SEED = 128, 28, 4, 4
#: Rows and shingles of a block; members of a pivot in one group (of so many shingles too).
BLOCK_ROWS, BLOCK_SHINGLES, PIVOT_ROWS = 512, 1_500_000, 512
#: Minima compared after each step.
STEPS = (16, 32, 48, 64, 96, 128)


def least_matches(percent: int, miss: float, steps: tuple[int, ...] = STEPS) -> list[int]:
    """For each step the smallest number of equal minima at which P(similarity >= percent / 100) is ``miss`` at least."""
    t, out = percent / 100, []
    for n in steps:
        # the posterior is Beta(m + 1, n - m + 1); its upper tail at t is P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of distinct shingles, text after text and sorted within, and how many each has."""
    for some in batches([len(t) for t in texts]):
        h, counts = shingle_hashes(texts[some], k, lower=True)
        of = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield h[new], np.bincount(of[new], minlength=len(counts))


def _sums(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's values (modulo 2**64)."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


def described(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, s1, s2, bands): the set's size, its digest and its band keys."""
    narrow = bound_batches(docs).select(id_column(docs, key), text_of(text).alias("text"))

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(HASHES, SEED)
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for pdf in it:
            texts, at = [t.encode() for t in pdf["text"]], 0
            for h, counts in _sets(texts, k):
                sig = hashes.signatures(h, counts)[:, : BANDS * ROWS].reshape(len(counts), BANDS, ROWS)
                keys = np.broadcast_to(salt, (len(counts), BANDS)).copy()
                for r in range(ROWS):
                    keys = mix64(keys ^ sig[:, :, r])
                some = pdf["doc_id"].iloc[at : at + len(counts)]
                at += len(counts)
                bands = [b if n else b[:0] for b, n in zip(keys.view(np.int64), counts)]
                yield pd.DataFrame({"doc_id": some, "n": counts, "s1": _sums(h, counts).view(np.int64), "s2": _sums(mix64(h), counts).view(np.int64), "bands": bands})

    return ids_back(narrow.mapInPandas(task, "doc_id long, n long, s1 long, s2 long, bands array<long>"))


def only_needed(docs: DataFrame, needed: DataFrame, key: str, bits: int = BLOOM_BITS) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among ``needed`` (doc_id): a broadcast filter of fixed size, then a semi-join."""
    ids = needed.select(F.col("doc_id").alias(key)).distinct()
    return docs.where(maybe_among(needed, F.col(key).cast("long"), bits)).join(ids, key, "left_semi")


def without_ids(docs: DataFrame, gone: DataFrame, key: str, bits: int = BLOOM_BITS) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't among ``gone`` (doc_id); rows that the filter clears aren't shuffled."""
    maybe = maybe_among(gone, F.col(key).cast("long"), bits)
    ids = gone.select(F.col("doc_id").alias(key)).distinct()
    return docs.where(~maybe).unionByName(docs.where(maybe).join(ids, key, "left_anti").select(docs.columns))


class Links:
    """Finds links between the rows of one group; ``parent`` joins components as it goes."""

    def __init__(self, percent: int, miss: float):
        self.percent, self.hashes = percent, MinHash(HASHES, SEED)
        self.least = least_matches(percent, miss)

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def within(self, ids: list[int], components: list[int], sides: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        """Links of pairs (left, right); side 0 is left, 1 right, 2 both."""
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        counts = np.array([len(a) for a in arrays])
        sig = self.hashes.signatures(np.concatenate(arrays), counts)
        self.parent = {c: c for c in components}
        of, side = np.array(components), np.array(sides)
        out = []
        for i in np.flatnonzero(side != 1):
            others = np.flatnonzero((side != 0) & (of != of[i]))
            if sides[i] == 2:
                others = others[(others > i) | (side[others] == 1)]
            # equal sets aside, a similarity of t needs sizes within a factor of t
            a, b = counts[i], counts[others]
            others = others[100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)]
            done, equal = 0, np.zeros(len(others), np.int64)
            for step, least in zip(STEPS, self.least):
                equal += (sig[others, done:step] == sig[i, done:step]).sum(1)
                keep = equal >= least
                others, equal, done = others[keep], equal[keep], step
            for j in others[np.argsort(-equal, kind="stable")].tolist():
                x, y = self._find(components[i]), self._find(components[j])
                if x == y:
                    continue
                both = len(np.intersect1d(arrays[i], arrays[j], assume_unique=True))
                if 100 * both >= self.percent * (counts[i] + counts[j] - both):
                    self.parent[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return out


def _links(rows: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) within the groups of ``rows`` (g, side, doc_id, component)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.join(sets, "doc_id").repartition(parts, "g").sortWithinPartitions("g", "side", "doc_id")

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, held = Links(percent, miss), None

        def found(pdf: pd.DataFrame) -> list[tuple[int, int]]:
            out = []
            edges = np.flatnonzero(np.diff(pdf["g"].to_numpy())) + 1
            ids, comps, sides, data = (pdf[c].tolist() for c in ("doc_id", "component", "side", "hashes"))
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)]):
                out += links.within(ids[a:b], comps[a:b], sides[a:b], data[a:b])
            return out

        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf])
            g = pdf["g"].to_numpy()
            open_ = int(np.argmax(g == g[-1])) if len(g) else 0
            held = pdf.iloc[open_:]
            if open_:
                yield pd.DataFrame(found(pdf.iloc[:open_]), columns=["a", "b"])
        if held is not None and len(held):
            yield pd.DataFrame(found(held), columns=["a", "b"])

    return ready.select("g", "side", "doc_id", "component", "hashes").mapInPandas(task, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document."""
    base = stored(described(docs, k, key, text), "near-described")
    known = base.where("doc_id IS NOT NULL AND n > 0")
    # stored, so that the join below has an exchange on either side and AQE may split a hot set of copies
    classes = stored(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "near-classes")
    members = stored(base.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "node"), "near-members")
    several = members.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1")  # a doc_id of several texts
    own_links = several.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))

    nodes = members.where("doc_id = node").select("doc_id").distinct()
    banded = stored(known.join(nodes, "doc_id", "left_semi").select("doc_id", "n", F.explode("bands").alias("bucket")).distinct(), "near-bands")
    shared = stored(banded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("bucket", "pivot"), "near-shared")
    bucketed = stored(banded.join(shared, "bucket"), "near-buckets")

    needed = bucketed.select("doc_id").distinct()

    def hashed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = 0
            for h, counts in _sets([t.encode() for t in pdf["text"]], k):
                parts = np.split(h, np.cumsum(counts)[:-1])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(counts)], "shingles": counts, "hashes": [p.tobytes() for p in parts]})
                at += len(counts)

    narrow = docs.select(docs[key].cast("long").alias("doc_id"), text_of(text).alias("text"))
    sets = stored(only_needed(narrow, needed, "doc_id").mapInPandas(hashed, "doc_id long, shingles long, hashes binary").where("shingles > 0"), "near-sets")

    # every node with the smallest of each of its buckets
    stars = bucketed.where("doc_id > pivot").groupBy("doc_id", "pivot").agg(F.max("n").alias("n"))
    salts = stars.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / PIVOT_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("salts"))
    right = stars.join(salts, "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("doc_id"), "salts")).alias("g"), F.lit(1).alias("side"), "doc_id", F.col("doc_id").alias("component"))
    left = salts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select(F.xxhash64("pivot", "salt").alias("g"), F.lit(0).alias("side"), F.col("pivot").alias("doc_id"), F.col("pivot").alias("component"))
    first = stored(_links(left.unionByName(right), sets.drop("shingles"), percent, miss).unionByName(own_links), "near-links")

    # what is left: pairs of different components in one bucket
    found = connected_components(first)
    placed = bucketed.select("bucket", "doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    size = sets.groupBy("doc_id").agg(F.max("shingles").alias("shingles"))
    placed = stored(placed.join(size, "doc_id"), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).alias("x"), F.bit_xor(F.xxhash64("doc_id")).alias("y")).where("low < high")
    once = mixed.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")  # buckets of the same members need one search
    once = stored(once, "near-once")
    inside = stored(placed.join(once, "bucket"), "near-inside")
    large = inside.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("shingles").alias("s"))
    large = large.select("bucket", "component", "m", "s", ((F.col("m") > BLOCK_ROWS) | (F.col("s") > BLOCK_SHINGLES)).alias("alone"))
    blocks_of = lambda m, s: F.ceil(F.greatest(m / BLOCK_ROWS, s / BLOCK_SHINGLES, F.lit(1.0)))
    rest = large.where("NOT alone").groupBy("bucket").agg(blocks_of(F.sum("m"), F.sum("s")).alias("rest"))
    dealt = large.withColumn("own", blocks_of(F.col("m"), F.col("s"))).join(rest, "bucket", "left")
    # components larger than a block have their own blocks, all others share some
    part = F.when(F.col("alone"), F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), "own"))).otherwise(F.pmod(F.xxhash64("component"), "rest"))
    dealt = stored(inside.join(dealt.select("bucket", "component", "alone", "own", "rest"), ["bucket", "component"]).select("bucket", "doc_id", "component", part.alias("part"), F.when(F.col("alone"), F.col("component")).alias("whole")), "near-blocks")
    parts = dealt.groupBy("bucket", "part").agg(F.max("whole").alias("whole"))
    one, two = parts.select("bucket", F.col("part").alias("p"), F.col("whole").alias("w")), parts.select("bucket", F.col("part").alias("q"), F.col("whole").alias("v"))
    pairs = one.join(two, "bucket").where("p <= q AND (w IS NULL OR v IS NULL OR w <> v)")
    group = F.xxhash64("bucket", "p", "q").alias("g")
    met = dealt.withColumnRenamed("part", "p").join(pairs, ["bucket", "p"]).select(group, F.when(F.col("p") == F.col("q"), 2).otherwise(0).alias("side"), "doc_id", "component")
    met = met.unionByName(dealt.withColumnRenamed("part", "q").join(pairs.where("p < q"), ["bucket", "q"]).select(group, F.lit(1).alias("side"), "doc_id", "component"))
    second = _links(met, sets.drop("shingles"), percent, miss)
    links = stored(first.unionByName(second), "near-links")

    joined = connected_components(links).select("node", F.col("component").alias("joined"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("joined", "node", "doc_id"))
    out = members.join(joined, "node", "left").withColumn("component_id", component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest doc_id.

    Documents are told apart by doc_id: rows that repeat the kept doc_id all stay, and so do all rows with a null one.
    """
    gone = stored(near_duplicates(docs, k, percent, key=key, text=text).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return without_ids(docs, gone, key)
