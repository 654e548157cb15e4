"""Shards of near-equal bytes by a histogram sort (operator 7).

Rows are ordered by (hash of the text, doc_id). Each round counts, over all partitions, the exact bytes
and rows below a set of candidate boundaries and the smallest and largest key between neighbours; the
brackets around the targets shrink until each boundary is within tolerance, then the rows move once.
Boundaries on the hash alone come first, so equal texts stay together where the tolerance allows it; a
group heavier than that is cut by doc_id. Between two shard boundaries lie loose ones, so the sort
inside a shard is shared by many tasks and slots follow from the counts below a boundary.

The driver sees sums for a bounded number of probes, never rows. Keys (hash, doc_id, size) are stored
once in the shared folder, as every round reads them.

Defined results: a null text has 0 bytes (size 1) and the checksum of no bytes, 0. Null doc_ids sort
first. Rows equal in text and doc_id have one key and share a shard; their slots differ. An empty table
gives an empty table. Extra columns are kept by ``shard_rows`` and left out by the query.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bound_batches, fresh_name, stored, text_of, with_arrays

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int]


def _below(probes: list[Key], h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each key the number of probes that aren't above it."""
    ph, pd_ = np.array([p[0] for p in probes], dtype=np.int64), np.array([p[1] for p in probes], dtype=np.int64)
    low, high = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = low.copy()
    for v in np.unique(h[high > low]):
        at = h == v
        a, b = np.searchsorted(ph, v, "left"), np.searchsorted(ph, v, "right")
        out[at] = a + np.searchsorted(pd_[a:b], d[at], "right")
    return out


def histogram(keys: DataFrame, probes: list[Key]) -> list[tuple[int, int, int, Key, Key]]:
    """(interval, bytes, rows, least key, greatest key) of each interval between ``probes`` that has rows.

    The keys of an interval with more than one hash are given by their hashes: (least, lowest id) and (greatest, highest id).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, d = pdf["h"].to_numpy(np.int64), pdf["d"].to_numpy(np.int64)
            part = pd.DataFrame({"b": _below(probes, h, d) if probes else np.zeros(len(h), np.int64), "w": pdf["w"], "h": h, "d": d})
            g = part.groupby("b", sort=False)
            yield pd.DataFrame({"w": g["w"].sum(), "n": g["w"].size(), "h0": g["h"].min(), "h1": g["h"].max(), "d0": g["d"].min(), "d1": g["d"].max()}).reset_index()

    partial = keys.select("h", "d", "w").mapInPandas(count, "b long, w long, n long, h0 long, h1 long, d0 long, d1 long")
    total = partial.groupBy("b").agg(F.sum("w"), F.sum("n"), F.min("h0"), F.max("h1"), F.min("d0"), F.max("d1"))
    return [(b, w, n, (h0, d0), (h1, d1)) for b, w, n, h0, h1, d0, d1 in total.collect()]


def _spread(low: Key, high: Key, n: int) -> list[Key]:
    """Up to ``n`` keys in (low, high], evenly by hash, or by id within one hash."""
    if low[0] == high[0]:
        step = (high[1] - low[1]) / n
        return sorted({(low[0], min(high[1], low[1] + max(1, math.ceil(step * i)))) for i in range(1, n + 1)} - {low})
    step = (high[0] - low[0]) / n
    return sorted({(min(high[0], low[0] + max(1, math.ceil(step * i))), _LOW) for i in range(1, n + 1)})


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]], probes: int = 32, most_rounds: int = 200) -> tuple[list[Key], int]:
    """A boundary for each (bytes below, tolerance), and the total; a boundary belongs to the interval above it.

    Ends when each is within its tolerance or no key lies strictly between its neighbours.
    """
    first = histogram(keys, [])
    if not first:
        return [], 0
    _, total, _, least, greatest = first[0]
    low = least if least[0] == greatest[0] else (least[0], _LOW)
    brackets = {i: (low, greatest) for i in range(len(targets))}
    best: dict[int, tuple[float, Key]] = {i: (t, low) for i, (t, _) in enumerate(targets)}
    for _ in range(most_rounds):
        if not brackets:
            break
        wanted = sorted({p for low, high in brackets.values() for p in (low, *_spread(low, high, probes))})
        seen = {b: (w, a, z) for b, w, _, a, z in histogram(keys, wanted)}
        filled, below = sorted(seen), [0]
        for j in range(len(wanted) + 1):
            below.append(below[-1] + (seen[j][0] if j in seen else 0))
        for i in list(brackets):
            t, tolerance = targets[i]
            j = int(np.searchsorted(below, t, "right")) - 1
            j = filled[max(0, bisect_right(filled, j) - 1)]
            for k in (j, j + 1):  # the boundaries at both ends of the interval that holds the target
                if 0 < k <= len(wanted) and (far := abs(below[k] - t)) < best[i][0]:
                    best[i] = far, wanted[k - 1]
            _, a, z = seen[j]
            if best[i][0] <= tolerance or a == z:
                del brackets[i]
                continue
            low = a if a[0] == z[0] else (a[0], _LOW)
            brackets[i] = (max(low, wanted[j - 1]) if j else low, z)
    return [best[i][1] for i in range(len(targets))], total


def shard_rows(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    spark = bound_batches(docs).sparkSession
    names = {c: fresh_name(docs.columns, c) for c in ("h", "d", "w", "range_no", "before")}
    h, d, w, r, before = (names[c] for c in ("h", "d", "w", "range_no", "before"))
    for c in ("size", "shard", "slot"):
        docs = docs.drop(c)
    keyed = docs.withColumns({h: F.xxhash64(text_of(text)), d: F.coalesce(F.col(key).cast("long"), F.lit(_LOW)), w: (F.octet_length(text_of(text)) + 1).cast("long")})
    keys = stored(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(w).alias("w")), "shard-keys")
    inner = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards))
    total = keys.agg(F.sum("w")).first()[0] or 0
    share = total / n_shards
    targets = [(share * i / inner, share * (tolerance / 2 if i % inner == 0 else 0.25 / inner)) for i in range(1, n_shards * inner)]
    found, _ = find_splitters(keys, targets) if total else ([], 0)
    for i in range(1, len(found)):  # loose boundaries may pass an exact one
        found[i] = max(found[i], found[i - 1])
    outer = [found[i - 1] for i in range(inner, n_shards * inner, inner)] if found else []
    edges = sorted(set(found))
    rows_below, counts = 0, {b: n for b, _, n, _, _ in histogram(keys, edges)} if total else {}
    ranges, start = [], {}
    for b in range(len(edges) + 1):
        shard = bisect_right(outer, edges[b - 1]) if b else 0
        start.setdefault(shard, rows_below)
        ranges.append((b, shard, rows_below - start[shard]))
        rows_below += counts.get(b, 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _below(edges, batch.column(h).to_numpy(), batch.column(d).to_numpy()) if edges else np.zeros(batch.num_rows, np.int64)
            yield with_arrays(batch, **{r: pa.array(at, pa.int64())})

    placed = keyed.mapInArrow(place, keyed.withColumn(r, F.lit(0).cast("long")).schema)
    of_range = F.broadcast(spark.createDataFrame(ranges, f"{r} long, shard int, {before} long"))  # one row a boundary
    inside = F.row_number().over(W.partitionBy(r).orderBy(h, d))
    out = placed.withColumn("slot", inside).join(of_range, r).withColumn("slot", F.col("slot") - 1 + F.col(before))
    return out.select(*docs.columns, F.col(w).alias("size"), "shard", F.col("slot").cast("long").alias("slot"))
