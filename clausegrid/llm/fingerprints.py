"""MinHash fingerprints of documents and of their edited texts (operator 8).

The last quarter of a text is replaced by the beginning of the next document in ascending doc_id.
Boundaries that are doc_ids themselves cut the table into ranges; a row that begins a range also goes,
as context, to the range before (the smallest of all to the last range), so one shuffle brings every
row and its successor together and tasks stream through their sorted rows. Ranges have about equal bytes,
and there are as many as the text needs.

A fingerprint is the hex of the signature; likeness is the share of equal minima. ``near_groups``
joins signature bands in Spark and verifies the Jaccard similarity on full shingle sets.

Defined results: a null text is an empty one. Two empty texts are alike (1.0), an empty and another
are not. Null doc_ids come first; rows of one doc_id are ordered by text. A single row follows itself.
An empty table gives an empty table. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, text_of
from .neardup import near_duplicates
from .shingles import MinHash, batches, shingle_hashes

_LOW = -(1 << 63)
#: Bytes of text that one task gets, as far as single documents allow.
TASK_BYTES = 256 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(texts: list[bytes], k: int, hashes: MinHash, lower: bool = False) -> np.ndarray:
    out = [hashes.signatures(*shingle_hashes(texts[s], k, lower)) for s in batches([len(t) for t in texts])]
    return np.concatenate(out) if out else np.zeros((0, len(hashes.a)), np.uint32)


def edit(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or all) of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _parts(text: str, edited: str, k: int) -> tuple[bytes, bytes, bytes]:
    """(shared, of the text, of the edited text): the shingles of a text are those of the first and its own part."""
    cut = len(text) - len(text) // 4
    head, whole, other = text[:cut].encode(), text.encode(), edited.encode()
    words = head.rsplit(None, k)
    if len(words) <= k:
        return b"", whole, other
    begin = head.index(words[1], len(words[0]))
    return head[: len(head.rstrip()) - len(words[-1])], whole[begin:], other[begin:]


def _even(sized: DataFrame, edges: list[int] | None, n: int) -> list[int]:
    """Those of the fine ``edges`` (of equal rows) that cut the table into about ``n`` ranges of equal bytes."""
    if not edges:
        return []
    at = np.array(sorted(set(edges)), np.int64)

    @F.pandas_udf("int")
    def place(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, doc.to_numpy(np.int64), "right"))

    sums = np.zeros(len(at) + 1, np.int64)
    for r in sized.groupBy(place("doc_id").alias("at")).agg(F.sum("size").alias("n")).collect():  # a row a fine range
        sums[r["at"]] = r.n
    share = max(1, -(-int(sums.sum()) // n))
    steps = np.cumsum(sums)[:-1] // share
    return at[np.flatnonzero(np.diff(np.concatenate(([0], steps))) > 0)].tolist()


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(pid, flag, doc_id, text) sorted in each partition: the rows of a range (flag 0) and then its context (1)."""
    spark = docs.sparkSession
    narrow = bound_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("doc_id"), text_of(text).alias("text"))
    sized = narrow.select("doc_id", (F.octet_length("text") + 16).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    n = 4 * parts  # ranges, dealt by hash; a few to a task even out
    found = narrow.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 80 * n)).first()
    found = (found[0], _even(sized, found[1], n))
    least = found[0]
    edges = sorted({e for e in found[1] or [] if e != least})
    last = len(edges)
    at = np.array(edges, np.int64)

    @F.pandas_udf("array<long>")
    def places(doc: pd.Series) -> pd.Series:
        """Where a row goes: its range, and as context (coded by -1 - range) the range before."""
        d = doc.to_numpy(np.int64)
        pid = np.searchsorted(at, d, "right")
        begins = (pid > 0) & (at[np.maximum(pid - 1, 0)] == d) if last else np.zeros(len(d), bool)
        return pd.Series([[p, *([-p] if b else []), *([-1 - last] if v == least else [])] for p, b, v in zip(pid.tolist(), begins.tolist(), d.tolist())])

    spread = narrow.withColumn("to", F.explode(places("doc_id")))
    placed = spread.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("pid"), (F.col("to") < 0).cast("int").alias("flag"), "doc_id", "text")
    return placed.repartition(parts, "pid").sortWithinPartitions("pid", "flag", "doc_id", "text")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents whose signatures share a band and whose sets have the similarity, joined into groups."""
    return near_duplicates(docs, k, percent, key=key, text=text)


def fingerprint_edits(docs: DataFrame, n_hashes: int = 128, k: int = 5, seed: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(n_hashes, seed)
        held: pd.DataFrame | None = None  # the last row, whose successor is still to come
        for pdf in it:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                rows = some if held is None else pd.concat([held, some])
                held = rows.iloc[-1:]
                pids, flags, ids, texts = (rows[c].tolist() for c in ("pid", "flag", "doc_id", "text"))
                # a row counts if the next one is of its range; context rows end a range
                own = [i for i in range(len(rows) - 1) if flags[i] == 0 and pids[i + 1] == pids[i]]
                if not own:
                    continue
                edited = [edit(texts[i], texts[i + 1]) for i in own]
                parts = [_parts(texts[i], e, k) for i, e in zip(own, edited)]
                flat = [x for p in parts for x in p]
                sig = signatures(flat, k, hashes).reshape(len(own), 3, n_hashes)
                mine, other = np.minimum(sig[:, 0], sig[:, 1]), np.minimum(sig[:, 0], sig[:, 2])
                nth = {i: j for j, i in enumerate(own)}
                late = [i + 1 for i in own if i + 1 not in nth]
                of_late = dict(zip(late, signatures([texts[i].encode() for i in late], k, hashes)))
                after = np.array([mine[nth[i + 1]] if i + 1 in nth else of_late[i + 1] for i in own])
                yield pd.DataFrame(
                    {
                        "doc_id": [None if ids[i] == _LOW else ids[i] for i in own],
                        "n_chars": [len(texts[i]) for i in own],
                        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                        "fingerprint": [s.astype(">u4").tobytes().hex() for s in mine],
                        "edited_fingerprint": [s.astype(">u4").tobytes().hex() for s in other],
                        "near_edited": (mine == other).mean(1),
                        "near_next": (mine == after).mean(1),
                    }
                ).astype({"doc_id": "Int64"})

    return with_next(docs, key, text).mapInPandas(task, SCHEMA)
