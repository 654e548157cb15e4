"""Substring dedup by hashing lines or paragraphs (operator 5).

A text is cut into units, lines by default, that together are the text again. A unit is normalised (lower
case, white space runs to one space) and digested to 128 bits, whatever its size, unless it is blank.
Digests are grouped over all documents; the occurrence of the smallest (doc_id, place) stays and every
other one goes. Documents keep what remains, in order and unchanged, and the removed stretches as offsets
in the original text.

The registered query hashes lines and nothing else; the pipeline asks for ``passages``, which finds more than that: what two documents share within lines that differ. Then the sentences
of a line are digested too, those of ``SENTENCE`` words or more alone and shorter ones together with as
many neighbours as make that size, and repeats go that stand in a run of at least ``passages`` words of
them, so that a stock sentence in an otherwise new line stays. What is long without white space, or in a
script that sets none, counts by its characters (``size``).

Counting by digest combines map-side; the join that finds the occurrences beyond the first is one that
AQE may split, so a line that a third of all rows share is no single task's work. Only texts that lose
something pass a shuffle, all others are told apart by a filter of fixed size.

Defined results: a null text stays null, an empty one empty. Rows that repeat (doc_id, text) are one
document and get one result; null doc_ids rank first. Blank units stay. A text may become empty. Extra
columns are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLOOM_BITS, NO_ID, bound_batches, fresh_name, maybe_among, stored, with_arrays

#: Where a unit ends; what matches stays with the unit before it.
UNITS = {
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "paragraph": re.compile(r"(?:(?!\n[ \t\r]*\n)[\s\S])*\n(?:[ \t\r]*\n)+|(?:(?!\n[ \t\r]*\n)[\s\S])+"),
    "sentence": re.compile(r"(?:[^\n.!?。！？｡]|[.!?](?![.!?\s]|$)|[.!?](?=[.!?]))*(?:[。！？｡]+[」』”’）]*[ \t\r\u3000]*\n?|[.!?][ \t\r]+|[.!?]?\n|[.!?]$)|[^\n。！？｡]+"),
}
#: Letters of scripts that set no space between words: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def size(unit: str) -> int:
    """Words; where that is more, one for every 12 characters or every 2 letters of scripts without spaces."""
    words = unit.split()
    n = max(len(words), sum(map(len, words)) // 12)
    return n if unit.isascii() else max(n, len(_SPACELESS.findall(unit)) // 2)


#: Words of a sentence that is digested alone.
SENTENCE = 5


def pieces(units: list[str], passages: int = 0) -> list[tuple[int, int, bool]]:
    """What is digested, in order: first and last unit, and whether a later one goes whatever stands around it.

    Without ``passages`` that is every unit that isn't blank. With it the units are sentences, and the pieces
    are the lines; the sentences of ``SENTENCE`` words; and each shorter one with as many after it, and before
    it, as make that size. A line of long sentences that is a run by itself needs no digest of its own.
    """
    sizes = [size(u) for u in units]
    if not passages:
        return [(i, i, True) for i, n in enumerate(sizes) if n]
    found = {(i, i): (i, i, False) for i, n in enumerate(sizes) if n >= SENTENCE}  # by first and last unit with words
    begin = 0
    for i, u in enumerate(units):
        if not u.endswith("\n") and i + 1 < len(units):
            continue
        line = [j for j in range(begin, i + 1) if sizes[j]]
        if len(line) == 1 or line and (sum(sizes[j] for j in line) < passages or any(sizes[j] < SENTENCE for j in line)):
            found[line[0], line[-1]] = (begin, i, True)
        begin = i + 1
    filled = [i for i, n in enumerate(sizes) if n]
    spans = set()
    for x, i in enumerate(filled):
        if sizes[i] >= SENTENCE:
            continue
        for step in (1, -1):
            y, words = x, sizes[i]
            while words < SENTENCE and 0 <= y + step < len(filled):
                y += step
                words += sizes[filled[y]]
            if words >= SENTENCE:
                spans.add((i, filled[y]) if step > 0 else (filled[y], i))
    ends: dict[bytes, int] = {}  # where a digest was last taken, so that a repeat never overlaps its original
    for a, b in sorted(spans.difference(found)):
        name = digest(units[a : b + 1])
        if ends.get(name, -1) < a:
            ends[name] = b
            found[a, b] = (a, b, False)
    return [found[x] for x in sorted(found)]


def digest(units: list[str]) -> bytes:
    return hashlib.md5(" ".join("".join(units).lower().split()).encode(), usedforsecurity=False).digest()


def in_runs(units: list[str], repeated: set[int], passages: int) -> set[int]:
    """Those of the places ``repeated`` whose run has ``passages`` words; new units of ``SENTENCE`` words together end a run."""
    out, run, words, new = set(), [], 0, 0
    for i, u in enumerate(units):
        n = size(u)
        new = 0 if i in repeated else new + n
        if i in repeated:
            run.append(i)
            words += n
        elif new >= SENTENCE:
            out.update(run if words >= passages else ())
            run, words = [], 0
    out.update(run if words >= passages else ())
    return out


def without(text: str, repeated: list[int], unit: str, passages: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without its repeated pieces that go, and their stretches, neighbours joined."""
    units = cut(text, unit, passages)
    every = pieces(units, passages)
    gone = {i for p in repeated for i in range(every[p][0], every[p][1] + 1)}
    if passages:
        gone = in_runs(units, gone, passages)
        for p in repeated:
            if every[p][2]:
                gone.update(range(every[p][0], every[p][1] + 1))
    kept, spans, at = [], [], 0
    for i, u in enumerate(units):
        if i in gone:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(u))
            else:
                spans.append((at, at + len(u)))
        else:
            kept.append(u)
        at += len(u)
    return "".join(kept), spans


def cut(text: str, unit: str, passages: int) -> list[str]:
    return UNITS["sentence" if passages else unit].findall(text)


def dedup_units(docs: DataFrame, unit: str = "line", passages: int = 0, key: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """``docs`` with later repeats of units taken out of ``text`` and their original stretches in ``removed``."""
    if passages and unit != "line":
        raise ValueError("passages are looked for within lines")
    docs = bound_batches(docs).drop(removed)
    ident, hashed = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    keyed = docs.where(F.col(text).isNotNull()).select(ident.alias("k"), hashed.alias("t"), F.col(text).alias("text"))

    def digests(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for start in range(0, len(pdf), 500):
                some = pdf.iloc[start : start + 500]
                at, found, count = [], [], []
                for one in some["text"]:
                    units = cut(one, unit, passages)
                    got = pieces(units, passages)
                    at += range(len(got))
                    found += [digest(units[a : b + 1]) for a, b, _ in got]
                    count.append(len(got))
                two = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"a": two[:, 0], "b": two[:, 1], "k": np.repeat(some["k"].to_numpy(), count), "t": np.repeat(some["t"].to_numpy(), count), "at": np.array(at, np.int32)})

    units = stored(keyed.mapInPandas(digests, "a long, b long, k long, t long, at int"), "units")
    repeated = units.groupBy("a", "b").agg(F.min(F.struct("k", "t", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    first = stored(repeated, "units-first")  # so that the join below has an exchange on either side and AQE may split it
    later = units.join(first, ["a", "b"]).where("struct(k, t, at) != first")
    gone = stored(later.groupBy("k", "t").agg(F.sort_array(F.collect_set("at")).alias("at")), "units-gone")  # bounded by a document's pieces

    k, t, at = (fresh_name([*docs.columns, removed], c) for c in ("k", "t", "at"))
    keyed_docs = docs.withColumns({k: ident, t: hashed})
    name = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    touched = maybe_among(gone.select(name("k", "t").alias("doc_id")), name(k, t), BLOOM_BITS)
    places = gone.select(F.col("k").alias(k), F.col("t").alias(t), F.col("at").alias(at))
    lost = keyed_docs.where(touched).join(places, [k, t], "left").select(*docs.columns, at)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, cuts = [], []
            for one, places in zip(batch.column(text).to_pylist(), batch.column(at).to_pylist()):
                if places is None or one is None:
                    texts.append(one)
                    cuts.append([])
                else:
                    left, stretches = without(one, places, unit, passages)
                    texts.append(left)
                    cuts.append([{"start": a, "end": b} for a, b in stretches])
            kept = batch.select([c for c in batch.schema.names if c != at])
            yield with_arrays(kept, **{text: pa.array(texts, pa.string()), removed: pa.array(cuts, stretch)})

    stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    rebuilt = lost.mapInArrow(rebuild, T.StructType([*docs.schema.fields, T.StructField(removed, spans)]))
    same = keyed_docs.where(~touched).select(*docs.columns, F.array().cast(spans).alias(removed))
    return same.unionByName(rebuilt)
