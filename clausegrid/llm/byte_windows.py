"""Repeated windows of bytes anywhere in a corpus, removed wherever they stand (operator 12).

A byte goes if it lies in a string of ``least`` bytes that begins at another place of the corpus too. Equal windows
have the same smallest hash among their k-grams, so each run of neighbouring windows with one smallest hash m makes a segment,
and windows are compared only between segments of equal m:

* segments that occur twice as a whole (equal m and digest) go wherever they occur;
* of each different segment of an m that has several, or that may repeat within itself, one copy is fetched from its
  text; copies of a bounded number of bytes share a Burrows-Wheeler transform (``bwt``), which tells their
  repeated windows;
* an m with more than ``MANY`` different segments (a passage that very many documents share) is taken out of the
  transforms. Windows of a segment that have the chosen k-gram at about the same place share a core, so such segments are
  split by that place and regrouped by their cores, finer and finer until few enough differ, at last window by window.

Counts and minima combine before they are shuffled, joins are ones that AQE may split. Rows of segments have 48 bytes, one for
about 70 bytes of text; texts move twice: those that a copy is fetched from, and those that lose something.

Defined results: a null text is the empty string. Texts shorter than ``least`` bytes lose nothing. Rows that repeat (doc_id,
text) are documents of their own: they lose all their windows. Null doc_ids are fine. Removal is by bytes, so what is left of
a text may be no UTF-8; offsets are those of the input. Extra columns are kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from ._common import BLOOM_BITS, bound_batches, fresh_name, maybe_among, mix64, one_name, row_key, stored, text_of, with_arrays

#: Bytes of the k-grams whose hashes choose segments; a power of two below every ``least``.
GRAM = 64
#: Windows of a segment at most; longer runs (periodic texts) are cut.
RUN = 1024
#: Bytes of text that are looked at together; longer texts are cut into parts that overlap.
BLOCK = 1 << 19
#: Different segments of one m that share a transform.
MANY = 1000
#: Windows of a piece when a crowd of segments is split; each further split makes this many times smaller pieces.
WIDTH, FINER = 64, 4
#: Bytes of segments that a transform takes before the next m begins.
TRANSFORM = 1 << 19


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hashes of all k-grams (``k`` a power of two)."""
    x = mix64(data.astype(np.uint64) + np.uint64(1))
    base, n = 0xD6E8FEB86659FD93, 1
    while n < k:
        x = x[:-n] * np.uint64(base) + x[n:]
        base, n = base * base % (1 << 64), 2 * n
    return mix64(x)


def _sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def segments(data: bytes, sizes: list[int], least: int, gram: int = GRAM, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, smallest hash, may repeat within itself) of the segments of texts of ``sizes`` bytes that together are ``data``.

    Every window that lies within one text begins in exactly one segment, at most ``least - 1`` bytes before its end.
    """
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    span = least - gram + 1  # k-grams of a window
    low = _sliding(np.minimum, hashes, span)
    n = len(low)
    ends = np.cumsum(np.array(sizes, np.int64))
    starts = ends - np.array(sizes, np.int64)
    long = ends - starts >= least
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - least + 1, -1)
    inside = np.cumsum(step[:n]) > 0
    text = np.searchsorted(starts, np.arange(n), "right") if len(starts) > 1 else np.zeros(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    begin, end = begin[inside[begin]], end[inside[begin]]
    for i in np.flatnonzero(end - begin > run)[::-1]:
        cuts = np.arange(begin[i] + run, end[i], run)
        begin, end = np.insert(begin, i + 1, cuts), np.insert(end, i, cuts)
    # k-grams that are the smallest of some window; two equal ones near each other may be one window's twice
    top = _sliding(np.maximum, np.concatenate([np.zeros(span - 1, np.uint64), np.where(inside, low, np.uint64(0)), np.zeros(span - 1, np.uint64)]), span)
    place = np.flatnonzero(top == hashes)
    place = place[np.argsort(hashes[place], kind="stable")]
    twice = (hashes[place[1:]] == hashes[place[:-1]]) & (place[1:] - place[:-1] < span)
    own = np.isin(low[begin], hashes[place[1:]][twice])
    return begin, end + least - 1, low[begin], own


def _parts(texts: list[bytes], least: int, block: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of (text, offset) and their bytes, ``block`` together; a longer text's parts overlap by ``least - 1`` bytes."""
    names, held, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - least + 1), block):
            piece = t[at : at + block + least - 1]
            if held and size + len(piece) > block:
                yield names, held
                names, held, size = [], [], 0
            names.append((i, at))
            held.append(piece)
            size += len(piece)
    if held:
        yield names, held


def _segment_rows(least: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(m, g, k, t, start, size, own): g digests the whole segment."""
        for pdf in it:
            texts = [x.encode("utf-8", "surrogatepass") for x in pdf["text"]]
            k, t = pdf["k"].to_numpy(), pdf["t"].to_numpy()
            for names, held in _parts(texts, least, BLOCK):
                data = b"".join(held)
                sizes = [len(x) for x in held]
                begin, end, low, own = segments(data, sizes, least)
                if not len(begin):
                    continue
                starts = np.cumsum(sizes) - sizes
                part = np.searchsorted(starts, begin, "right") - 1
                which, offset = np.array(names, np.int64)[part].T
                digest = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())], np.uint64)
                yield pd.DataFrame({"m": low.view(np.int64), "g": digest.view(np.int64), "k": k[which], "t": t[which], "start": (begin - starts[part] + offset).astype(np.int32), "size": (end - begin).astype(np.int32), "own": own})

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, g, many, data) of the segments that a text's row lists."""
    schema = pa.schema([("m", pa.int64()), ("g", pa.int64()), ("many", pa.bool_()), ("data", pa.binary())])
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            data = memoryview(text.as_buffer())
            rows = [{"m": s["m"], "g": s["g"], "many": s["many"], "data": bytes(data[s["start"] : s["start"] + s["size"]])} for s in wanted]
            yield pa.RecordBatch.from_pylist(rows, schema)


def _spans(starts: np.ndarray, least: int) -> list[list[int]]:
    """[begin, end) of what windows at ``starts`` cover."""
    cut = np.flatnonzero(np.diff(starts) > least) + 1
    return [[int(x[0]), int(x[-1]) + least] for x in np.split(starts, cut)] if len(starts) else []


def _transforms(least: int):
    def solve(held: list[tuple]) -> pd.DataFrame:
        spans = [_spans(x, least) for x in bwt.repeated_windows([d for *_, d in held], least)]
        return pd.DataFrame([(m, g, s) for (m, g, _), s in zip(held, spans) if s], columns=["m", "g", "spans"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Repeated stretches of segments, which come sorted by m."""
        held, size, last = [], 0, None
        for pdf in it:
            for m, g, data in zip(pdf["m"].tolist(), pdf["g"].tolist(), pdf["data"]):
                if m != last and size > TRANSFORM:
                    yield solve(held)
                    held, size = [], 0
                held.append((m, g, data))
                size += len(data)
                last = m
        if held:
            yield solve(held)

    return run


def pieces(data: bytes, k: int, least: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, core) of runs of a segment's windows; the core is in all windows that begin at most ``width`` places apart, counted from their first k-gram of hash ``k``.

    Equal windows have that k-gram at the same place, so pieces of two segments can share a window only if they have the same core.
    """
    n = len(data) - least + 1
    begin = 0
    for p in np.flatnonzero(gram_hashes(np.frombuffer(data, np.uint8), GRAM).view(np.int64) == k).tolist():
        while begin <= min(p, n - 1):  # windows that begin here to p have it first
            r = (p - begin) // width
            latest = p - r * width
            end = min(latest, n - 1) + 1
            yield begin, end + least - 1, r.to_bytes(4, "big") + data[latest : latest - width + 1 + least]
            begin = end


def _piece_rows(least: int, width: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(m, g, k, of_m, of_g, at, data): a piece with its core's digest as m, and where it lies in the segment (of_m, of_g)."""
        digests = lambda some: np.array([xxhash.xxh3_64_intdigest(x) for x in some], np.uint64).view(np.int64)
        for pdf in it:
            found = [(k, m, g, a, data[a:b], core) for m, g, k, data in zip(pdf["m"].tolist(), pdf["g"].tolist(), pdf["k"].tolist(), pdf["data"]) for a, b, core in pieces(data, k, least, width)]
            if found:
                k, of_m, of_g, at, data, core = zip(*found)
                yield pd.DataFrame({"m": digests(core), "g": digests(data), "k": k, "of_m": of_m, "of_g": of_g, "at": np.array(at, np.int32), "data": data})

    return run


def _marks(copies: DataFrame, least: int, many: int, width: int) -> DataFrame:
    """(m, g, spans): the repeated stretches of different segments (m, g, k, many, data), of which those with ``many`` are split."""
    few = copies.where("NOT many").select("m", "g", "data").repartition("m").sortWithinPartitions("m").mapInPandas(_transforms(least), "m long, g long, spans array<array<int>>")
    crowd = copies.where("many").drop("many")
    if crowd.isEmpty():
        return few
    made = stored(crowd.mapInPandas(_piece_rows(least, width), "m long, g long, k long, of_m long, of_g long, at int, data binary"), "windows-pieces")
    different = stored(made.groupBy("m", "g").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("data").alias("data")), "windows-different")
    marks = different.where("n > 1").select("m", "g", F.array(F.array(F.lit(0), F.length("data"))).alias("spans"))
    if width > 1:  # else a piece is a window, and different ones share none
        several = different.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m", (F.col("c") > many).alias("many"))
        inner = _marks(stored(different.join(several, "m").select("m", "g", "k", "many", "data"), "windows-copies"), least, many, max(1, width // FINER))
        marks = marks.union(inner.join(marks.select("m", "g"), ["m", "g"], "left_anti"))
    moved = F.transform("spans", lambda x: F.array(x[0] + F.col("at"), x[1] + F.col("at")))
    return few.union(made.join(stored(marks, "windows-marks"), ["m", "g"]).select(F.col("of_m").alias("m"), F.col("of_g").alias("g"), moved.alias("spans")))


def repeated_spans(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text", many: int | None = None) -> DataFrame:
    """(k, t, spans): what goes of the texts that lose something, named by ``row_key``; spans in order, apart from each other."""
    if not GRAM < least < RUN:
        raise ValueError(f"windows must have more than {GRAM} and fewer than {RUN} bytes")
    many = MANY if many is None else many
    k, t = row_key(key, text)
    texts = bound_batches(docs).select(k.alias("k"), t.alias("t"), F.col(text).alias("text")).where(F.octet_length("text") >= least)
    rows = stored(texts.mapInPandas(_segment_rows(least), "m long, g long, k long, t long, start int, size int, own boolean"), "windows-segments")
    # m that occur once have nothing to repeat, unless within themselves
    known = rows.groupBy("m").agg(F.count("*").alias("n"), (F.min("g") < F.max("g")).alias("several"), F.max("own").alias("self")).where("n > 1 OR self")
    live = stored(rows.join(known.select("m", F.expr("several OR self").alias("open")), "m"), "windows-live")
    different = stored(live.groupBy("m", "g").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "start", "size")).alias("one"), F.max("open").alias("open")), "windows-different")

    whole = different.where("n > 1")
    some = different.where("open").select("m", "g", "one")
    crowd = some.groupBy("m").agg((F.count("*") > many).alias("many"))
    wanted = some.join(crowd, "m").groupBy("one.k", "one.t").agg(F.collect_list(F.struct("m", "g", "many", "one.start", "one.size")).alias("wanted"))  # bounded by a text's bytes
    wanted = stored(wanted, "windows-wanted")
    asked = maybe_among(wanted.select(one_name("k", "t").alias("doc_id")), one_name("k", "t"), BLOOM_BITS)
    one_each = texts.where(asked).join(wanted, ["k", "t"]).select("k", "t", "text", "wanted")
    copies = stored(one_each.mapInArrow(_fetch, "m long, g long, many boolean, data binary").dropDuplicates(["m", "g"]), "windows-copies")  # repeated rows are fetched each

    within = _marks(copies.withColumn("k", F.col("m")), least, many, min(WIDTH, least // 2)).join(whole.select("m", "g"), ["m", "g"], "left_anti")
    marks = stored(within.union(whole.select("m", "g", F.array(F.array(F.lit(0), F.col("one.size"))))), "windows-marks")

    lost = live.join(marks, ["m", "g"]).select("k", "t", F.explode("spans").alias("s"), "start")
    lost = lost.select("k", "t", F.struct((F.col("start") + F.col("s")[0]).alias("start"), (F.col("start") + F.col("s")[1]).alias("end")).alias("s"))
    return lost.groupBy("k", "t").agg(F.sort_array(F.collect_set("s")).alias("spans"))  # bounded by a text's bytes


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted stretches with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["end"])
        else:
            out.append((s["start"], s["end"]))
    return out


def remove_repeats(docs: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text", kept: str = "kept", removed: str = "removed", many: int | None = None) -> DataFrame:
    """``docs`` with the bytes that stay in ``kept`` and the stretches that go, as byte offsets, in ``removed``."""
    docs = docs.drop(kept, removed)
    lost = stored(repeated_spans(docs, least, key, text, many), "windows-lost")
    k, t, spans = (fresh_name([*docs.columns, kept, removed], c) for c in ("k", "t", "spans"))
    named = docs.withColumns(dict(zip((k, t), row_key(key, text))))
    touched = maybe_among(lost.select(one_name("k", "t").alias("doc_id")), one_name(k, t), BLOOM_BITS)
    found = named.where(touched).join(lost.select(F.col("k").alias(k), F.col("t").alias(t), F.col("spans").alias(spans)), [k, t], "left")
    kind = "array<struct<start:int,end:int>>"
    stays = text_of(text).cast("binary")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left, gone = [], []
            for data, some in zip(batch.column(kept).to_pylist(), batch.column(removed).to_pylist()):
                at, pieces, stretches = 0, [], joined(some or [])
                for a, b in stretches:
                    pieces.append(data[at:a])
                    at = b
                left.append(b"".join([*pieces, data[at:]]))
                gone.append([{"start": a, "end": b} for a, b in stretches])
            yield with_arrays(batch, **{kept: pa.array(left, pa.binary()), removed: pa.array(gone, batch.schema.field(removed).type)})

    shape = [*(F.col(c) for c in docs.columns), stays.alias(kept)]
    marked = found.select(*shape, F.col(spans).cast(kind).alias(removed))
    return named.where(~touched).select(*shape, F.array().cast(kind).alias(removed)).unionByName(marked.mapInArrow(cut, marked.schema))


def removal_report(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    out = remove_repeats(docs.select("doc_id", "text"), least)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
