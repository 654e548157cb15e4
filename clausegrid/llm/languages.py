"""Language identification with language-bitmask n-gram filters (operator 1).

One Bloom filter a language, bit-sliced: slot j of the table is a mask whose bit L says whether the
filter of language L has bit j set, so one look-up of an n-gram's slots, and-ed, gives all languages
that contain it. A text's n-grams (1 to 4 letters, with word borders) are looked up together in numpy;
per language the hits are counted, corrected for the filter's false-positive rate, and the highest
corrected count decides. The score is that count's share of the text's n-grams.

A language's filter has the n-grams that are frequent in it and no rarer than ``share`` of their highest
relative frequency in any language. It is learned from about ``SAMPLE`` labelled texts a language,
chosen by a hash of doc_id; the n-grams are counted in Spark, all that qualify enter the filter, and the masks of
slots are combined there too. The table has ``SLOTS_A_GRAM`` slots for each n-gram of the richest language, as far as
``MOST_BYTES`` allow (beyond that more hits are false, which the correction knows); it is broadcast.

Defined results: a text that is null or has no letter is ``und`` with score 0. Texts without a hit get
the label most frequent in the sample. Ties go to the label more frequent there, then to the smaller
one. Without any labelled text every prediction is ``und``. Repeated rows are predicted each; null
labels aren't learned; more than ``MOST_LANGUAGES`` labels are an error; extra columns are kept by ``predict``. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLOOM_BITS, bound_batches, code_points, fresh_name, maybe_among, mix64, one_name, row_key, stored, with_arrays

#: Labelled texts to learn from, a language (expected number); hashes; letters in an n-gram.
SAMPLE, HASHES, ORDERS = 4000, 3, 4
#: Bits of a slot's number, at least and at most (three of them come from one hash); slots an n-gram; bytes of all filters.
SLOT_BITS, MOST_BITS, SLOTS_A_GRAM, MOST_BYTES = 18, 21, 8, 64 << 20
#: Labels at most; a column with more isn't one of languages.
MOST_LANGUAGES = 2000
_LETTER: np.ndarray | None = None
#: Characters looked up together: the arrays of a batch fit a core's cache.
_BATCH = 1 << 17


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_hashes(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the scrambled hash at every position and whether an n-gram begins there; where each text begins.

    Whatever isn't a letter is one space; n-grams have a space at their ends only, so none spans two texts.
    """
    raw = [code_points(" " + t.lower()) for t in texts]
    cp = np.concatenate([*raw, np.array([32], np.uint32)])
    begins = np.cumsum([0, *(len(x) for x in raw)])
    letter = _letters()[cp]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of a run that isn't letters
    keep[begins[:-1]] = True
    kept = np.cumsum(keep)
    at = (kept[begins[:-1]] - 1).astype(np.int64)
    cp = np.where(letter, cp, 32)[keep].astype(np.uint64)
    letter = letter[keep]
    out, code, n = [], cp.copy(), len(cp)
    inner = np.ones(n, bool)  # of letters, but for the ends
    for order in range(1, ORDERS + 1):
        size = n - order + 1
        if size <= 0:
            break
        if order > 1:
            code = code[:size] * np.uint64(0x9E3779B97F4A7C15) + cp[order - 1 :]
            inner = inner[:size] & letter[order - 2 : order - 2 + size] if order > 2 else inner[:size]
            valid = inner if order > 2 else letter[:size] | letter[1:]
        else:
            valid = letter
        out.append((mix64(code + np.uint64(order)), valid))
    return out, at


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(bits * j)).astype(np.int64) & ((1 << bits) - 1) for j in range(HASHES)]


def _kind(labels: int) -> type:
    """The narrowest mask of so many languages, 64 at most."""
    return next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if labels <= np.iinfo(k).bits)


def slot_bits(grams: int, labels: int) -> int:
    """The size of filters for languages of up to ``grams`` n-grams: ``SLOTS_A_GRAM`` slots each, as far as ``MOST_BYTES`` allow."""
    width = sum(np.dtype(_kind(min(64, labels - at))).itemsize for at in range(0, labels, 64))
    bits = SLOT_BITS
    while bits < MOST_BITS and (1 << bits) < SLOTS_A_GRAM * grams and width << bits + 1 <= MOST_BYTES:
        bits += 1
    return bits


@dataclass
class Filters:
    """``planes``: one table of masks for every 64 languages; ``rate``: each language's false-positive rate."""

    labels: list[str]
    planes: list[np.ndarray]
    rate: np.ndarray
    bits: int = SLOT_BITS

    @classmethod
    def of_planes(cls, labels: list[str], planes: list[np.ndarray], bits: int) -> Filters:
        rate = [float(((planes[i // 64] >> planes[i // 64].dtype.type(i % 64)) & planes[i // 64].dtype.type(1)).mean()) ** HASHES for i in range(len(labels))]
        return cls(labels, planes, np.array(rate), bits)

    @classmethod
    def build(cls, labels: list[str], grams: dict[str, np.ndarray], bits: int = SLOT_BITS) -> Filters:
        """``labels`` by falling frequency; ``grams``: hashes of each label's n-grams."""
        planes = [np.zeros(1 << bits, _kind(min(64, len(labels) - at))) for at in range(0, len(labels), 64)]
        for i, label in enumerate(labels):
            for slot in _slots(grams.get(label, np.zeros(0, np.uint64)), bits):
                planes[i // 64][slot] |= planes[i // 64].dtype.type(1 << i % 64)
        return cls.of_planes(labels, planes, bits)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (text x language) and the number of n-grams of each text."""
        hits, total = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        start, sizes = 0, [len(t) for t in texts]
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + sizes[end] <= _BATCH):
                held += sizes[end]
                end += 1
            orders, at = gram_hashes(texts[start:end])
            for h, valid in orders:
                edges = np.minimum(at, len(valid) - 1)
                total[start:end] += np.add.reduceat(valid, edges, dtype=np.int64)
                slots = _slots(h, self.bits)
                for p, plane in enumerate(self.planes):
                    mask = plane[slots[0]]
                    for s in slots[1:]:
                        mask &= plane[s]
                    mask[~valid] = 0
                    for bit in range(min(64, len(self.labels) - 64 * p)):
                        hits[start:end, 64 * p + bit] += np.add.reduceat((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), edges, dtype=np.int64)
            start = end
        return (hits - total[:, None] * self.rate) / (1 - self.rate), total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        labels, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return labels, score
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if some:
            counts, total = self.counts([texts[i] for i in some])
            best = counts.argmax(1)  # the first of equals: labels stand by falling frequency
            for j, i in enumerate(some):
                labels[i] = self.labels[best[j]]
                score[i] = min(1.0, max(0.0, counts[j, best[j]] / max(1.0, total[j])))
        return labels, score


def learn(labelled: DataFrame, per_language: int = SAMPLE, share: float = 0.5, least: int = 3, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the rows of ``labelled`` whose text and label aren't null."""
    rows = bound_batches(labelled).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}  # one row a language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"labels of more than {MOST_LANGUAGES} languages: not a column of languages")
    if not sizes:
        return Filters([], [], np.zeros(0))
    labels = sorted(sizes, key=lambda x: (-sizes[x], x))
    fraction = F.create_map(*(F.lit(v) for x in labels for v in (x, min(1.0, per_language / sizes[x]))))
    unit = (F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
    sample = rows.where(unit < F.try_element_at(fraction, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for label, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for start in range(0, len(texts), 200):
                    orders, _ = gram_hashes(texts[start : start + 200])
                    found = [np.unique(h[valid], return_counts=True) for h, valid in orders]
                    h = np.concatenate([x[0] for x in found])
                    yield pd.DataFrame({"lang": label, "g": h.view(np.int64), "n": np.concatenate([x[1] for x in found])})

    counted = sample.mapInPandas(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    of_lang, of_gram = W.partitionBy("lang"), W.partitionBy("g")
    rated = counted.withColumn("f", F.col("n") / F.sum("n").over(of_lang)).where(F.col("n") >= least).withColumn("top", F.max("f").over(of_gram))
    best = stored(rated.where(F.col("f") >= share * F.col("top")).select("lang", "g"), "language-grams")
    bits = slot_bits(max((r[1] for r in best.groupBy("lang").count().collect()), default=0), len(labels))  # one row a language
    number = {x: i for i, x in enumerate(labels)}

    def set_bits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            i = pdf["lang"].map(number).to_numpy(np.int64)
            h = pdf["g"].to_numpy(np.int64).view(np.uint64)
            mask = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            part = pd.concat([pd.DataFrame({"plane": i // 64, "slot": s, "mask": mask}) for s in _slots(h, bits)])
            yield part

    filled = best.mapInPandas(set_bits, "plane long, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()  # MOST_BYTES of masks at most
    planes = []
    for at in range(0, len(labels), 64):
        own = filled[filled["plane"] == at // 64]
        plane = np.zeros(1 << bits, np.uint64)
        plane[own["slot"].to_numpy(np.int64)] = own["mask"].to_numpy(np.int64).view(np.uint64)
        planes.append(plane.astype(_kind(min(64, len(labels) - at))))
    return Filters.of_planes(labels, planes, bits)


def predict(docs: DataFrame, filters: Filters, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted label and its score; columns of these names are replaced."""
    kept = bound_batches(docs).drop(label, score)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by MOST_BYTES

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                labels, scores = shared.value.predict([x or "" for x in some.column(text).to_pylist()])
                yield with_arrays(some, **{label: pa.array(labels, pa.string()), score: pa.array(scores, pa.float64())})

    return kept.mapInArrow(task, T.StructType([*kept.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))


def _score_limits(scored: DataFrame, share: float, least: float) -> list[tuple[str, float, float, float, float]]:
    """For each language (label, mean, a, b, q): a text of n characters is too odd below mean + q * sqrt(a + b / n).

    Scores of long texts vary by what they are about (a), those of short ones by chance too (b / n). Both are fitted to the variances
    of the correctly predicted texts of each octave of lengths; q is the quantile ``share`` of their deviations.
    """
    own = scored.where((F.col("label") == F.col("lang")) & (F.col("n") > 0))
    octaves = own.groupBy("label", F.floor(F.log2("n")).alias("octave")).agg(F.count("*").alias("rows"), F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.avg(1 / F.col("n")).alias("less"))
    by_label: dict[str, list] = {}
    for r in octaves.collect():  # 31 rows a language at most
        by_label.setdefault(r.label, []).append(r)
    fitted = []
    for label, rows in sorted(by_label.items()):
        w = np.array([r.rows for r in rows], float)
        mean = float(w @ [r.mean for r in rows] / w.sum())
        less, var = np.array([r.less for r in rows]), np.array([r["var"] + (r.mean - mean) ** 2 for r in rows])
        x = np.stack([np.ones(len(rows)), less], 1) * np.sqrt(w)[:, None]
        a, b = np.linalg.lstsq(x, var * np.sqrt(w), rcond=None)[0]
        if a <= 0 or b <= 0:  # one of the two explains it
            a, b = max(0.0, a) and float(w @ var / w.sum()), max(0.0, b) and float((w * less) @ var / ((w * less) @ less))
        fitted.append((label, mean, max(float(a), 1e-9), max(float(b), 0.0)))
    if not fitted:
        return []
    table = F.broadcast(scored.sparkSession.createDataFrame(fitted, "label string, mean double, a double, b double"))  # a row a language
    far = ((F.col("score") - F.col("mean")) / F.sqrt(F.col("a") + F.col("b") / F.col("n"))).alias("far")
    quantiles = own.join(table, "label").groupBy("label").agg(F.percentile_approx(far, share, 100_000).alias("q"))
    q = {r.label: r.q for r in quantiles.select("label", "q").collect()}
    return [(*f, q[f[0]]) for f in fitted]


def keep_known(docs: DataFrame, filters: Filters, share: float = 0.001, least: float = 0.2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: with letters, ``least`` or more of its n-grams that language's, and not odder than all but ``share`` of its own texts.

    Every text is scored once; only the scores are stored. Texts that may have to go pass a shuffle, all others are told apart by a filter of fixed size.
    Rows that repeat (doc_id, text) share their fate; null texts go. No rows give no rows.
    """
    k, t = row_key(key, text)
    scored = predict(docs.select(k.alias("k"), t.alias("t"), F.length(text).alias("n"), F.col(lang).alias("lang"), F.col(text).alias("text")), filters, label="label").drop("text")
    scored = stored(scored, "language-scores")
    limits = scored.sparkSession.createDataFrame(_score_limits(scored, share, least), "label string, mean double, a double, b double, q double")
    lowest = F.greatest(F.lit(least), F.col("mean") + F.col("q") * F.sqrt(F.col("a") + F.col("b") / F.greatest("n", F.lit(1))))
    known = (F.col("label") != "und") & (F.col("score") >= F.coalesce(lowest, F.lit(least)))
    gone = stored(scored.join(F.broadcast(limits), "label", "left").where(~known).select("k", "t").distinct(), "language-gone")
    at_k, at_t = fresh_name(docs.columns, "k"), fresh_name(docs.columns, "t")
    named = docs.withColumns({at_k: k, at_t: t})
    maybe = maybe_among(gone.select(one_name("k", "t").alias("doc_id")), one_name(at_k, at_t), BLOOM_BITS)
    cleared = named.where(maybe).join(gone.select(F.col("k").alias(at_k), F.col("t").alias(at_t)), [at_k, at_t], "left_anti")
    return named.where(~maybe).unionByName(cleared).select(docs.columns)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1
