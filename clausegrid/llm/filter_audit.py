"""How filters interact: what each removes, alone, after the others, and in every order (operator 11).

Every row fails some of five filters, which makes a mask of five bits. Four bits come from the row's own text.
The fifth says that a smaller doc_id has the same text anywhere in the table: texts are routed by their xxhash,
and where they meet, a chain for each fingerprint holds each different text once, in full, with the smallest id;
every other id leaves at once. The same chains run before the shuffle, so that of a text that a third of all rows
share only one copy a task travels, and rows that lost there travel without their text. Rows arrive sorted by
fingerprint (Spark spills that sort), so a task holds one chain at a time.

Masks of a part are counted in a vector, one count a mask for all rows, good ones and toxic ones; vectors are merged by
``combineByKey``, before the shuffle too. All 120 orders follow from the 32 counts.

Defined results: a null text or source is the empty string. A null doc_id has no smaller one and is smaller than
none. Rows that repeat (doc_id, text) count each and aren't duplicates of one another. Of several labels of a doc_id
one that says 1 is enough; null labels say nothing. Extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_of

FILTERS = "ABCDE"
_SAME = 1 << FILTERS.index("E")
_MARKS = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def text_mask(text: str) -> int:
    """Bits A to D: too few words, too few different ones, too many capitals, marks."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at \x20 and \x09 to \x0d
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | (_MARKS.search(text) is not None) << 3


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Chain:
    """The different texts of one fingerprint with the smallest id that each has, and that id's rows by part."""

    def __init__(self) -> None:
        self.entries: list[list] = []

    def add(self, text: str, ident: int, mask: int, parts: Counter) -> tuple[int, int, Counter] | None:
        """(id, mask, rows by part) of what isn't the smallest any more; None if nothing has lost."""
        for entry in self.entries:
            if entry[0] == text:
                if ident == entry[1]:
                    entry[3] = entry[3] + parts
                    return None
                if ident > entry[1]:
                    return ident, mask | _SAME, parts
                lost = entry[1], entry[2] | _SAME, entry[3]
                entry[1:] = ident, mask, parts
                return lost
        self.entries.append([text, ident, mask, parts])
        return None


#: Characters of text that a task's own chains hold before they are sent on.
HELD_CHARS = 1 << 25
#: Bytes of text that are routed to a partition, on average; their number follows from the table's bytes.
ROUTED_BYTES = 16 << 20


def _own_chains():
    def run(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        """(fingerprint, row) of each text's smallest id in what was read together; rows that lost, and those without an id, have no text."""
        chains: dict[int, Chain] = {}
        held = 0
        for ident, part, text in rows:
            mask, parts = text_mask(text), Counter({part: 1})
            if ident is None:
                yield fingerprint(part), (None, None, mask, parts)
                continue
            key = fingerprint(text)
            if key not in chains:
                chains[key] = Chain()
            n = len(chains[key].entries)
            if lost := chains[key].add(text, ident, mask, parts):
                yield fingerprint(str(lost[0])), (None, *lost)
            held += len(text) * (len(chains[key].entries) - n)
            if held > HELD_CHARS:
                for k, chain in chains.items():
                    yield from ((k, tuple(e)) for e in chain.entries)
                chains, held = {}, 0
        for k, chain in chains.items():
            yield from ((k, tuple(e)) for e in chain.entries)

    return run


def _met_chains(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, int, str, int]]:
    """(id, mask, part, rows) of everything that was routed here, in order of fingerprints."""
    at, chain = None, Chain()
    for key, (text, ident, mask, parts) in rows:
        if text is None:
            yield from ((ident, mask, part, n) for part, n in parts.items())
            continue
        if key != at:
            yield from ((i, m, part, n) for _, i, m, p in chain.entries for part, n in p.items())
            at, chain = key, Chain()
        if lost := chain.add(text, ident, mask, parts):
            yield from ((lost[0], lost[1], part, n) for part, n in lost[2].items())
    yield from ((i, m, part, n) for _, i, m, p in chain.entries for part, n in p.items())


def masks(docs: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mask, part, n): of which bit f is set if the row fails the f-th filter; n rows that agree in all that."""
    spark = docs.sparkSession
    n = 1 + (docs.agg(F.sum(F.octet_length(text_of(text)).cast("long"))).first()[0] or 0) // ROUTED_BYTES
    rows: RDD = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(part).alias("part"), text_of(text).alias("text")).rdd
    routed = rows.mapPartitions(_own_chains()).repartitionAndSortWithinPartitions(n, partitionFunc=lambda fp: fp)
    return spark.createDataFrame(routed.mapPartitions(_met_chains), "doc_id long, mask int, part string, n long", verifySchema=False)


def identical_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The doc_ids of rows whose text a smaller doc_id has too."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit("").alias("part"))
    return masks(plain, "part").where(F.col("mask").bitwiseAND(F.lit(_SAME)) != 0).select("doc_id").distinct()


def order_weights() -> tuple[list[tuple[str, int]], np.ndarray]:
    """All (order, step), and for each of them what a row of each mask adds to kept, removed, redundant, unique_fails and shapley."""
    every = np.arange(1 << len(FILTERS))
    size = np.array([bin(m).count("1") for m in every])
    orders = list(permutations(range(len(FILTERS))))
    steps, weights = [], []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = every >> f & 1, (every & before) != 0
            before |= 1 << f
            steps.append(("".join(FILTERS[x] for x in order), step))
            # a filter removes a row in those orders in which it comes first of all that the row fails
            weights.append([(every & before) == 0, fails * ~gone, fails * gone, every == 1 << f, fails * len(orders) // np.maximum(size, 1)])
    return steps, np.array(weights, np.int64)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step, with the counts of its rows."""
    spark = docs.sparkSession
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    marked = masks(docs, part, key, text).join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(counts: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += np.array([n, n * good, n * toxic])
        return counts

    start = lambda row: add(np.zeros((3, 1 << len(FILTERS)), np.int64), row)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(start, add, lambda a, b: a + b, n, partitionFunc=fingerprint)
    steps, weights = order_weights()

    def report(it: Iterator[tuple[str, np.ndarray]]) -> Iterator[tuple]:
        for name, (rows, good, toxic) in it:
            kept, removed, redundant, alone, shapley = np.moveaxis(weights, 1, 0) @ rows
            table = np.stack([kept, removed, redundant, alone, weights[:, 1] @ good, weights[:, 1] @ toxic, shapley], 1)
            for (order, step), counts in zip(steps, table.tolist()):
                yield name, order, step, *counts

    return spark.createDataFrame(vectors.mapPartitions(report), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False)
