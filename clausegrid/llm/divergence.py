"""How the sources of a language differ: terms' smoothed shares, compared exactly (operator 13).

Counting, and comparing term by term, is vectorised SQL of an embedded engine (DuckDB) inside tasks; Spark deals the
work and merges what comes out. Three passes:

1. Each task counts its own documents' terms by (lang, source), in slices of bounded bytes. The counts are dealt by
   hash of (lang, term) to shards, in which a term's rows stand together (Spark sorts and spills); the shard sums them, slice by
   slice, and keeps terms of enough documents.
2. Spark sums the kept counts to N of each group and V of each language (one small row a group).
3. Shards again: every kept term's shares p of its groups, and from them the partial sums of pairs, a histogram of
   shares, and each group's leading terms. Spark adds the sums and ranks.

Most terms are absent from most sources, so no term is compared for all pairs of sources. For absent terms p is the
same p0 for all of a group's, so the sum over V terms of abs(p - q) is V * abs(p0 - q0), plus for each share p of the
group's present terms (by the histogram) abs(p - q0) - abs(p0 - q0), plus the same from the other side, plus for
terms that both have what makes up the difference. Everything is integer arithmetic of 64 bits, products of 128.

Defined results: null text, lang and source are the empty string. Repeated rows are documents each. A language without kept
terms has V = 0: its pairs have value 0, its groups no terms. Extra columns play no part; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bound_batches, stored, text_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text, and rows of counts, that a task hands to SQL at once.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 200_000


def _engine() -> duckdb.DuckDBPyConnection:
    """One thread, as Spark runs a task a core, and nothing on a local disk."""
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.Table]:
    """``batch`` in pieces of ``most`` bytes of ``column``; a longer text is a piece of its own."""
    start, held = 0, 0
    sizes = [0 if x is None else len(x.as_buffer() or b"") for x in batch.column(column)]
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield pa.Table.from_batches([batch.slice(start, i - start)])
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield pa.Table.from_batches([batch.slice(start)])


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.execute(sql).to_arrow_table().to_batches(50_000)


_SUM = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM {} GROUP BY ALL"


def _count() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of a task's documents; a term comes again if the task has very many."""
        con = _engine()
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        rows = lambda: con.execute("SELECT count(*) FROM counts").fetchall()[0][0]
        held = 0
        for batch in batches:
            for some in _slices(batch, "text", SLICE_BYTES):
                con.register("piece", some.append_column("doc", pa.array(range(some.num_rows), pa.int32())))
                con.execute(f"""
                    INSERT INTO counts SELECT lang, source, term, sum(n), count(*) FROM (
                      SELECT lang, source, doc, term, count(*) AS n FROM (
                        SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')) AS term FROM piece
                      ) GROUP BY ALL
                    ) GROUP BY lang, source, term""").fetchall()
                con.unregister("piece")
                if rows() > 2 * held + SLICE_ROWS:
                    con.execute("CREATE OR REPLACE TABLE counts AS " + _SUM.format("counts")).fetchall()
                    held = rows()
                    if held > 5 * SLICE_ROWS:
                        yield from _batches(con, "FROM counts")
                        con.execute("DELETE FROM counts").fetchall()
                        held = 0
        yield from _batches(con, _SUM.format("counts"))

    return run


def _by_term(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows that come sorted by (lang, term) in pieces of ``least`` rows or more that cut no term apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        last = lang[-1], term[-1]
        low, high = 0, batch.num_rows - 1  # where the last term begins
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if (lang[mid], term[mid]) == last else (mid + 1, high)
        before = (held[-1].column("lang")[-1], held[-1].column("term")[-1]) if held else None
        if (low or before != last) and sum(b.num_rows for b in held) + low >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, low)])
            held = []
            batch = batch.slice(low)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _keep(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, first) of terms in ``least`` documents of the language; ``first`` is 1 once a term."""
        con = _engine()
        for some in _by_term(batches, SLICE_ROWS // 4):
            con.register("piece", some)
            yield from _batches(con, f"""
                SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS first
                FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS all_docs FROM ({_SUM.format("piece")})) WHERE all_docs >= {least}""")
            con.unregister("piece")

    return run


def _compare(smooth: int, scale: int, top: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial results (kind, lang, source, item, p, value) of a shard.

        ``both``: what a pair's common terms add to the sum of absent shares. ``share``: how many terms (value) have share p.
        ``term``: a leading term and its value.
        """
        con = _engine()
        con.execute("CREATE TABLE parts (kind VARCHAR, lang VARCHAR, source VARCHAR, item VARCHAR, p BIGINT, value BIGINT)")
        rows = lambda: con.execute("SELECT count(*) FROM parts").fetchall()[0][0]
        held = 0
        merge = f"""
            SELECT kind, lang, source, item, p, sum(value)::BIGINT AS value FROM parts WHERE kind <> 'term' GROUP BY ALL
            UNION ALL
            SELECT * FROM parts WHERE kind = 'term' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"""
        for some in _by_term(batches, SLICE_ROWS // 4):
            con.register("piece", some)
            con.execute(f"""
                CREATE OR REPLACE TEMP TABLE shares AS
                SELECT lang, source, term, p0, (1 + {scale}::HUGEINT * (n + {smooth}) // (total + {smooth} * terms))::BIGINT AS p,
                       (1 + {scale}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {smooth}) // (lang_total + {smooth} * terms))::BIGINT AS q
                FROM piece""").fetchall()
            con.execute(f"""
                INSERT INTO parts
                SELECT 'both', a.lang, a.source, b.source, NULL, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
                UNION ALL
                SELECT 'share', lang, source, NULL, p, count(*) FROM shares GROUP BY ALL
                UNION ALL
                SELECT 'term', lang, source, term, NULL, p - q FROM shares WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}""").fetchall()
            con.unregister("piece")
            if rows() > 2 * held + SLICE_ROWS:
                con.execute("CREATE OR REPLACE TABLE parts AS " + merge).fetchall()
                held = rows()
        yield from _batches(con, merge)

    return run


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, scale: int = 10**9, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): a source's distance to every other one, and the terms it has more of than its language."""
    spark = bound_batches(docs).sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    shards = lambda df: df.repartition(n, "lang", "term").sortWithinPartitions("lang", "term")
    counted = rows.mapInArrow(_count(), "lang string, source string, term string, n long, docs long")
    kept = stored(shards(counted).mapInArrow(_keep(least_docs), "lang string, source string, term string, n long, first long"), "divergence-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    by_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("all_terms"))
    groups = groups.drop("terms").join(by_lang, "lang", "left").withColumnRenamed("all_terms", "terms").fillna(0, ["lang_total", "terms"])
    absent = F.when(F.col("terms") > 0, F.expr(f"1 + {scale * smooth}L div (total + {smooth} * terms)")).otherwise(0)
    groups = stored(groups.withColumn("p0", absent), "divergence-groups")

    parts = stored(shards(kept.drop("first").join(groups, ["lang", "source"])).mapInArrow(_compare(smooth, scale, top), "kind string, lang string, source string, item string, p long, value long"), "divergence-parts")
    one = groups.select("lang", "source", "terms", F.col("p0").alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").where("source <> item")  # the answer has a row for each of them
    base = pairs.select("lang", "source", "item", F.expr("terms * abs(p0 - q0)").alias("value"))
    share = parts.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").alias("n"))
    side = share.join(pairs, ["lang", "source"]).select("lang", "source", "item", F.expr("n * (abs(p - q0) - abs(p0 - q0))").alias("value"))
    both = parts.where("kind = 'both'").select("lang", "source", "item", "value")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    distance = base.union(side).union(turned(side)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(distance, "pair").unionByName(ranked(parts.where("kind = 'term'"), "term").where(F.col("rank") <= top))
