"""Token counts from flat token files without an index, by a separator scan (operator 9).

A file is a run of little-endian ids; each document ends with the end-of-document id. The sizes of the
files give byte ranges, which tasks read and search on their own (numpy compare), each giving its length
and the places of its separators. A prefix scan over the ranges of a file then carries the position, the
number of documents and the last separator across their borders: it sees one short row a range, which is
joined back to the separators, and the counts follow. A document may span any number of ranges, a file
may have any size. Only the places of separators pass a shuffle, never tokens.

``write_token_files`` makes such files, one a task. A task writes under a name of its own and renames the
whole file at the end, so a task that runs again replaces it by the same bytes.

Defined results: two separators in a row are a document of 0 tokens; tokens after the last separator
are a document with ``terminated`` false; an empty file has no documents; a null text is empty. The string of a
special token is ordinary text, so no document holds a separator. A file whose size isn't a multiple of
the id's width is an error. Repeated rows count each; so do rows of a null doc_id. An empty table has no files
and no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bound_batches, id_column, ids_back, stored, text_of
from .tokens import json_tokens

#: Ids in a range; ranges that one task reads.
RANGE_IDS, TASK_RANGES = 1 << 21, 16
FOUND = "stream string, block long, n long, ends array<long>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 50256, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flat token files below ``path``, a folder that all executors share. Gives what the files don't have: which
    document stands where, (stream, ordinal, doc_id), stored beside them. An id that ``width`` bytes can't hold is an error.
    """

    if not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"id {end_id} doesn't fit in {width} bytes")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, number = json_tokens(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        system, folder = _opened(path)
        system.create_dir(folder)
        name, own = f"part-{number:06d}", f"{folder}/_part-{number:06d}-{uuid.uuid4().hex}"
        begun, ordinal = None, 0
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                begun = begun or system.open_output_stream(own)
                for data in codec.encode(some["text"].tolist()):
                    ids = np.frombuffer(data, "<u4")
                    if len(ids) and ids.max() >= 1 << 8 * width:
                        raise ValueError(f"id {ids.max()} doesn't fit in {width} bytes")
                    begun.write(ids.astype(f"<u{width}").tobytes() + end)
                yield pd.DataFrame({"stream": name, "ordinal": np.arange(ordinal, ordinal + len(some)), "doc_id": some["doc_id"]})
                ordinal += len(some)
        if begun:
            begun.close()
            system.move(own, f"{folder}/{name}")

    narrow = bound_batches(docs).select(id_column(docs, key), text_of(text).alias("text"))
    return stored(ids_back(narrow.mapInPandas(task, "stream string, ordinal long, doc_id long")), "token-manifest")


def scan_files(spark: SparkSession, path: str, end_id: int = 50256, width: int = 2, range_ids: int = RANGE_IDS, pattern: str = "part-*") -> DataFrame:
    """The ranges of the files below ``path`` with the places of their separators; ``stream`` is a file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    step = range_ids * width
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    total = files.agg(F.sum(F.expr(f"length div {step} + 1"))).first()[0] or 1
    dealt = ranges.repartition(max(1, min(total, max(spark.sparkContext.defaultParallelism, -(-total // TASK_RANGES)))), "path", "block")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length, block in zip(pdf["path"], pdf["length"], pdf["block"]):
                if length % width:
                    raise ValueError(f"{name}: its size is no multiple of {width}")
                system, place = _opened(name)
                with system.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at(min(step, length - block * step), block * step), f"<u{width}")
                yield pd.DataFrame({"stream": [place.rsplit("/", 1)[-1]], "block": [block], "n": [len(ids)], "ends": [np.flatnonzero(ids == end_id).astype(np.int64)]})

    return dealt.mapInPandas(task, FOUND)


def scan_blocks(blocks: DataFrame, end_id: int = 50256, width: int = 2) -> DataFrame:
    """The same for blocks that are rows (stream, block, tokens), as a message queue hands them over."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.frombuffer(x, f"<u{width}") for x in pdf["tokens"]]
            yield pd.DataFrame({"stream": pdf["stream"], "block": pdf["block"], "n": [len(x) for x in ids], "ends": [np.flatnonzero(x == end_id).astype(np.int64) for x in ids]})

    return blocks.select("stream", "block", "tokens").mapInPandas(task, FOUND)


def count_tokens(scanned: DataFrame) -> DataFrame:
    """One row a document: (stream, ordinal, first_token, n_tokens, terminated)."""
    found = stored(scanned, "token-separators")
    before = W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ordered = W.partitionBy("stream").orderBy("block")
    short = found.select("stream", "block", "n", F.size("ends").alias("m"), F.array_max("ends").alias("last"))
    carried = (
        short.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("m").over(before), F.lit(0)))
        .withColumn("last_end", F.when(F.col("m") > 0, F.col("base") + F.col("last")))
        .withColumn("open_from", F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1)
        .withColumn("is_last", F.lead("block").over(ordered).isNull())
        .select("stream", "block", "base", "ordinal", "last_end", "open_from", "is_last")
    )
    placed = found.join(carried, ["stream", "block"])
    found_rows = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.col("ordinal") + i).alias("ordinal"),
            F.when(i == 0, F.col("open_from")).otherwise(F.col("base") + F.get("ends", i - 1) + 1).alias("first_token"),
            (F.col("base") + e).alias("end"),
            F.lit(True).alias("terminated"),
        ),
    )
    after = F.coalesce(F.col("last_end") + 1, F.col("open_from"))
    total = F.col("base") + F.col("n")
    tail = F.struct((F.col("ordinal") + F.size("ends")).alias("ordinal"), after.alias("first_token"), total.alias("end"), F.lit(False).alias("terminated"))
    none = F.array().cast("array<struct<ordinal:bigint,first_token:bigint,end:bigint,terminated:boolean>>")
    all_rows = F.concat(found_rows, F.when(F.col("is_last") & (total > after), F.array(tail)).otherwise(none))
    rows = placed.select("stream", F.explode(all_rows).alias("d"))
    return rows.select("stream", "d.ordinal", "d.first_token", (F.col("d.end") - F.col("d.first_token")).alias("n_tokens"), "d.terminated")


def document_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 50256, width: int = 2, range_ids: int = RANGE_IDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of ``docs`` below ``path``, count them by the scan and name the documents."""
    manifest = write_token_files(docs, path, tokenizer_path, end_id, width, key, text)
    if manifest.isEmpty():
        nothing = docs.sparkSession.createDataFrame([], FOUND)
        return count_tokens(nothing).join(manifest, ["stream", "ordinal"])
    counted = count_tokens(scan_files(docs.sparkSession, path, end_id, width, range_ids))
    return counted.join(manifest, ["stream", "ordinal"], "left")
