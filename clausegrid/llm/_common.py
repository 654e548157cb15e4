"""What the operators of this subpackage share: tables, the shared folder, small numpy helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark hands to Python at once; texts are long, so the default of 10 000 would take much memory.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand ``BATCH_ROWS`` rows at most to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (one machine, as in tests) may go without that setting;
    it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = os.path.join(tempfile.gettempdir(), f"clausegrid-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    return f"file://{found}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, which ``clean`` deletes."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` made in this application; results that weren't written are lost."""
    _delete(spark, _own_dir(spark))


#: Where ``stored`` lists the folders that it makes, while some ``owned`` block of this thread asks for it.
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The folders of the tables that ``stored`` makes within the block, in this thread; an outer block gets those that are left."""
    folders: list[str] = []
    outer = _OWNER.get()
    token = _OWNER.set(folders)
    try:
        yield folders
    finally:
        _OWNER.reset(token)
        if outer is not None:
            outer.extend(folders)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = own_folder(df.sparkSession, label)
    if (folders := _OWNER.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_unread(folders: list[str], df: DataFrame) -> None:
    """Delete those of ``folders`` that ``df`` doesn't read, and take them out of the list; nothing else may read them."""
    plain = lambda p: p.removeprefix("file:").lstrip("/")
    read = [plain(f) for f in df.inputFiles()] if folders else []
    for path in list(folders):
        if not any(f.startswith(plain(path) + "/") for f in read):
            _delete(df.sparkSession, path)
            folders.remove(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later step reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.replace("file:///", "/").startswith(root.replace("file:///", "/").replace("file:/", "/")):
            _delete(spark, path)


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores added until no column has it (case-insensitively)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


#: Stands for a null doc_id on the way through Python, where a column with nulls would become floats.
NO_ID = -(1 << 63)


def id_column(df: DataFrame, key: str):
    return F.coalesce(df[key].cast("long"), F.lit(NO_ID)).alias("doc_id")


def ids_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def with_arrays(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """``batch`` with columns replaced or added; all others stay as they are."""
    held = dict(zip(batch.schema.names, batch.columns)) | arrays
    return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def row_key(key: str = "doc_id", text: str = "text") -> tuple:
    """Two numbers that name a row's id and text: the id (nulls have one too) and the text's hash."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.xxhash64(text_of(text))


def one_name(k: str, t: str):
    """One number for both, for a Bloom filter of rows."""
    return F.shiftrightunsigned(F.xxhash64(k, t), 1)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bits of the Bloom filter that tells which documents a step needs.
BLOOM_BITS = 1 << 23


def _bloom_words(ids: np.ndarray, bits: int) -> np.ndarray:
    x = mix64(ids.astype(np.int64).view(np.uint64))
    return np.concatenate([(x >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 20, 40)]).astype(np.int64)


def maybe_among(needed: DataFrame, column, bits: int):
    """Whether ``column`` may be among the ids of ``needed`` (doc_id); never false for one that is."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(bits // 64, np.uint64)
        for pdf in it:
            at = _bloom_words(pdf["doc_id"].to_numpy(np.int64), bits)
            np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(table)
        yield pd.DataFrame({"word": word, "bits": table[word].view(np.int64)})

    found = needed.select("doc_id").mapInPandas(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)  # bits / 64 rows at most reach the driver
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = needed.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        have = (ids != NO_ID).to_numpy()
        at = _bloom_words(ids.to_numpy(np.int64), bits)
        hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series(hit.reshape(3, -1).all(0) & have)

    return maybe(F.coalesce(column, F.lit(NO_ID)))
