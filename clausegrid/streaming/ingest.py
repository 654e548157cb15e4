"""Incremental review: new documents as a stream, each batch deduplicated by content and reviewed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.paragraphs import normalise_paragraphs, split_documents
from ..operators.rules import Rule, paragraph_risks


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def review_stream(docs: DataFrame, rules: list[Rule], out: str, checkpoint: str, watermark: str = "1 day", event_time: str | None = None, bounded: bool = True) -> StreamingQuery:
    """Writes the risks of each new content to ``out``/risks, a folder a batch, so that a batch that runs again replaces its own rows.

    Contents are remembered for ``watermark`` after their ``event_time``, so the state stays bounded. A stream that ends by
    itself (a back-fill) may go without event time, remembering all contents, if it says ``bounded=False``.
    """
    if event_time is None and bounded:
        raise ValueError("without an event time the state of the stream would grow for ever")
    hashed = docs.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    fresh = hashed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["sha256"]) if event_time else hashed.dropDuplicates(["sha256"])

    def write(batch: DataFrame, epoch: int) -> None:
        risks = paragraph_risks(normalise_paragraphs(split_documents(batch)), rules)
        risks.write.mode("overwrite").parquet(f"{out}/risks/epoch={epoch}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
