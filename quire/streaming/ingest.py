"""Ingestion of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.config import Settings
from quire.plans import ingest as batch
from quire.sources import files

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.{txt,md,docx}") -> DataFrame:
    """New files of a landing folder, as read_files() has them."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).load(folder)
    return files.with_names(found)


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings | None = None, pattern: str = "*.{txt,md,docx}") -> StreamingQuery:
    """Chunks of files that arrive in folder, written as Parquet under out, a folder for each batch, so that a batch
    that is run again replaces what it wrote. Runs until the files that are there now have been read."""
    settings = settings or Settings.from_session(spark)

    def one(df: DataFrame, number: int) -> None:
        pages = files.pages(df, page_chars=settings.page_chars, page_words=settings.page_words)
        made = batch.ingest_pages(pages, settings)
        made.chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder, pattern).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
