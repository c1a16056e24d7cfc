"""Where results go: JSON payloads and index tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import retrieval
from quire.sources import files


def write_payloads(payloads: DataFrame, path: str) -> str:
    """Payloads as JSON lines, overwriting. Written by all tasks; nulls are kept as fields."""
    payloads.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def export_payload(payloads: DataFrame, path: str) -> str:
    """One document's payload as an indented file, through the driver: for a single document only."""
    rows = payloads.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("exactly one document is exported at a time")
    import pathlib

    target = pathlib.Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(json.loads(rows[0].j), ensure_ascii=False, indent=2), encoding="utf-8")
    return str(target)


def index_payloads(spark, payload_path: str, index_path: str, embedder: retrieval.Embedder) -> DataFrame:
    """Reads payloads, indexes their chunks in order of document and place, saves the index and reads it again."""
    chunks = files.chunks_of(files.read_payload_lines(spark, payload_path))
    # Places count on across documents: an offset for each document, then the chunk's own index.
    from pyspark.sql import Window

    counts = chunks.groupBy("document_name").agg(F.count("*").alias("n"))
    offsets = counts.select("document_name", F.coalesce(F.sum("n").over(Window.orderBy("document_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = chunks.join(offsets, "document_name").withColumn("pos", F.col("offset") + F.col("chunk_index")).drop("offset")
    retrieval.save_index(retrieval.build_index(numbered, embedder), index_path)
    return retrieval.load_index(spark, index_path)
