"""What is told about a document as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schemas import CHUNK_COLUMNS


def page_counts(pages: DataFrame) -> DataFrame:
    """(doc, total_pages, total_characters, ocr_pages, native_text_pages). Every page that OCR didn't read counts as
    native, empty ones too."""
    ocr = (F.col("metadata.extraction_method") == "OCR") | F.col("metadata.ocr_applied")
    per = pages.groupBy("doc").agg(F.count("*").cast("int").alias("total_pages"), F.sum(F.length("content")).alias("total_characters"), F.count_if(F.coalesce(ocr, F.lit(False))).cast("int").alias("ocr_pages"))
    return per.withColumn("native_text_pages", F.col("total_pages") - F.col("ocr_pages"))


def chunk_counts(chunks: DataFrame, nested: bool = False) -> DataFrame:
    """(doc, total_chunks, average_chunk_words, average_chunk_chars, chunking_strategy), with nested the chunks too."""
    aggs = [
        F.count("*").cast("int").alias("total_chunks"), F.round(F.avg("word_count"), 1).alias("average_chunk_words"), F.round(F.avg("char_count"), 1).alias("average_chunk_chars"),
        F.min_by("metadata.chunking_strategy", "chunk_index").alias("chunking_strategy"),
    ]
    if nested:
        listed = F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(*CHUNK_COLUMNS).alias("c"))))
        aggs.append(F.transform(listed, lambda x: x["c"]).alias("chunks"))
    return chunks.groupBy(F.col("document_name").alias("doc")).agg(*aggs)


def payloads(pages: DataFrame, chunks: DataFrame, analysis: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each document, as written to its JSON file. files: (doc, document_type, file_size_bytes)."""
    rows = page_counts(pages).join(analysis, "doc", "left").join(chunk_counts(chunks, nested=True), "doc", "left")
    rows = rows.join(files.select("doc", "document_type", "file_size_bytes"), "doc", "left") if files is not None else rows.withColumns({"document_type": F.lit(None).cast("string"), "file_size_bytes": F.lit(None).cast("long")})
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select(
        F.col("doc").alias("document_name"), "document_type", "file_size_bytes", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"), "total_pages", "native_text_pages", "ocr_pages",
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), "total_characters", zero("average_chunk_words"), zero("average_chunk_chars"), "primary_language", "detected_languages",
        F.map_from_entries("breakdown").alias("language_breakdown"), F.col("summary_display").alias("language_summary"), "is_multilingual", (F.col("ocr_pages") > 0).alias("ocr_used"),
        F.coalesce("chunking_strategy", F.lit("none")).alias("chunking_strategy"), F.coalesce("chunks", F.array().cast(rows.schema["chunks"].dataType)).alias("chunks"),
    )
