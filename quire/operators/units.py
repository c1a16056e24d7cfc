"""Paragraph units of pages, and the pieces that chunks are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ocr, text


def paragraph_units(pages: DataFrame) -> DataFrame:
    """(doc, unit_idx, text, page_number, section, source_type, ocr_applied, word_count) in document order."""
    applied = F.coalesce(F.col("metadata.ocr_applied"), F.lit(False))
    scanned = applied | (F.col("source_type") == "scanned_pdf_ocr")
    normal = F.when(scanned, ocr.reflow(F.col("content"))).otherwise(text.normalize_native(F.col("content")))
    rows = pages.select("doc", "page_number", "source_type", "section", applied.alias("ocr_applied"), F.posexplode(text.paragraphs(normal)).alias("para", "text"))
    order = Window.partitionBy("doc").orderBy("page_number", "para")
    return rows.select(
        "doc", (F.row_number().over(order) - 1).alias("unit_idx"), "text", "page_number",
        text.unit_section(F.col("text"), F.col("section")).alias("section"), "source_type", "ocr_applied", text.word_count(F.col("text")).alias("word_count"),
    )


def pieces(units: DataFrame, target_words: int, max_words: int | None) -> DataFrame:
    """Units with an array of their pieces: themselves, or their sentences if they are longer than max_words, or runs of
    target_words words if they have one sentence only. Without max_words no unit is split."""
    split = text.sentences(F.col("text"))
    parts = F.when(F.size(split) > 1, split).otherwise(text.word_windows(F.col("text"), target_words))
    long = F.lit(False) if max_words is None else F.col("word_count") > max_words
    return units.withColumns({"oversize": long, "parts": F.when(long, parts).otherwise(F.array("text")), "major": text.is_major_heading(F.col("text"))})
