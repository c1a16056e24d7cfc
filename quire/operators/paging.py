"""Pages from plain text, from structural blocks, and from the text and pictures of PDF pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lang, text

GENERAL = "General"


def _metadata(total: Column, chars: Column, method: Column | None = None, needs: Column | None = None, applied: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        total.cast("int").alias("total_pages"), chars.cast("int").alias("char_count"), (none if method is None else method).alias("extraction_method"),
        (F.lit(False) if needs is None else needs).alias("needs_ocr"), (F.lit(False) if applied is None else applied).alias("ocr_applied"),
    )


def carried(section: Column, partition: str | list[str], order: str | list[str]) -> Column:
    """The last section up to a row, General before any."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(section, ignorenulls=True).over(w), F.lit(GENERAL))


def paginate_text(docs: DataFrame, doc_col: str = "doc", text_col: str = "text", page_chars: int = 2500, classify: lang.Classifier = lang.by_function_words) -> DataFrame:
    """Pages of plain texts: the whole text if it is short, else slices of page_chars characters.

    A short text's char_count is that of the raw text, a slice's that of the stripped slice. Sections carry on from
    slice to slice. Slices are made in place from one column, and the only shuffle is the one that carries sections.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(F.ceil(F.length(raw) / page_chars).cast("int"), F.lit(1))
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(raw, i * page_chars + 1, F.lit(page_chars)))
    rows = docs.select(F.col(doc_col).cast("string").alias("doc"), n.alias("total"), F.posexplode(slices).alias("at", "slice"))
    content = text.strip(F.col("slice"))
    # A short text is searched as it is, a slice after stripping.
    rows = rows.withColumns({"content": content, "page_number": F.col("at") + 1, "found": F.when(F.col("total") == 1, text.txt_section(F.col("slice"))).otherwise(text.txt_section(content))})
    section = carried(F.col("found"), "doc", "page_number")
    chars = F.when(F.col("total") == 1, F.length("slice")).otherwise(F.length("content"))
    return rows.select("doc", "page_number", "content", F.lit("txt").alias("source_type"), section.alias("section"), lang.language(F.col("content"), classify=classify).alias("language"), _metadata(F.col("total"), chars).alias("metadata"))


def sectioned_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, pos, type, text, heading_style) with their section: blank ones go, headings are told by style or
    form, and a heading opens a section with itself. Tables are never headings."""
    stripped = blocks.withColumn("text", text.strip(F.col("text"))).where(F.col("text") != "")
    heading = (F.col("type") != "table") & text.is_docx_heading(F.col("text"), F.coalesce(F.col("heading_style"), F.lit(False)))
    typed = stripped.withColumn("type", F.when(heading, "heading").when(F.col("type") == "heading", "paragraph").otherwise(F.col("type")))
    return typed.select("doc", "pos", "type", "text", carried(F.when(F.col("type") == "heading", F.col("text")), "doc", "pos").alias("section"))


def page_starts(words: Column, limit: int) -> Column:
    """For an array of word counts in order, the page number of each block: a block that would bring a page with blocks
    over the limit opens the next one."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("page"), F.array().cast("array<int>").alias("pages"))

    def step(acc: Column, w: Column) -> Column:
        new = (acc["n"] + w > limit) & (F.size(acc["pages"]) > 0)
        page = F.when(new, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(F.when(new, w).otherwise(acc["n"] + w).alias("n"), page.alias("page"), F.array_append(acc["pages"], page).alias("pages"))

    return F.aggregate(words, start, step, lambda acc: acc["pages"])


def paginate_blocks(blocks: DataFrame, page_words: int = 350, source_type: str = "docx", classify: lang.Classifier = lang.by_function_words, documents: DataFrame | None = None) -> DataFrame:
    """Pages of about page_words words from sectioned blocks (doc, pos, type, text, section).

    documents: a table (doc); those without blocks get one empty page. A page's section is that of its first block.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", "section")))
    held = blocks.groupBy("doc").agg(ordered.alias("b"))
    paged = held.withColumn("p", page_starts(F.transform("b", lambda x: text.word_count(x["text"])), page_words)).withColumn("total", F.array_max("p"))
    # Every block goes along once, with its page; documents are together already, so this groups without a shuffle.
    each = paged.select("doc", "total", F.explode(F.arrays_zip("b", "p")).alias("x")).select("doc", "total", F.col("x.p").alias("page_number"), F.col("x.b").alias("block"))
    pages = each.groupBy("doc", "page_number").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("block")).alias("b")).select(
        "doc", "total", "page_number", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("content"), F.col("b")[0]["section"].alias("section")
    )
    out = pages.select("doc", "page_number", "content", F.lit(source_type).alias("source_type"), "section", lang.language(F.col("content"), classify=classify).alias("language"), _metadata(F.col("total"), F.length("content")).alias("metadata"))
    if documents is None:
        return out
    empty = documents.select("doc").distinct().join(held, "doc", "left_anti")
    return out.unionByName(empty.select("doc", F.lit(1).alias("page_number"), F.lit("").alias("content"), F.lit(source_type).alias("source_type"), F.lit(GENERAL).alias("section"), F.lit("unknown").alias("language"), _metadata(F.lit(1), F.lit(0)).alias("metadata")))


def pages_from_scans(scans: DataFrame, read_image: Callable[[DataFrame], DataFrame] | None = None, classify: lang.Classifier = lang.by_function_words) -> DataFrame:
    """Pages from (doc, page_number, raw_text, has_images, image).

    A page whose own text can't be used, and which has pictures or no text at all, is read by OCR where there is an
    engine: read_image adds ocr_text to the rows it is given, and sees those rows only. Blank OCR results leave the
    page's own text. needs_ocr says whether the own text could not be used, whatever was done.
    """
    judged = scans.withColumn("quality", text.native_quality(F.col("raw_text")))
    wanted = ~F.col("quality.usable") & (F.coalesce(F.col("has_images"), F.lit(False)) | text.is_blank(F.col("raw_text")))
    if read_image is None:
        rows = judged.withColumn("ocr_text", F.lit(None).cast("string"))
    else:
        rows = judged.where(~wanted).withColumn("ocr_text", F.lit(None).cast("string")).unionByName(read_image(judged.where(wanted)))
    read = ~text.is_blank(F.col("ocr_text"))
    content = F.when(F.col("quality.usable"), F.col("quality.clean")).when(read, text.strip(F.col("ocr_text"))).otherwise(F.coalesce(F.col("quality.clean"), F.lit("")))
    rows = rows.withColumns({"content": content, "read": read}).withColumn("section", carried(text.pdf_section(F.col("content")), "doc", "page_number"))
    total = F.count("*").over(Window.partitionBy("doc"))
    return rows.select(
        "doc", "page_number", "content", F.when(F.col("read"), "scanned_pdf_ocr").otherwise("pdf").alias("source_type"), "section",
        lang.language(F.col("content"), classify=classify).alias("language"),
        _metadata(total, F.length("content"), F.when(F.col("read"), "OCR").otherwise("Native"), ~F.col("quality.usable"), F.col("read")).alias("metadata"),
    )
