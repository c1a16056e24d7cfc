"""Documents from files: plain text, Markdown, DOCX and, with a parser, PDF."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import lang, text
from quire.operators import paging
from quire.schemas import PAYLOAD

TEXT, DOCX, PDF = (".txt", ".md"), (".docx",), (".pdf",)


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, doc, suffix, document_type, file_size_bytes, modified, content). FileNotFoundError for a missing path."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(path)) from e
        raise
    return with_names(found)


def with_names(found: DataFrame) -> DataFrame:
    """Rows of the binaryFile format with names and suffixes."""
    doc = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(doc, r"(\.[^.]+)$", 1))
    return found.select("path", F.url_decode(doc).alias("doc"), suffix.alias("suffix"), F.substring(suffix, 2, 20).alias("document_type"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified"), "content")


def unsupported(files: DataFrame) -> DataFrame:
    return files.where(~F.col("suffix").isin(*TEXT, *DOCX, *PDF)).select("doc", "suffix")


def decoded(content: Column) -> Column:
    """Text of a file: UTF-8, or Latin-1 where it isn't that, with line ends of one kind. A mark at the start stays."""
    t = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return text.line_ends(t)


def text_pages(files: DataFrame, page_chars: int = 2500, classify: lang.Classifier = lang.by_function_words) -> DataFrame:
    rows = files.where(F.col("suffix").isin(*TEXT)).select("doc", decoded(F.col("content")).alias("text"))
    return paging.paginate_text(rows, "doc", "text", page_chars, classify)


# DOCX

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_blocks_of(content: bytes) -> list[tuple[int, str, str, bool]]:
    """(pos, type, text, heading_style) of a DOCX file's paragraphs and tables, in document order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "") or ""
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "") if style is not None else ""
            out.append((len(out), "paragraph", _paragraph(e), name.lower().startswith("heading")))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join("\n".join(_paragraph(p) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")) for r in e.findall(f"{_W}tr")]
            if rows:
                out.append((len(out), "table", "\n".join(rows), False))
    return out


def docx_blocks(files: DataFrame) -> DataFrame:
    """(doc, pos, type, text, heading_style) of DOCX files. A file that can't be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                try:
                    rows += [(doc, *b) for b in docx_blocks_of(bytes(content))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["doc", "pos", "type", "text", "heading_style"])

    own = files.where(F.col("suffix").isin(*DOCX)).select("doc", "content")
    return own.mapInPandas(run, "doc string, pos int, type string, text string, heading_style boolean")


def docx_pages(files: DataFrame, page_words: int = 350, classify: lang.Classifier = lang.by_function_words) -> DataFrame:
    own = files.where(F.col("suffix").isin(*DOCX))
    return paging.paginate_blocks(paging.sectioned_blocks(docx_blocks(files)), page_words, "docx", classify, own.select("doc"))


# PDF

PageParser = Callable[[bytes], list[tuple[int, str, bool, bytes | None]]]


def pdf_scans(files: DataFrame, parse: PageParser) -> DataFrame:
    """(doc, page_number, raw_text, has_images, image) of PDF files. parse gives these for a file's bytes; there is no
    parser here, as no PDF library is at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, *page) for doc, content in zip(batch["doc"], batch["content"], strict=True) for page in parse(bytes(content))]
            yield pd.DataFrame(rows, columns=["doc", "page_number", "raw_text", "has_images", "image"])

    own = files.where(F.col("suffix").isin(*PDF)).select("doc", "content")
    return own.mapInPandas(run, "doc string, page_number int, raw_text string, has_images boolean, image binary")


OcrEngine = Callable[[bytes], str]


def image_reader(engine: OcrEngine) -> Callable[[DataFrame], DataFrame]:
    """Adds ocr_text, read from image by the engine, to the rows that need it."""
    from quire.functions import ocr

    def read(rows: DataFrame) -> DataFrame:
        def run(images: pd.Series) -> pd.Series:
            return images.map(lambda x: engine(bytes(x)) if x is not None else "")

        run.__annotations__ = {"images": pd.Series, "return": pd.Series}
        udf = F.pandas_udf(run, "string")
        return rows.withColumn("ocr_text", ocr.sanitize(udf(F.col("image"))))

    return read


def pages(files: DataFrame, classify: lang.Classifier = lang.by_function_words, parse: PageParser | None = None, engine: OcrEngine | None = None, page_chars: int = 2500, page_words: int = 350) -> DataFrame:
    """Pages of files of all supported kinds. PDF files need a parser; without one they are an error."""
    out = text_pages(files, page_chars, classify).unionByName(docx_pages(files, page_words, classify))
    if parse is None:
        pdf = files.where(F.col("suffix").isin(*PDF)).select(F.raise_error(F.concat(F.lit("no PDF parser is given for "), "doc")).cast("string").alias("doc"))
        return out.unionByName(pdf.select("doc", *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema if f.name != "doc"]))
    return out.unionByName(paging.pages_from_scans(pdf_scans(files, parse), image_reader(engine) if engine else None, classify))


# What earlier runs wrote


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of chunks.json files, one document to a file or to a line."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path)


def chunks_of(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.explode("chunks").alias("c")).select("c.*")


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The path that was modified last, of files or folders that the pattern matches; None if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return None
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString())).getPath().toString()
