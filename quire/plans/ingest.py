"""From files to chunks, payloads and an index."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quire.config import Settings
from quire.functions import lang
from quire.operators import advice, chunks, languages, retrieval, summary, units
from quire.schemas import RESULT_SCHEMA
from quire.sources import files


@dataclass
class Ingested:
    pages: DataFrame
    analysis: DataFrame
    units: DataFrame
    chunks: DataFrame
    payloads: DataFrame


def ingest_pages(pages: DataFrame, settings: Settings = Settings(), advisor: advice.BoundaryAdvisor | None = None, found_files: DataFrame | None = None, classify: lang.Classifier = lang.by_function_words) -> Ingested:
    """Chunks and payloads of a table of pages. All documents go through in one plan."""
    budget = chunks.Budget(settings.min_chunk_words, settings.target_chunk_words, settings.max_chunk_words, settings.chunk_overlap_words)
    analysis = languages.analyze(pages, languages.evidence(pages, classify))
    paragraph = units.paragraph_units(pages)
    made = advice.route(paragraph, budget, advisor, settings.semantic_chunking_enabled, settings.advisor_window, analysis=analysis, classify=classify)
    return Ingested(pages, analysis, paragraph, made, summary.payloads(pages, made, analysis, found_files))


def ingest(spark: SparkSession, path: str | list[str], settings: Settings | None = None, advisor: advice.BoundaryAdvisor | None = None, parse: files.PageParser | None = None, engine: files.OcrEngine | None = None) -> Ingested:
    """Files at a path: ValueError if one is of an unsupported kind, FileNotFoundError if there is none."""
    settings = settings or Settings.from_session(spark)
    found = files.read_files(spark, path)
    if bad := files.unsupported(found).limit(5).collect():
        raise ValueError("unsupported: " + ", ".join(r.doc for r in bad))
    pages = files.pages(found, parse=parse, engine=engine, page_chars=settings.page_chars, page_words=settings.page_words)
    return ingest_pages(pages, settings, advisor, found.drop("content"))


def search(spark: SparkSession, index_path: str | None, query: str, top: int = 5, threshold: float | None = None, embedder: retrieval.Embedder | None = None) -> DataFrame:
    """Results from an index, or from the newest one in the settings' index folder; none where there is none."""
    embedder = embedder or retrieval.HashingEmbedder()
    index_path = index_path or files.latest(spark, f"{Settings.from_session(spark).index_dir}/*")
    if index_path is None:
        logging.getLogger(__name__).warning("there is no index yet")
        return spark.createDataFrame([], RESULT_SCHEMA)
    return retrieval.retrieve(retrieval.load_index(spark, index_path), query, embedder, top, threshold)
