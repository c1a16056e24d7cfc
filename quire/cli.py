"""Command line: python -m quire.cli ingest FILE | search INDEX QUERY."""

from __future__ import annotations

import argparse
import pathlib
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.config import Settings
from quire.operators import advice
from quire.plans import ingest
from quire.sources import engines, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="chunk a document")
    one.add_argument("document")
    one.add_argument("-o", "--output")
    one.add_argument("--native-only", "--no-ocr", dest="ocr", action="store_false", help="never read pages by OCR")
    one.add_argument("--semantic", action=argparse.BooleanOptionalAction, default=None, help="ask a boundary advisor")
    one.add_argument("--chunk-size", type=int, help="refused: chunks are sized in words")
    one.add_argument("--chunk-overlap", type=int, help="refused: chunks are sized in words")
    two = sub.add_parser("search", help="search an index")
    two.add_argument("index")
    two.add_argument("query")
    two.add_argument("-k", "--top", type=int, default=5)
    two.add_argument("--threshold", type=float)
    a = p.parse_args(args)
    try:
        spark = _session()
        if a.command == "search":
            ingest.search(spark, a.index, a.query, a.top, a.threshold).select("score", "chunk_id", "page", F.substring("text", 1, 80).alias("text")).show(truncate=False)
            return 0
        settings = replace(Settings.from_session(spark), chunk_size=a.chunk_size, chunk_overlap=a.chunk_overlap)
        if a.semantic is not None:
            settings = replace(settings, semantic_chunking_enabled=a.semantic)
        advisor = advice.ChatAdvisor(settings.advisor_url, settings.advisor_name, settings.advisor_timeout) if settings.semantic_chunking_enabled else None
        done = ingest.ingest(spark, a.document, settings, advisor, engines.pdf_parser(), engines.best if a.ocr else None)
        made = done.payloads.cache()
        target = a.output or f"{settings.processed_dir}/{pathlib.Path(a.document).stem}_chunks.json"
        sinks.export_payload(made, target)
        r = made.first()
        print(f"pages {r.total_pages} (OCR {r.ocr_pages}), characters {r.total_characters}, chunks {r.total_chunks}, words a chunk {r.average_chunk_words}, language {r.language_summary}, strategy {r.chunking_strategy}")
        for c in r.chunks[:3]:
            print(f"  {c.chunk_id}, page {c.page_number}, {c.section}: {c.text[:100]!r}")
        print(target)
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
