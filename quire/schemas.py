"""Schemas of the engine's tables."""

PAGE = (
    "doc string, page_number int, content string, source_type string, section string, language string, "
    "metadata struct<total_pages:int,char_count:int,extraction_method:string,needs_ocr:boolean,ocr_applied:boolean>"
)
CHUNK = (
    "chunk_id string, document_name string, page_number int, section string, chunk_index int, text string, "
    "word_count int, char_count int, char_start int, char_end int, language string, source_type string, "
    "ocr_applied boolean, metadata struct<page_start:int,chunking_strategy:string>"
)
CHUNK_COLUMNS = [c.strip().split(" ")[0] for c in CHUNK.split("metadata")[0].rstrip(", ").split(",")] + ["metadata"]
#: One document with its chunks, as written to chunks.json. A breakdown is an ordered list; the sink makes it a map.
PAYLOAD = (
    "document_name string, document_type string, file_size_bytes bigint, processed_at string, total_pages int, "
    "native_text_pages int, ocr_pages int, total_chunks int, total_characters bigint, average_chunk_words double, "
    "average_chunk_chars double, primary_language string, detected_languages array<string>, "
    "language_breakdown map<string,double>, language_summary string, is_multilingual boolean, ocr_used boolean, "
    f"chunking_strategy string, chunks array<struct<{CHUNK.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' struct<', ':struct<')}>>"
)
RESULT_COLUMNS = [
    "chunk_id", "text", "original_text", "page", "page_number", "section", "language", "similarity_score", "score",
    "document_name", "chunk_index", "word_count", "char_count", "char_start", "char_end", "source_type", "ocr_applied", "metadata",
]
RESULT_SCHEMA = (
    "chunk_id string, text string, original_text string, page int, page_number int, section string, language string, "
    "similarity_score double, score double, document_name string, chunk_index int, word_count int, char_count int, "
    "char_start int, char_end int, source_type string, ocr_applied boolean, metadata map<string,string>"
)
