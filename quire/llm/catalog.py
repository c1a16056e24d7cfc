"""Queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .matroska import op9_matroska
from .mixing import OP7_SQL, op7_mix_sources
from .nearest import op4_nearest
from .ngram_join import OP6_SQL, op6_ngram_join
from .pii import op2_pii_pseudonyms
from .quality import op5_quality
from .secrets import op1_secret_scan
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op3_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_pii_pseudonyms, op3_token_counts, op4_nearest, op5_quality, op6_ngram_join, op7_mix_sources, op8_suffix_dedup, op9_matroska, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": OP6_SQL, "op7_mix_sources": OP7_SQL}
