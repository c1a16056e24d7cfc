"""Settings: defaults, then environment variables, then spark.quire.* of a session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    uploads_dir: str = "data/uploads"
    processed_dir: str = "data/processed"
    index_dir: str = "data/indices"
    embedding_dim: int = 384
    min_chunk_words: int = 250
    target_chunk_words: int = 450
    max_chunk_words: int = 750
    chunk_overlap_words: int = 40
    page_chars: int = 2500
    page_words: int = 350
    semantic_chunking_enabled: bool = True
    advisor_window: int = 5
    advisor_name: str = "llama3.2"
    advisor_url: str = "http://localhost:11434"
    advisor_timeout: int = 30
    #: What the flags of chunk size in characters would set. They never had an effect, so they are refused.
    chunk_size: int | None = None
    chunk_overlap: int | None = None

    def __post_init__(self):
        if self.chunk_size is not None or self.chunk_overlap is not None:
            raise ValueError("chunks are sized in words: set min_chunk_words, target_chunk_words, max_chunk_words, chunk_overlap_words")
        if not 0 <= self.chunk_overlap_words or not 0 <= self.min_chunk_words or not 0 < self.target_chunk_words or not 0 < self.max_chunk_words:
            raise ValueError("word counts must be positive")

    def with_values(self, values: dict[str, str]) -> Settings:
        """These settings with values from strings, by field name."""
        made = {}
        for f in fields(self):
            if f.name in values and values[f.name] not in (None, ""):
                old, new = getattr(self, f.name), values[f.name]
                made[f.name] = str(new).lower() in ("1", "true", "yes") if isinstance(old, bool) else int(new) if isinstance(old, int) or old is None else str(new)
        return replace(self, **made)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls().with_values({f.name: env[f.name.upper()] for f in fields(cls) if f.name.upper() in env})

    @classmethod
    def from_session(cls, spark) -> Settings:
        held = {f.name: spark.conf.get(f"spark.quire.{f.name}", None) for f in fields(cls)}
        return cls.from_env().with_values({k: v for k, v in held.items() if v is not None})
