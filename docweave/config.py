"""Engine settings, with the environment variables that override them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Setting name -> environment variable.
ENVIRONMENT = {
    "chunk_size": "CHUNK_SIZE",
    "chunk_overlap": "CHUNK_OVERLAP",
    "embedding_dim": "EMBEDDING_DIM",
    "retrieval_mode": "RETRIEVAL_MODE",
    "extract_max_tokens": "EXTRACT_MAX_TOKENS",
    "answer_max_tokens": "AGENT_MAX_TOKENS",
    "query_max_tokens": "TEXT2CYPHER_MAX_TOKENS",
    "ingest_concurrency": "INGEST_CONCURRENCY",
    "schema_file": "SCHEMA_FILE",
    "trace_dir": "TRACE_DIR",
    "llm_base_url": "LLM_BASE_URL",
    "llm_model": "LLM_MODEL",
}


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 900
    chunk_overlap: int = 150
    embedding_dim: int = 1024
    embed_batch: int = 64
    retrieval_mode: str = "hybrid"
    top_k: int = 8
    rrf_k: int = 60
    max_iterations: int = 3
    max_context_chunks: int | None = None
    max_chunk_text_chars: int | None = None
    query_attempts: int = 3
    query_page_rows: int = 25
    query_row_chars: int | None = None
    extract_attempts: int = 3
    extract_slice_rows: int = 200
    extract_max_tokens: int = 8192
    answer_max_tokens: int = 4096
    query_max_tokens: int = 8192
    ingest_concurrency: int = 6
    schema_file: str = ""
    trace_dir: str = ""
    llm_base_url: str = ""
    llm_model: str = ""
    table_buckets: int = 64

    def __post_init__(self):
        if not 1 <= self.embedding_dim <= 4096:
            raise ValueError(f"embedding_dim must be within 1..4096, got {self.embedding_dim}")
        if self.ingest_concurrency < 1:
            object.__setattr__(self, "ingest_concurrency", 1)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> "EngineConfig":
        env = os.environ if env is None else env
        types = {f.name: type(f.default) for f in fields(cls)}
        values = {
            name: types[name](env[variable])
            for name, variable in ENVIRONMENT.items()
            if env.get(variable)
        }
        return cls(**{**values, **overrides})
