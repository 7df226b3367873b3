"""Engine settings.  Site-specific words and selectors are configuration, with neutral defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_chunk: int = 80
    max_chunk: int = 1200
    merge_similarity: float = 0.75
    embed_batch: int = 64
    dense_dims: int = 1536
    upsert_batch: int = 100
    sparse_terms: int = 256
    candidates: int = 20
    rerank_top: int = 5
    prefetch: int = 20
    context_chars: int = 6000
    min_rerank_score: float = 0.15
    validation_retries: int = 2
    crawl_depth: int = 50
    min_content: int = 50
    rrf_k: int = 2
    server_idf: bool = True
    answer_log: bool = True
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    main_selectors: tuple[str, ...] = ("section#middle", "#content")
    topic_words: tuple[str, ...] = ("certificate", "exam", "exams", "level", "registration")
    allowed_domains: tuple[str, ...] = field(default=("example.com", "example.org", "example.net"))

    @classmethod
    def from_mapping(cls, values: dict[str, str]) -> EngineConfig:
        """Settings by name from strings; unknown names are ignored, comma lists drop blanks."""
        out = {}
        for f in fields(cls):
            if f.name in values:
                raw, kind = values[f.name], type(getattr(cls(), f.name))
                if kind is tuple:
                    out[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
                elif kind is bool:
                    out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                else:
                    out[f.name] = kind(raw)
        return cls(**out)
