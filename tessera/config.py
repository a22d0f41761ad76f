"""Defaults of the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    threshold: float = 0.4
    context_chars: int = 4000
    default_bucket: str = "documents"
    max_source_bytes: int = 1 << 30


@dataclass(frozen=True)
class Compaction:
    turn_trigger: int = 20
    token_share: float = 0.5
    context_tokens: int = 8192
    keep: int = 8
    summary_tokens: int = 800
    marker: str = "[Conversation summary]"


@dataclass(frozen=True)
class Chunking:
    tokens: int = 500
    min_chars: int = 350
    min_embed_chars: int = 5
    max_chunks: int | None = None
    breaks: str = ".!?;\n"


@dataclass(frozen=True)
class PageGate:
    min_words: int = 10
    min_reading_ease: float = 20.0
    repetition_words: int = 50
    min_distinct_share: float = 0.1
    challenge_chars: int = 50_000


@dataclass(frozen=True)
class Memory:
    top_k: int = 10
    max_k: int = 100
    max_text: int = 32_768
    max_query: int = 2_048
    user_pattern: str = r"^[A-Za-z0-9._\-@:+]{1,128}$"


@dataclass(frozen=True)
class Buckets:
    """Upper bounds of latency histograms."""

    bounds: tuple[float, ...] = field(default=(5.0, 10.0, 25.0, 50.0, 75.0, 100.0))
