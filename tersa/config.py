"""Settings of the compressor; each becomes a literal in the plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    target_tokens: int = 32_000
    live_messages: int = 4
    min_compress_tokens: int = 256
    min_saving_tokens: int = 48
    text_ratio: float = 0.4
    json_max_rows: int = 30
    max_blob_chars: int = 8_000_000
    marker_prefix: str = "ctx-ref"
    salt: str = ""
