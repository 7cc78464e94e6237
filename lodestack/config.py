"""Settings of the engine, frozen; values are bound into plans as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ChunkingConfig:
    """Limits of chunking, heading detection and OCR planning (fixed values of the domain)."""

    max_chars: int = 1200
    min_chars: int = 250
    overlap: int = 150
    max_table_chars: int = 3000
    margin: float = 0.08
    heading_ratio: float = 1.12
    max_heading_chars: int = 200
    max_levels: int = 6
    detect_tables: bool = True
    table_strategy: str = "lines"
    ocr_min_chars: int = 40
    ocr_textless: float = 0.10
    ocr_figure: float = 0.12
    ocr_background: float = 0.80
    ocr_min_image: float = 0.03
    ocr_figures: bool = True
    ocr_max_pages: int = 24
    ocr_dpi: int = 150
    ocr_max_side: int = 1800


@dataclass(frozen=True)
class RetrievalConfig:
    candidates: int = 20
    final: int = 5
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    window: int = 1
    expand_chars: int = 3600
    excerpt: int = 400
    history_messages: int = 12
    message_chars: int = 2000
    history_chars: int = 12_000


def env_bool(value: str | None, default: bool = False) -> bool:
    """True for 1, true, yes, on in any case; the default where nothing is set."""
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


def env_list(value: str | None) -> list[str]:
    """Comma-separated entries, trimmed, without a trailing slash, without empty ones."""
    return [y for x in (value or "").split(",") if (y := x.strip().rstrip("/"))]


def chunking_config(env: Mapping[str, str] | None = None) -> ChunkingConfig:
    """The settings, with the page cap and the figures flag of OCR taken from the environment."""
    env = os.environ if env is None else env
    base = ChunkingConfig()
    cap = env.get("OCR_MAX_PAGES")
    return replace(base, ocr_max_pages=int(cap) if cap else base.ocr_max_pages, ocr_figures=env_bool(env.get("OCR_FIGURES"), base.ocr_figures))
