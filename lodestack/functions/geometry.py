"""Boxes on a page as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.config import ChunkingConfig


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of box ``a`` (x0, y0, x1, y1) that box ``b`` covers; 0 if apart or without area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when((w > 0) & (h > 0) & (area > 0), w * h / area).otherwise(0.0)


def in_margin(y0: Column, y1: Column, height: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Whether a block lies in the top or bottom zone of its page."""
    zone = height * config.margin
    return (y1 <= zone) | (y0 >= height - zone)


def render_zoom(width: Column, height: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Zoom of a page image: the resolution wanted, within the longest side allowed."""
    return F.least(F.lit(config.ocr_dpi / 72), config.ocr_max_side / F.greatest(width, height))


def is_bold(flags: Column, font: Column) -> Column:
    """Whether a span is bold by its flag bit 16 or its font's name."""
    return (flags.bitwiseAND(F.lit(16)) != 0) | F.lower(font).rlike("bold|black|heavy|semibold|demi")


def heading_style(text: Column, size: Column, bold: Column, n_lines: Column, is_list: Column, body: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Null: no heading; else its size if larger than the body, or 0.0 for one by emphasis alone."""
    from lodestack.functions.text import is_caption

    n = F.length(text)
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    barred = is_list | (n_lines > 3) | ~n.between(2, config.max_heading_chars) | is_caption(text) | text.rlike("[,;]$") | (letters < 2) | (letters / n < 0.4) | (text.endswith(".") & (size < body * 1.3))
    level = (size >= body * 0.98) & (n_lines <= 2)
    capitals = (text == F.upper(text)) & (text != F.lower(text)) & (letters >= 3)
    return (
        F.when(F.coalesce(barred, F.lit(True)), F.lit(None))
        .when(size >= body * config.heading_ratio, size)
        .when(bold & level & (n <= 120), 0.0)
        .when(capitals & level & (n <= 100), 0.0)
        .cast("double")
    )
