"""Plug points: embedder, reranker, language model, OCR; with offline defaults."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import strip

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[DataFrame], Column]
LanguageModel = Callable[[str], str]
OcrProvider = Callable[[list[dict]], "dict | tuple[dict, dict]"]


def hashing_embedder(width: int = 64) -> Embedder:
    """Signed feature hashing of lower-case ASCII words, of length 1; for tests and offline use."""

    def embed(texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in re.findall("[a-z0-9]+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % width] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


@dataclass(frozen=True)
class Plugins:
    """None: no OCR, no reranking, the question as it is, the prompt as the answer.

    ``budget`` is asked before each OCR request, ``sleep`` waits between tries.
    """

    embedder: Embedder = hashing_embedder()
    reranker: Reranker | None = None
    rewrite: LanguageModel | None = None
    answer: LanguageModel | None = None
    ocr: OcrProvider | None = None
    budget: Callable[[], bool] | None = None
    sleep: Callable[[float], None] = time.sleep


def ocr_plugin(enabled: bool, key: str | None, make: Callable[[str], OcrProvider]) -> OcrProvider | None:
    """The provider of ``make(key)``; None where OCR is off or has no key."""
    return make(key) if enabled and key else None


def mapped(rows: DataFrame, model: LanguageModel, text: str, into: str) -> DataFrame:
    """``rows`` with the model's text for column ``text`` in column ``into`` (null stays null), in Arrow batches."""
    kept = [f for f in rows.schema.fields if f.name != into]

    def run(frames):
        for frame in frames:
            frame[into] = [None if x is None else model(x) for x in frame[text]]
            yield frame[[*[f.name for f in kept], into]]

    return rows.mapInPandas(run, T.StructType([*kept, T.StructField(into, T.StringType())]))


def rewritten(questions: DataFrame, history: DataFrame | None, plugins: Plugins) -> DataFrame:
    """``questions`` (query_id, text) with search_text: stand-alone questions of those with a history, else their text.

    What the model leaves empty keeps its text as well.
    """
    if history is None or plugins.rewrite is None:
        return questions.withColumn("search_text", F.col("text"))
    rows = questions.join(history.select("query_id", F.col("history").alias("__history")), "query_id", "left")
    has = F.coalesce(F.col("__history"), F.lit("")) != ""
    rows = mapped(rows.withColumn("__ask", F.when(has, F.concat(F.col("__history"), F.lit("\n\n"), F.col("text")))), plugins.rewrite, "__ask", "__new")
    return rows.withColumn("search_text", F.coalesce(F.nullif(strip(F.col("__new")), F.lit("")), F.col("text"))).drop("__history", "__ask", "__new")
