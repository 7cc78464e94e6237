"""OCR planning: which pages to read, page ranges of what was skipped, batches, reconciliation."""

from __future__ import annotations

import logging
import re
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.config import ChunkingConfig
from lodestack.functions.text import FIGURE_LABEL, strip, strip_fence
from lodestack.storage import materialize

CONFIG = ChunkingConfig()

# Fixed values of the domain: what users are told about pages that weren't read.
NO_OUTPUT, FAILED, NOT_RENDERED = "OCR returned no output", "the OCR service failed", "the page could not be rendered"
OVER_LIMIT = "over the per-document OCR limit of {} pages"
NOT_READ = ("Pages ", " were not OCR'd: ", ".")
SCANNED = ("Pages ", " look like scanned images with no text layer. OCR is not available, so their content cannot be searched.")
PICTURES = ("Pages ", " contain images whose text is not indexed (OCR is not available).")
NO_TEXT = "the model returned no text for this page"
BUDGET_USED, BUDGET_DOWN = "the daily OCR request budget is used up (resets at midnight Pacific)", "the OCR usage counter is unavailable"
QUOTA_USED, REJECTED = "the OCR service's daily quota is used up", "the OCR service rejected the request ({})"
# Fixed values of the domain: pages a request, retries, the longest wait in seconds, the first wait.
PAGES_A_REQUEST, RETRIES, LONGEST_WAIT, FIRST_WAIT = 3, 3, 90.0, 5.0


def plan(pages: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """doc_id, page, mode, place, wanted of pages (chars, image_coverage, biggest_image) that need OCR.

    Pages with hardly any text but images are read in full, before pages with figures; those
    beyond the cap aren't wanted.
    """
    full = (F.col("chars") < config.ocr_min_chars) & (F.col("image_coverage") >= config.ocr_textless)
    figures = (F.col("chars") >= config.ocr_min_chars) & (F.col("image_coverage") >= config.ocr_figure) & (F.col("biggest_image") < config.ocr_background)
    mode = F.when(full, "full").when(figures & F.lit(config.ocr_figures), "figures")
    rows = pages.withColumn("mode", mode).where("mode IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy((F.col("mode") == "figures").cast("int"), "page")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    return rows.select("doc_id", "page", "mode", "place", (F.col("place") < config.ocr_max_pages).alias("wanted"))


def page_ranges(rows: DataFrame, *keys: str, page: str = "page") -> DataFrame:
    """``keys``, ranges: sorted distinct numbers as "1-3, 7, 9-10"."""
    numbers = rows.select(*keys, F.col(page).cast("long").alias("n")).distinct()
    islands = numbers.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n"))).groupBy(*keys, "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = islands.select(*keys, "a", text.alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "t"))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), ", ").alias("ranges"))


def over_limit(planned: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """doc_id, page, reason of planned pages beyond the cap."""
    return planned.where(~F.col("wanted")).select("doc_id", "page", F.lit(OVER_LIMIT.format(config.ocr_max_pages)).alias("reason"))


def reconcile(wanted: DataFrame, returned: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of wanted pages (doc_id, page, markdown), and skipped pages (doc_id, page, reason) with those that never came."""
    key = ["doc_id", "page"]
    got = returned.join(wanted.select(*key), key, "left_semi")
    lost = wanted.select(*key).join(got.select(*key), key, "left_anti").join(skipped.select(*key), key, "left_anti")
    return got, skipped.select(*key, "reason").unionByName(lost.withColumn("reason", F.lit(NO_OUTPUT)))


def warnings(skipped: DataFrame) -> DataFrame:
    """doc_id, warning: a line per reason with its page ranges."""
    ranges = page_ranges(skipped, "doc_id", "reason")
    return ranges.select("doc_id", F.concat(F.lit(NOT_READ[0]), F.col("ranges"), F.lit(NOT_READ[1]), F.col("reason"), F.lit(NOT_READ[2])).alias("warning"))


def warnings_without_provider(planned: DataFrame) -> DataFrame:
    """doc_id, warning: what can't be searched where there is no OCR."""
    ranges = page_ranges(planned, "doc_id", "mode")
    told = lambda words: F.concat(F.lit(words[0]), F.col("ranges"), F.lit(words[1]))
    return ranges.select("doc_id", F.when(F.col("mode") == "full", told(SCANNED)).otherwise(told(PICTURES)).alias("warning"))


def classify(error: Exception) -> tuple[str, float | None]:
    """(retry, abort or fail; seconds that the error asks to wait) of a provider's exception with a ``code``.

    The rules are those of ``functions.text.error_action``, for the place where calls are made.
    """
    code, low = getattr(error, "code", None), str(error).lower()
    told = re.search(r"retrydelay\W+(\d+(?:\.\d+)?)s", low) or re.search(r"retry in (\d+(?:\.\d+)?)\s*s", low)
    delay = float(told[1]) if told else None
    daily = "daily" in low or "perday" in re.sub("[ _]", "", low)
    if code == 429 and (daily or (delay or 0) > LONGEST_WAIT) or code in (401, 403, 404):
        return "abort", delay
    if code in (429, 500, 502, 503, 504) or re.search("timeout|connect", type(error).__name__.lower()):
        return "retry", delay
    return "fail", delay


class Stop(Exception):
    """No more requests for this document; the message is the reason."""


def request(pages: list[dict], provider, retries: int, budget: Callable[[], bool] | None, sleep: Callable[[float], None]) -> tuple[dict, dict]:
    """Markdown and skip reasons by page of one request, tried again where the error allows it; each try is charged to the budget."""
    for left in range(retries, -1, -1):
        try:
            charged = budget is None or budget()
        except Exception as error:
            logging.getLogger(__name__).exception("the OCR budget failed")
            raise Stop(BUDGET_DOWN) from error
        if not charged:
            raise Stop(BUDGET_USED)
        try:
            answer = provider(pages)
            return answer if isinstance(answer, tuple) else (answer, {})
        except Exception as error:  # a broken service must cost pages, not the document
            action, delay = classify(error)
            logging.getLogger(__name__).warning("OCR of pages %s: %s, %d tries left: %s", [x["page"] for x in pages], action, left, error)
            if action == "abort":
                code = getattr(error, "code", None)
                raise Stop(QUOTA_USED if code == 429 else REJECTED.format(code or type(error).__name__)) from error
            if action == "fail" or not left:
                return {}, {None: FAILED}
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2 ** (retries - left) if delay is None else delay))
    return {}, {None: FAILED}


def read_document(asked: list[dict], provider, size: int = PAGES_A_REQUEST, retries: int = RETRIES, budget=None, sleep=time.sleep) -> dict:
    """(markdown, reason) by page: requests of ``size`` pages, then single ones for pages that a request left out.

    A page keeps the reason of the request that failed. A stop ends the document's other requests too.
    """
    out: dict[int, tuple] = {}
    todo = deque((asked[i : i + size], NO_TEXT) for i in range(0, len(asked), size))
    try:
        while todo:
            pages, reason = todo[0]
            found, skipped = request(pages, provider, retries, budget, sleep)
            todo.popleft()
            reason = skipped.get(None, reason)
            out |= {x["page"]: (found[x["page"]], None) for x in pages if x["page"] in found}
            out |= {x["page"]: (None, skipped[x["page"]]) for x in pages if x["page"] in skipped and x["page"] not in out}
            lost = [x for x in pages if x["page"] not in out]
            if len(pages) > 1:
                todo.extendleft(([x], reason) for x in reversed(lost))
            else:
                out |= {x["page"]: (None, reason) for x in lost}
    except Stop as stop:
        out |= {x["page"]: (None, str(stop)) for pages, _ in todo for x in pages}
    return out


def call_provider(wanted: DataFrame, provider, size: int = PAGES_A_REQUEST, retries: int = RETRIES, budget=None, sleep=time.sleep) -> DataFrame:
    """doc_id, page, markdown, reason: a plug-in's results, each page asked for as ``read_document`` does it, written once.

    The plug-in gets a list of dicts (doc_id, page, mode) and gives {page: markdown}, or that and {page: reason
    it was skipped}. A document's pages, bounded by the plan's cap, are one task's work. A task that is
    run again, after the loss of its executor, asks again.
    """

    def run(frame):
        import pandas as pd

        asked = frame.sort_values("place")[["doc_id", "page", "mode"]].to_dict("records")
        out = read_document(asked, provider, size, retries, budget, sleep)
        return pd.DataFrame([(x["doc_id"], x["page"], *out.get(x["page"], (None, NO_OUTPUT))) for x in asked], columns=["doc_id", "page", "markdown", "reason"])

    return materialize(wanted.groupBy("doc_id").applyInPandas(run, "doc_id string, page int, markdown string, reason string"), "ocr")


def read_pages(pages: DataFrame, provider=None, config: ChunkingConfig = CONFIG, size: int = PAGES_A_REQUEST, retries: int = RETRIES, budget=None, sleep=time.sleep) -> tuple[DataFrame, DataFrame]:
    """OCR of a batch of documents: doc_id, page, mode, markdown of pages read, and doc_id, warning."""
    planned = plan(pages, config)
    if provider is None:
        none = planned.where("false").select("doc_id", "page", "mode", F.lit("").alias("markdown"))
        return none, warnings_without_provider(planned)
    wanted = planned.where("wanted")
    back = call_provider(wanted, provider, size, retries, budget, sleep)
    told = back.where("reason IS NOT NULL").select("doc_id", "page", "reason")
    read, skipped = reconcile(wanted, back.where("reason IS NULL").select("doc_id", "page", "markdown"), told)
    read = read.join(wanted.select("doc_id", "page", "mode"), ["doc_id", "page"])
    return read.select("doc_id", "page", "mode", "markdown"), warnings(over_limit(planned, config).unionByName(skipped))


def batches(wanted: DataFrame, size: int = 3) -> DataFrame:
    """``wanted`` with batch, ``size`` pages of a document each."""
    order = Window.partitionBy("doc_id").orderBy("place")
    return wanted.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))


def figure_note(text: Column) -> Column:
    """A figure's text with its label; null for none."""
    inner = strip(strip_fence(text))
    return F.when((inner != "") & (F.regexp_replace(F.upper(inner), "\\.+$", "") != "NONE"), F.concat(F.lit(FIGURE_LABEL), inner))
