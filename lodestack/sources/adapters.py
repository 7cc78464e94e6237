"""Sources of elements: plain documents (a line is a paragraph), HTML pages, spans of a layout parser, PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.geometry import is_bold
from lodestack.functions.text import LIST_MARK, MARK_ONLY, clean, half_points, norm_title, strip, wide

LINES_A_PAGE = 40


def document_lines(documents: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """doc_id, pos, page, text: the non-blank lines of each document, pages of ``lines_a_page`` lines."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.length(F.trim("text")) > 0).select("doc_id", "pos", (F.floor(F.col("pos") / lines_a_page) + 1).cast("int").alias("page"), "text")


def unescape(text: Column) -> Column:
    """The common HTML entities as characters, & last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


#: A heading, paragraph or list item, with attributes or without.
ELEMENT = r"(?s)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, level, text: headings, paragraphs and list items of HTML pages in order."""
    tags = F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(1))
    bodies = F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), bodies.alias("body"))).alias("pos", "e"))
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(F.col("e.body"), "<[^>]*>", " ")), "[ \\t\\n]+", " "))
    kind = F.when(F.col("e.tag").startswith("h"), "heading").when(F.col("e.tag") == "li", "list").otherwise("paragraph")
    level = F.when(F.col("e.tag").startswith("h"), F.substring("e.tag", 2, 1).cast("int")).otherwise(0)
    return rows.select("page_id", "pos", kind.alias("kind"), level.alias("level"), text.alias("text")).where("text <> ''")


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Blocks of the input contract from spans (doc_id, page, block, line, span, text, size, flags, font, x0, y0, x1, y1).

    Lines are glued spans; a line that is a list mark alone goes before the next one. The size
    is the one with most characters at half points, first seen on a tie; a block is bold
    from 80 % of its characters.
    """
    key = ["doc_id", "page", "block"]
    n = F.length(strip(F.col("text")))
    sized = spans.withColumn("n", n).withColumn("half", half_points(F.col("size"))).withColumn("heavy", is_bold(F.col("flags"), F.col("font")))
    sizes = sized.where("n > 0").groupBy(*key, "half").agg(F.sum("n").alias("chars"), F.min(F.struct("line", "span")).alias("first"))
    best = sizes.groupBy(*key).agg(F.max_by("half", F.struct("chars", (-F.col("first.line")).alias("a"), (-F.col("first.span")).alias("b"))).alias("size"), F.sum("chars").cast("int").alias("chars"))
    bold = sized.groupBy(*key).agg((F.sum(F.when(F.col("heavy"), F.col("n")).otherwise(0)) / F.sum("n") >= 0.8).alias("bold"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    whole = sized.groupBy(*key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = whole.select(*key, "line", clean(F.col("text")).alias("text")).where("text <> ''")
    lines = whole.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    empty = F.array().cast("array<string>")

    def but_last(a: Column) -> Column:
        return F.slice(a, 1, F.size(a) - 1)

    def last(a: Column) -> Column:
        return F.element_at(a, -1)

    glued = F.aggregate("lines", empty, lambda a, x: F.when((F.size(a) > 0) & F.coalesce(F.try_element_at(a, F.lit(-1)).rlike(wide(MARK_ONLY)), F.lit(False)), F.concat(but_last(a), F.array(F.concat_ws(" ", F.trim(last(a)), x)))).otherwise(F.concat(a, F.array(x))))
    lines = lines.select(*key, glued.alias("lines")).withColumn("is_list", F.get("lines", F.lit(0)).rlike(wide(LIST_MARK)))
    join = lambda a, b: F.when(a.rlike("\\p{L}-$") & b.rlike("^\\p{Ll}"), F.concat(F.expr("''"), F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))
    items = F.aggregate("lines", empty, lambda a, x: F.when((F.size(a) == 0) | (F.col("is_list") & x.rlike(wide(LIST_MARK))), F.concat(a, F.array(x))).otherwise(F.concat(but_last(a), F.array(join(last(a), x)))))
    text = lines.select(*key, "is_list", F.size("lines").alias("n_lines"), F.array_join(items, "\n").alias("text"))
    return text.join(best, key).join(bold, key).select("doc_id", "page", F.col("block").alias("pos"), "text", "x0", "y0", "x1", "y1", "size", "bold", "n_lines", "is_list", "chars")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of .pdf files, in any case of the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(".pdf")).select("path", "content")


class UnreadableFile(ValueError):
    """A file that the parser can't open, or that is locked by a password."""


def parse_files(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Blocks of binary files by a parser plug-in that gives dicts of a block's fields; a file it can't read raises UnreadableFile."""

    def run(frames: Iterator):
        import pandas as pd

        names = [x.split()[0] for x in schemas.BLOCKS.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    blocks = parser(bytes(content))
                except Exception as error:
                    raise UnreadableFile(f"{path}: {error}") from error
                yield pd.DataFrame([{**b, "doc_id": path} for b in blocks], columns=names)

    return files.mapInPandas(run, schemas.BLOCKS)


def found_tables(pages: DataFrame, finder: Callable[[bytes, str], list[dict]] | None, config=None) -> DataFrame:
    """Tables (x0, y0, x1, y1, rows) of pages (doc_id, page, content) by a finder plug-in, which gets a page and the strategy.

    None are found where the settings switch them off, there is no finder, or it fails on a page. Grids
    are cleaned, and those that make no real table go.
    """
    import logging

    from lodestack.config import ChunkingConfig
    from lodestack.functions.text import clean_grid, is_real_table

    config = config or ChunkingConfig()

    def run(frames: Iterator):
        import pandas as pd

        names = [x.split()[0] for x in schemas.TABLES.split(", ")]
        for frame in frames:
            for doc_id, page, content in zip(frame["doc_id"], frame["page"], frame["content"]):
                try:
                    tables = finder(bytes(content), config.table_strategy) if finder and config.detect_tables else []
                except Exception:
                    logging.getLogger(__name__).exception("no tables of page %s of %s", page, doc_id)
                    tables = []
                yield pd.DataFrame([{**t, "doc_id": doc_id, "page": page} for t in tables], columns=names)

    found = pages.select("doc_id", "page", "content").mapInPandas(run, schemas.TABLES)
    found = found.withColumn("rows", clean_grid(F.col("rows")))
    return found.where(is_real_table(F.col("rows")))


def outline_entries(outline: DataFrame) -> DataFrame:
    """doc_id, page, entry, level, title (normalised) of a document's bookmarks (doc_id, entry, level, title, page); those without title or page go."""
    rows = outline.select("doc_id", "page", "entry", "level", norm_title(F.col("title")).alias("title"))
    return rows.where("title <> '' AND page >= 1")
