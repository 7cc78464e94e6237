"""Page layout: furniture, body font, heading levels, reading order, tables and blocks, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.config import ChunkingConfig
from lodestack.functions.geometry import in_margin, overlap_ratio
from lodestack.functions.text import furniture_key, is_page_number

CONFIG = ChunkingConfig()


def furniture_keys(blocks: DataFrame, pages: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """doc_id, key, n_pages: margin texts (numbers alike) on max(3, 40 %) pages of a document at least."""
    there = blocks.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).where(in_margin(F.col("y0"), F.col("y1"), F.col("height"), config))
    keyed = there.select("doc_id", "page", furniture_key(F.col("text")).alias("key")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_pages"))
    count = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("of_pages"))
    return keyed.join(count, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("of_pages") * 0.4))).select("doc_id", "key", "n_pages")


def mark_furniture(blocks: DataFrame, pages: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """``blocks`` with is_furniture: in the margin, and a page number or a repeated text."""
    keys = furniture_keys(blocks, pages, config).select("doc_id", "key", F.lit(True).alias("repeated"))
    rows = blocks.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).withColumn("key", furniture_key(F.col("text"))).join(keys, ["doc_id", "key"], "left")
    margin = in_margin(F.col("y0"), F.col("y1"), F.col("height"), config)
    return rows.withColumn("is_furniture", margin & (is_page_number(F.col("text")) | F.coalesce("repeated", F.lit(False)))).select(*blocks.columns, "is_furniture")


def body_size(blocks: DataFrame) -> DataFrame:
    """doc_id, body: the half-point size with most characters, the first seen on a tie; 10 without blocks."""
    sizes = blocks.groupBy("doc_id", F.expr("bround(size * 2) / 2").alias("half")).agg(F.sum("chars").alias("n"), F.min("pos").alias("pos"))
    return sizes.groupBy("doc_id").agg(F.coalesce(F.max_by("half", F.struct("n", (-F.col("pos")).alias("p"))), F.lit(10.0)).alias("body"))


def heading_levels(headings: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """``headings`` (doc_id, size, level) with levels: larger sizes first, emphasis (size 0) behind all sizes."""
    order = Window.partitionBy("doc_id").orderBy(F.col("size").desc())
    sized = headings.where("size > 0").select("doc_id", "size").distinct().withColumn("rank", F.dense_rank().over(order))
    count = sized.groupBy("doc_id").agg(F.max("rank").alias("sizes"))
    rows = headings.join(sized, ["doc_id", "size"], "left").join(count, "doc_id", "left")
    found = F.least(F.coalesce("rank", F.coalesce("sizes", F.lit(0)) + 1), F.lit(config.max_levels))
    return rows.withColumn("level", F.when(F.coalesce("level", F.lit(0)) > 0, F.col("level")).otherwise(found)).select(*headings.columns)


def reading_order(blocks: DataFrame, width: Column) -> DataFrame:
    """``blocks`` with reading_pos: two columns are read one after the other between wide blocks.

    Only if a page has two narrow blocks on each side and some pair stands side by side. That
    pair exists exactly if, in order of y0, a block of one side starts above the lowest end
    of the other side's blocks before it; no pair is formed.
    """
    wide, left = F.col("x1") - F.col("x0") > width * 0.6, (F.col("x0") + F.col("x1")) / 2 < width / 2
    rows = blocks.withColumn("__side", F.when(wide, 0).when(left, 1).otherwise(2))
    page = Window.partitionBy("doc_id", "page")
    tied = page.orderBy("y0", "x0", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of blocks that start at the same height those without height come first: nothing that starts there is beside them.
    above = page.orderBy("y0", "y1", "x0", "pos").rowsBetween(Window.unboundedPreceding, -1)
    low = lambda side: F.max(F.when(F.col("__side") == side, F.col("y1"))).over(above)
    other = F.when(F.col("__side") == 1, low(2)).when(F.col("__side") == 2, low(1))
    rows = rows.withColumn("__beside", F.coalesce(F.col("y0") < other, F.lit(False)))
    rows = rows.withColumn("__seg", F.sum((F.col("__side") == 0).cast("int")).over(tied))
    two = (F.count_if(F.col("__side") == 1).over(page) >= 2) & (F.count_if(F.col("__side") == 2).over(page) >= 2) & F.max("__beside").over(page)
    rows = rows.withColumn("__two", two)
    order = page.orderBy(F.when(F.col("__two"), F.col("__seg")).otherwise(0), F.when(F.col("__two"), F.col("__side")).otherwise(0), "y0", "x0", "pos")
    return rows.withColumn("reading_pos", F.row_number().over(order) - 1).select(*blocks.columns, "reading_pos")


def outside_tables(blocks: DataFrame, tables: DataFrame, most: float = 0.5) -> DataFrame:
    """``blocks`` that no table of their page covers by more than ``most``."""
    b, t = blocks.alias("b"), tables.alias("t")
    box = lambda x: tuple(F.col(f"{x}.{c}") for c in ("x0", "y0", "x1", "y1"))
    return b.join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & (overlap_ratio(box("b"), box("t")) > most), "left_anti")


def insert_positions(items: DataFrame, flow: DataFrame) -> DataFrame:
    """``items`` (doc_id, page, item, y) with before_pos: the first flow place with y0 >= y - 1, null at the end."""
    i, f = items.alias("i"), flow.select("doc_id", "page", F.col("reading_pos").alias("p"), "y0").alias("f")
    rows = i.join(f, (F.col("i.doc_id") == F.col("f.doc_id")) & (F.col("i.page") == F.col("f.page")) & (F.col("f.y0") >= F.col("i.y") - 1), "left")
    return rows.groupBy(*[F.col(f"i.{c}").alias(c) for c in items.columns]).agg(F.min("f.p").alias("before_pos"))


def page_chars(blocks: DataFrame, pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, page, chars of ``pages``: characters of the blocks (without furniture) and of all cells of tables; 0 for none."""
    parts = blocks.select("doc_id", "page", F.col("chars").cast("long").alias("n"))
    if tables is not None:
        cells = F.transform(F.flatten("rows"), lambda c: F.length(c))
        parts = parts.unionByName(tables.select("doc_id", "page", F.aggregate(cells, F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0))).alias("n")))
    sums = parts.groupBy("doc_id", "page").agg(F.sum("n").alias("chars"))
    return pages.select("doc_id", "page").join(sums, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("chars", F.lit(0)).alias("chars"))


def image_coverage(images: DataFrame, config: ChunkingConfig = CONFIG) -> DataFrame:
    """doc_id, page, image_coverage, biggest_image, first_y from clipped images (x0..y1, width, height); tiny ones don't count."""
    clip = lambda c, m: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(m))
    area = F.greatest(clip("x1", "width") - clip("x0", "width"), F.lit(0.0)) * F.greatest(clip("y1", "height") - clip("y0", "height"), F.lit(0.0))
    rows = images.withColumn("share", area / (F.col("width") * F.col("height"))).where(F.col("share") >= config.ocr_min_image)
    return rows.groupBy("doc_id", "page").agg(F.least(F.sum("share"), F.lit(1.0)).alias("image_coverage"), F.max("share").alias("biggest_image"), F.min("y0").alias("first_y"))
