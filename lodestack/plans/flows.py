"""Ingest and answer as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import ChunkingConfig, RetrievalConfig
from lodestack.functions.geometry import heading_style
from lodestack.functions.text import asked, markdown_headings, norm_title
from lodestack.operators import chunking, context, layout, ocr_plan, retrieval, structure
from lodestack.plugins import Plugins, mapped, rewritten
from lodestack.sources import tables as sinks
from lodestack.storage import materialize

KEY = ["doc_id", "page"]
GRID = "array<array<string>>"


def page_images(images: DataFrame | None, pages: DataFrame, config: ChunkingConfig) -> DataFrame:
    """``pages`` with image_coverage, biggest_image and first_y (the page's height without images)."""
    plain = pages.select(*KEY, "width", "height")
    if images is None:
        return plain.withColumn("image_coverage", F.lit(0.0)).withColumn("biggest_image", F.lit(0.0)).withColumn("first_y", F.col("height"))
    found = layout.image_coverage(images.join(plain, KEY), config)
    none = F.lit(0.0)
    return plain.join(found, KEY, "left").select(*KEY, "width", "height", F.coalesce("image_coverage", none).alias("image_coverage"), F.coalesce("biggest_image", none).alias("biggest_image"), F.coalesce("first_y", "height").alias("first_y"))


def outline_levels(outline: DataFrame, probed: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id of documents whose outline is trusted, and page, pos, level of the headings that it names in ``used``.

    An outline (doc_id, page, entry, level, title) is trusted by what it finds in ``probed``, all texts
    that could be headings; ``used`` holds those that make elements (doc_id, page, pos, norm), in order.
    """
    trusted = structure.trusted_outlines(structure.match_outline(probed, outline), outline)
    mine = outline.join(trusted, "doc_id", "left_semi")
    return trusted, structure.match_outline(used, mine).select("doc_id", "page", "pos", F.col("level").alias("outline_level"))


def document_elements(
    blocks: DataFrame,
    pages: DataFrame,
    tables: DataFrame | None = None,
    images: DataFrame | None = None,
    outline: DataFrame | None = None,
    plugins: Plugins = Plugins(),
    config: ChunkingConfig = ChunkingConfig(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements of documents, the pages that OCR read (doc_id, page, mode, markdown), and warnings (doc_id, warning).

    ``blocks``, ``pages`` and ``tables`` as in ``schemas``; ``images``: doc_id, page, x0, y0, x1, y1;
    ``outline`` as of ``adapters.outline_entries``. Blocks inside tables go before anything is counted.
    Pages that OCR read whole give their markdown's elements, others their blocks in reading order, with
    tables and notes on figures at their heights. Headings come from a trusted outline, else from fonts.
    """
    inside = blocks if tables is None else layout.outside_tables(blocks, tables).select(*blocks.columns)
    inside = materialize(layout.mark_furniture(inside, pages, config), "blocks")
    plain = inside.where(~F.col("is_furniture")).drop("is_furniture")
    pictured = page_images(images, pages, config)
    chars = layout.page_chars(plain, pages, tables)
    read, warnings = ocr_plan.read_pages(pictured.join(chars, KEY), plugins.ocr, config, budget=plugins.budget, sleep=plugins.sleep)
    full = read.where("mode = 'full'").select(*KEY, "markdown")
    marked = materialize(structure.markdown_items(full), "markdown")

    kept = plain.join(full.select(*KEY), KEY, "left_anti").join(pages.select(*KEY, "width"), KEY)
    sized = kept.join(layout.body_size(inside), "doc_id")
    ordered = materialize(layout.reading_order(sized, F.col("width")), "ordered")
    if outline is None:
        trusted, levels = None, None
    else:
        in_blocks = lambda rows, pos: rows.where("NOT is_list").select(*KEY, F.col(pos).cast("int").alias("pos"), norm_title(F.col("text")).alias("norm"))
        heads = markdown_headings(full, "markdown").select(*KEY, (F.col("line") + 1_000_000_000).alias("pos"), norm_title(F.col("title")).alias("norm"))
        in_markdown = marked.where("kind = 'heading'").select(*KEY, F.col("sub").alias("pos"), norm_title(F.col("text")).alias("norm"))
        trusted, levels = outline_levels(outline, in_blocks(inside, "pos").unionByName(heads), in_blocks(ordered, "reading_pos").unionByName(in_markdown))
        trusted, levels = materialize(trusted.withColumn("by_outline", F.lit(True)), "trusted"), materialize(levels, "levels")

    def with_levels(rows: DataFrame, pos: str) -> DataFrame:
        if trusted is None:
            return rows.withColumn("by_outline", F.lit(False)).withColumn("outline_level", F.lit(None).cast("int"))
        return rows.join(trusted, "doc_id", "left").join(levels.withColumnRenamed("pos", pos), [*KEY, pos], "left").withColumn("by_outline", F.coalesce("by_outline", F.lit(False)))

    def item(place: Column, kind: Column, text: Column, level: Column, size: Column, rows: Column, top: Column, first: Column, y: Column, x: Column, n: Column) -> list[Column]:
        """An item of a page: of several at one place those with the smaller ``first`` come before, then by y, x and n."""
        at = F.struct("page", place.cast("double").alias("place"), first.alias("first"), y.cast("double").alias("y"), x.cast("double").alias("x"), n.cast("long").alias("n"))
        return [F.col("doc_id"), at.alias("pos"), F.col("page"), kind.alias("kind"), text.alias("text"), level.cast("int").alias("level"), size.cast("double").alias("size"), rows.cast(GRID).alias("rows"), top.alias("at_page_top")]

    none, no, zero = F.lit(None), F.lit(False), F.lit(0)
    style = heading_style(F.col("text"), F.col("size"), F.col("bold"), F.col("n_lines"), F.col("is_list"), F.col("body"), config)
    flow = with_levels(ordered.withColumn("reading_pos", F.col("reading_pos").cast("int")), "reading_pos").withColumn("style", F.when(~F.col("by_outline"), style))
    heading = F.when(F.col("by_outline"), F.col("outline_level").isNotNull()).otherwise(F.col("style").isNotNull())
    kind = F.when(heading, "heading").when(F.col("is_list"), "list").otherwise("paragraph")
    items = flow.select(*item(F.col("reading_pos"), kind, F.col("text"), F.coalesce("outline_level", zero), F.coalesce("style", F.lit(0.0)), none, no, F.lit(1), zero, zero, zero))
    md = with_levels(marked, "sub")
    items = items.unionByName(md.select(*item(F.col("sub"), F.col("kind"), F.col("text"), F.coalesce("outline_level", "level"), F.lit(0.0), F.col("rows"), F.col("at_page_top"), F.lit(1), zero, zero, zero)))

    def inserted(rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (doc_id, page, y, x, n and ``columns``) with the place of the block that each comes before."""
        numbered = rows.select(*KEY, "y", "x", "n", *columns)
        return layout.insert_positions(numbered, ordered).withColumn("place", F.coalesce(F.col("before_pos").cast("double"), F.lit(1e9)))

    if tables is not None:
        of = tables.join(full.select(*KEY), KEY, "left_anti").join(pages.select(*KEY, "height"), KEY)
        of = of.select(*KEY, F.col("y0").alias("y"), F.col("x0").alias("x"), F.xxhash64("y1", "x1", F.to_json("rows")).alias("n"), "rows", (F.col("y0") < F.col("height") * 0.25).alias("top"))
        items = items.unionByName(inserted(of, "rows", "top").select(*item(F.col("place"), F.lit("table"), F.lit(""), zero, F.lit(0.0), F.col("rows"), F.col("top"), zero, F.col("y"), F.col("x"), F.col("n"))))
    notes = read.where("mode = 'figures'").select(*KEY, ocr_plan.figure_note(F.col("markdown")).alias("note")).where("note IS NOT NULL")
    notes = notes.join(pictured.select(*KEY, F.col("first_y").alias("y")), KEY).withColumn("x", F.lit(1e9)).withColumn("n", F.lit(0).cast("long"))
    items = items.unionByName(inserted(notes, "note").select(*item(F.col("place"), F.lit("paragraph"), F.col("note"), zero, F.lit(0.0), none, no, zero, F.col("y"), F.col("x"), F.col("n"))))

    elements = materialize(structure.assemble(items), "elements")
    heads = elements.where("kind = 'heading'").select("doc_id", "pos", "size", "level")
    ranked = layout.heading_levels(heads, config).select("doc_id", "pos", F.col("level").alias("__level"))
    elements = elements.join(ranked, ["doc_id", "pos"], "left").withColumn("level", F.coalesce("__level", "level")).drop("__level")
    return elements, read, warnings


def chunk_elements(elements: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks with breadcrumb, content, body_offset and chunk_id of elements (doc_id, pos, kind, text, page, page_end, level, rows, caption)."""
    numbered = structure.section_ids(elements)
    heads = numbered.where("kind = 'heading'")
    paths = structure.section_paths(heads.select("doc_id", "pos", "level", "text"))
    crumbs = heads.select("doc_id", "pos", "section_id").join(paths.select("doc_id", "pos", "path"), ["doc_id", "pos"]).select("doc_id", "section_id", F.array_join("path", " > ").alias("breadcrumb"))
    chunks = chunking.chunk_sections(numbered, config).join(crumbs, ["doc_id", "section_id"], "left")
    return chunking.with_context(chunks.withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit(""))))


def ingest(elements: DataFrame, config: ChunkingConfig = ChunkingConfig(), pages: DataFrame | None = None, read: DataFrame | None = None, warnings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks, and a summary per document: pages, sections, chunks, tables, ocr_pages, warnings.

    Elements and chunks are written once. ``pages``, ``read`` and ``warnings`` as ``document_elements`` has
    them; without ``pages`` the last element's page counts.
    """
    elements = materialize(elements, "elements")
    chunks = materialize(chunk_elements(elements, config), "chunks")
    shape = elements.groupBy("doc_id").agg(F.max("page_end").alias("__last"), F.count_if(F.col("kind") == "heading").alias("sections"))
    if pages is not None:
        shape = pages.groupBy("doc_id").agg(F.countDistinct("page").cast("int").alias("__pages")).join(shape, "doc_id", "left").withColumn("__last", F.col("__pages"))
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "table").alias("tables"))
    rows = shape.join(made, "doc_id", "left")
    if read is not None:
        got = read.where(F.trim("markdown") != "").groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("ocr_pages"))
        rows = rows.join(got, "doc_id", "left")
    if warnings is not None:
        rows = rows.join(warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings")), "doc_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    many = lambda c, kind: (F.coalesce(c, F.array().cast(f"array<{kind}>")) if c in rows.columns else F.array().cast(f"array<{kind}>")).alias(c)
    return chunks, rows.select("doc_id", F.col("__last").alias("pages"), count("sections"), count("chunks"), count("tables"), many("ocr_pages", "int"), many("warnings", "string"))


def publish_ingest(spark: SparkSession, folder: str, chunks: DataFrame, summary: DataFrame, plugins: Plugins = Plugins()) -> None:
    """Embeds the chunks and publishes chunks, vectors and summary under ``folder``, all or nothing."""
    vectors = retrieval.embed(chunks.select("chunk_id", "doc_id", "section_id", "seq", "kind", "page_start", "page_end", "breadcrumb", "body_offset", "content"), plugins.embedder)
    sinks.publish(spark, {f"{folder}/chunks": sinks.chunk_sink(chunks), f"{folder}/vectors": vectors, f"{folder}/summary": summary})


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), plugins: Plugins = Plugins()) -> DataFrame:
    """Hits with their chunk's columns; ``queries``: query_id, session_id, text, embedding."""
    posts = materialize(retrieval.postings(chunks), "postings")
    hits = retrieval.hybrid(posts, retrieval.corpus(posts), vectors, queries, config, plugins.reranker)
    mine = hits.join(queries.select("query_id", "session_id"), "query_id")
    return mine.join(chunks, ["session_id", "chunk_id"])


def answer(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, history: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig(), plugins: Plugins = Plugins()) -> tuple[DataFrame, DataFrame]:
    """query_id, prompt, answer of a batch of questions, and their citations.

    ``queries``: query_id, session_id, text; blank questions go. ``history``: query_id, history (text). What
    is searched for is the question that the rewrite plug-in makes of text and history, embedded by the
    embedder plug-in; the prompt has the question as it was asked. Without an answer plug-in the
    answer is the prompt.
    """
    queries = rewritten(queries.where(asked(F.col("text"))), history, plugins)
    looked_up = retrieval.embed(queries.select("query_id", "session_id", F.col("search_text").alias("text")), plugins.embedder, "text")
    looked_up = materialize(looked_up, "questions")
    hits = materialize(search(chunks, vectors, looked_up, config, plugins), "hits")
    wide = context.expand(hits.select("query_id", "session_id", "rank", "chunk_id", "section_id", "seq", "chunk_type", "breadcrumb", "text", "page_start", "page_end"), chunks, config)
    prompts = context.prompts(wide, queries, history)
    answers = prompts.withColumn("answer", F.col("prompt")) if plugins.answer is None else mapped(prompts, plugins.answer, "prompt", "answer")
    return answers, context.citations(hits, config.excerpt)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents table: a line is a paragraph, a document a session of one section."""
    from lodestack.sources.adapters import document_lines

    packed = chunking.pack_paragraphs(document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    rows = packed.select("doc_id", F.lit(0).alias("section_id"), "seq", F.lit("text").alias("kind"), "text", "page_start", "page_end", F.lit("").alias("breadcrumb"))
    return chunking.with_context(rows).withColumn("session_id", F.col("doc_id").cast("string")).withColumn("chunk_type", F.col("kind"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the five best chunks of all documents by BM25 for each benchmark text."""
    chunks = materialize(document_chunks(spark, sf_dir), "chunks")
    corpus = F.lit("all")  # all documents are one session here
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), corpus.alias("session_id"), "text")
    # A chunk's place in the corpus: documents by id, then chunks in order.
    placed = chunks.withColumn("session_id", corpus).withColumn("seq", F.struct("doc_id", "seq"))
    posts = materialize(retrieval.postings(placed), "postings")
    hits = retrieval.bm25(posts, retrieval.corpus(posts), queries, 5)
    cited = context.citations(hits.drop("seq").join(chunks, "chunk_id"))
    keys = hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))
    return cited.join(keys, ["query_id", "rank"])
